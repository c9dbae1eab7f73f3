"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import audio, bpe, language, near_duplicates, repeats, secrets, sharding, toxicity, warc, winnowing
from .common import small_batches


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_audio": audio.op3_audio,
    "op4_language": language.op4_language,
    "op5_winnowing": winnowing.op5_winnowing,
    "op6_secrets": secrets.op6_secrets,
    "op7_repeats": repeats.op7_repeats,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_bpe": bpe.op10_bpe,
}

QUERIES = {name: _shipped(query) for name, query in _ALL.items()}

ORACLES: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op5_winnowing": winnowing.OP5_SQL,
    "op6_secrets": secrets.OP6_SQL,
    "op7_repeats": repeats.OP7_SQL,
}
