"""Cleaning of a text corpus: five stages, each on all that the one before kept.

1. toxicity: documents that the string-kernel model rejects go.
2. near_duplicates: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. secrets: live-looking secrets are masked in the text; the documents stay.
5. tokens: every document is encoded by the byte-level vocabulary and checked by decoding.

Every stage but the last returns the columns of ``documents`` and takes any further columns along, whatever their
names. SQL cannot express the first stage's model, so ``ORACLE_SQL`` is None and tests hold the stages against
brute-force versions.

Null and empty texts pass all stages: they are not toxic, link with nothing, hold no passage and no secret, and give no
tokens. Rows with a null key pass too; of rows that repeat a key and a text the second stage keeps one, rows that
share a key but not a text are judged one by one. Ties go to the smallest key. An empty table stays empty, and
empty tables of labels or of the benchmark reject nothing. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestack.llm import bpe, near_duplicates, secrets, toxicity, winnowing
from wavestack.llm.common import drop_staged, free_name, read_table, small_batches, stage
from wavestack.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return near_duplicates.keep_one(docs, percent=80, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(free_name(n, docs) for n in ("n_words", "n_hit", "items"))
    found = winnowing.contamination(docs, read_table(spark, sf_dir, "benchmark"), names=names)
    return found.where(F.col(names[1]) == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)  # a null text stays null and has no length
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ship(spark)
    small_batches(spark)
    return bpe.encode_documents(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
