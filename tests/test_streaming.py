"""Streaming forms against the batch result on the same samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavestack.config import Trigger
from wavestack.streaming import live

SCHEMA = "network string, ts timestamp, coa double, coa_n double, x double, y double, z double"


def _write(spark, path, coa):
    rows = [("N", float(i), float(c)) for i, c in enumerate(coa)]
    df = spark.createDataFrame(rows, "network string, s double, coa double").select("network", F.timestamp_seconds("s").alias("ts"), "coa", F.lit(1.0).alias("coa_n"), *[F.lit(0.0).alias(c) for c in "xyz"])
    df.coalesce(1).write.parquet(path)


def _run(query_df, name, spark, tmp_path):
    query = query_df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_candidates(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), [1, 5, 6, 5, 1, 1, 7, 1, 1])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = _run(live.candidates(stream, Trigger(threshold=5.0), 1.0), "candidates", spark, tmp_path)
    assert sorted((r.first_us, r.last_us, r.coa_us) for r in got) == [(1_000_000, 3_000_000, 2_000_000), (6_000_000, 6_000_000, 6_000_000)]


def test_thresholds(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), [1, 2, 3, 4, 10] + [0] * 15)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    config = Trigger(method="mad", window=5.0, multiplier=2.0)
    got = _run(live.tumbling_thresholds(stream, config, "1 second"), "thresholds", spark, tmp_path)
    first = min(got, key=lambda r: r.start)
    assert abs(first.threshold - (3 + 2 * 1.4826 * 1)) < 1e-9
