"""Data quality: availability of channels and stations, segment merging, chunks with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def channel_flags(samples: DataFrame, keys: list[str], expected: int | None = None, allow_gaps: bool = False, value: str = "value", rate: float | None = None) -> DataFrame:
    """Per channel: n_samples, flat, n_gaps, n_overlaps and usable.

    ``samples`` is (keys..., n, value); a repeated n is an overlap, a skipped one a gap. ``expected`` is the
    number of samples of the full span, if it must be covered; with ``rate`` a channel must have that rate
    throughout (column ``rate``).
    """
    step = F.col("n") - F.lag("n").over(Window.partitionBy(*keys).orderBy("n"))
    rows = samples.withColumn("_step", step)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.max(value) == F.min(value)).alias("flat"),
        F.sum(F.when(F.col("_step") > 1, 1).otherwise(0)).alias("n_gaps"), F.sum(F.when(F.col("_step") == 0, 1).otherwise(0)).alias("n_overlaps"),
    )
    good = ~F.col("flat") & (F.col("n_overlaps") == 0)
    if not allow_gaps:
        good = good & (F.col("n_gaps") == 0)
    if expected is not None:
        good = good & (F.col("n_samples") >= expected)
    if rate is not None:
        right = samples.groupBy(*keys).agg(F.bool_and(F.col("rate") == rate).alias("rate_ok"))
        out, good = out.join(right, keys), good & F.coalesce(F.col("rate_ok"), F.lit(False))
    return out.withColumn("usable", good)


def station_flags(channels: DataFrame, keys: list[str], wanted: int | None = None) -> DataFrame:
    """Per station (and phase): available if ``wanted`` channels are there and all usable; without ``wanted``, if any is."""
    out = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.bool_and("usable").alias("_all"), F.bool_or("usable").alias("_any"))
    flag = (F.col("_all") & (F.col("n_channels") == wanted)) if wanted is not None else F.col("_any")
    return out.select(*keys, "n_channels", flag.cast("int").alias("available"))


def availability_table(flags: DataFrame, step: str, name: str, names: list[str], value: str = "available") -> DataFrame:
    """Wide form: one row per step, one 0/1 column per name."""
    return flags.groupBy(step).pivot(name, names).agg(F.max(value)).na.fill(0)


def availability_long(wide: DataFrame, step: str) -> DataFrame:
    """Long form of a wide table; a column that names no phase stands for both phases."""
    names = [c for c in wide.columns if c != step]
    long = wide.unpivot([step], names, "name", "available")
    phased = F.when(F.col("name").rlike("_[^_]+$"), F.array(F.col("name"))).otherwise(F.array(F.concat("name", F.lit("_P")), F.concat("name", F.lit("_S"))))
    return long.select(step, F.explode(phased).alias("name"), "available")


def chunks(samples: DataFrame, length: int, before: int, after: int, n: str = "n") -> DataFrame:
    """Every sample in each chunk of ``length`` whose span, padded by ``before`` and ``after``, contains it."""
    last = F.floor((F.col(n) + before) / length)
    first = F.greatest(F.lit(0), F.ceil((F.col(n) - after - length + 1) / length))
    return samples.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.greatest(first.cast("long"), last.cast("long")))))


def merge_segments(samples: DataFrame, keys: list[str], value: str = "value", kind: str | None = None) -> DataFrame:
    """One sample per (keys, n): identical copies merge; channels with clashing copies, or of several kinds, go."""
    marks = [F.count_distinct(value).alias("_v")] + ([F.min(kind).alias("_k0"), F.max(kind).alias("_k1")] if kind else [])
    per = samples.groupBy(*keys, "n").agg(F.min(value).alias(value), *marks)
    bad = F.col("_v") > 1
    w = Window.partitionBy(*keys)
    flags = F.max(bad.cast("int")).over(w) == 0
    if kind:
        flags = flags & (F.min("_k0").over(w) == F.max("_k1").over(w))
    return per.withColumn("_ok", flags).where("_ok").select(*keys, "n", value)


def segments(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous runs (first, last, count) of each channel."""
    run = F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n"))
    return samples.select(*keys, "n").distinct().withColumn("_r", run).groupBy(*keys, "_r").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count(F.lit(1)).alias("n_samples")).drop("_r")
