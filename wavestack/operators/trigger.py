"""Triggering: thresholds, gaps and islands, merging, filters. Everything is partitioned by batch (a day)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Trigger
from ..functions.scalar import event_id

MAD_SCALE = 1.4826


def threshold(scan: DataFrame, config: Trigger, rate: float, batch: str = "batch", value: str | None = None) -> DataFrame:
    """``scan`` with its threshold: a constant, or median + k x MAD or k x median of each chunk of rows.

    Chunks count rows from the batch's first, pad included; the last may be short.
    """
    value = value or config.on
    if config.method == "static":
        return scan.withColumn("threshold", F.lit(float(config.threshold)))
    length = int(config.window * rate)
    rows = scan.withColumn("_chunk", F.floor(F.col("n") / length))
    w = Window.partitionBy(batch, "_chunk")
    rows = rows.withColumn("_m", F.median(value).over(w))
    if config.method == "median_ratio":
        return rows.withColumn("threshold", F.col("_m") * config.multiplier).drop("_chunk", "_m")
    rows = rows.withColumn("_d", F.abs(F.col(value) - F.col("_m"))).withColumn("_mad", F.median("_d").over(w) * MAD_SCALE)
    return rows.withColumn("threshold", F.col("_m") + config.multiplier * F.col("_mad")).drop("_chunk", "_m", "_d", "_mad")


def smooth(scan: DataFrame, sigma: float, columns: list[str], batch: str = "batch", truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing (``sigma`` in samples) with mirrored ends; ``n`` counts the samples of a batch from 0.

    A frame of 2r + 1 rows is weighted at each sample, so every sample is read once; only the samples next to the ends
    are repeated, as their own mirror images beyond them.
    """
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.lit(v / sum(raw)) for v in raw])
    total = F.count(F.lit(1)).over(Window.partitionBy(batch))
    rows = scan.select(batch, F.col("n").cast("long").alias("n"), F.struct(*columns).alias("_v"), total.alias("_total"))

    def source(place: Column) -> Column:
        folded = F.pmod(place, 2 * F.col("_total"))
        return F.when(folded < F.col("_total"), folded).otherwise(2 * F.col("_total") - 1 - folded)

    beyond = F.concat(F.sequence(F.lit(-radius).cast("long"), F.lit(-1).cast("long")), F.sequence(F.col("_total"), F.col("_total") + radius - 1))
    edge = rows.where((F.col("n") < radius) | (F.col("n") >= F.col("_total") - radius)) if radius else rows.limit(0)
    images = edge.withColumn("_at", F.explode(F.filter(beyond, lambda p: source(p) == F.col("n")))).select(batch, F.col("_at").alias("n"), "_v", "_total")
    frame = Window.partitionBy(batch).orderBy("n").rowsBetween(-radius, radius)
    wide = rows.union(images).withColumn("_near", F.collect_list("_v").over(frame)).where((F.col("n") >= 0) & (F.col("n") < F.col("_total")))
    weighted = lambda c: F.aggregate(F.zip_with(F.transform("_near", lambda v: v[c]), weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    out = wide.select(batch, "n", *[weighted(c).alias(c) for c in columns])
    return scan.drop(*columns).join(out, [batch, "n"])


def candidates(scan: DataFrame, config: Trigger, batch: str = "batch") -> DataFrame:
    """One row per run of samples at or above the threshold.

    ``scan`` has batch, n, t_us, coa, coa_n, x, y, z, threshold. The peak is the first largest ``coa`` of the
    run, also when triggering on ``coa_n``; times are microseconds.
    """
    on = F.col(config.on)
    over = scan.where(on >= F.col("threshold"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(batch).orderBy("n"))
    best = F.struct("coa", (-F.col("n")).alias("first"))
    peak = F.max_by(F.struct("t_us", on.alias("trig"), "x", "y", "z", "coa", "coa_n"), best)
    runs = over.withColumn("island", island).groupBy(batch, "island").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), peak.alias("p"))
    marginal, interval = int(config.marginal * 1e6), int(config.interval * 1e6)
    time, rest = F.col("p.t_us"), interval - marginal
    low = F.when(time - F.col("first_us") < marginal, time - interval).otherwise(F.col("first_us") - rest)
    high = F.when(F.col("last_us") - time < marginal, time + interval).otherwise(F.col("last_us") + rest)
    return runs.select(batch, "island", "first_us", "last_us", time.alias("coa_us"), F.col("p.trig").alias("trig_coa"), F.col("p.x").alias("coa_x"), F.col("p.y").alias("coa_y"), F.col("p.z").alias("coa_z"), F.col("p.coa").alias("coa"), F.col("p.coa_n").alias("coa_norm"), low.alias("min_us"), high.alias("max_us"))


def refine(found: DataFrame, config: Trigger, batch: str = "batch") -> DataFrame:
    """Candidates whose windows touch their neighbour's peak are one event: the one of largest ``trig_coa``, first on ties."""
    w = Window.partitionBy(batch).orderBy("coa_us")
    marginal = int(config.marginal * 1e6)
    apart = (F.lag("max_us").over(w) < F.col("coa_us") - marginal) & (F.col("min_us") > F.lag("coa_us").over(w) + marginal)
    best = F.struct("trig_coa", (-F.col("coa_us")).alias("first"))
    kept = F.max_by(F.struct("coa_us", "trig_coa", "coa_x", "coa_y", "coa_z", "coa", "coa_norm"), best)
    # the flag is a window of its own, so it is fixed before the running sum
    flagged = found.withColumn("_apart", F.when(apart, 1).otherwise(0)).withColumn("event_num", F.sum("_apart").over(w))
    out = flagged.groupBy(batch, "event_num").agg(kept.alias("e"), F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"))
    return out.select(batch, "event_num", event_id(F.timestamp_micros("e.coa_us")).alias("event_id"), "e.*", "min_us", "max_us")


def inside(events: DataFrame, start_us: int, end_us: int, region: tuple[float, ...] | None = None) -> DataFrame:
    """Events of the span, and of the box (x, y, z lower, x, y, z upper); all bounds belong to it."""
    keep = F.col("coa_us").between(start_us, end_us)
    if region:
        for c, low, high in zip(("coa_x", "coa_y", "coa_z"), region[:3], region[3:], strict=True):
            keep = keep & F.col(c).between(low, high)
    return events.where(keep)


def discarded(events: DataFrame, kept: DataFrame) -> DataFrame:
    return events.join(kept.select("batch", "event_id"), ["batch", "event_id"], "left_anti").na.drop()


def mad(value: Column, median: Column) -> Column:
    """Scaled median absolute deviation as an aggregate, given the median."""
    return F.median(F.abs(value - median)) * MAD_SCALE
