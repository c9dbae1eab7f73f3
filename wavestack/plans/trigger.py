"""Trigger: a coalescence series to events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Trigger
from ..errors import ConfigError
from ..operators import trigger as ops


def trigger(scan: DataFrame, config: Trigger, rate: float, batch: str = "batch") -> DataFrame:
    """Smoothed if wanted, thresholded, made into candidates and merged."""
    if config.smooth:
        scan = ops.smooth(scan, config.sigma * rate, ["coa", "coa_n"], batch, config.truncate)
    return ops.refine(ops.candidates(ops.threshold(scan, config, rate, batch), config, batch), config, batch)


def trigger_days(scan: DataFrame, config: Trigger, rate: float, start_us: int, end_us: int, region: tuple[float, ...] | None = None) -> DataFrame:
    """Events from ``start_us`` to ``end_us``, day by day in one job: every day is a batch with its pads.

    ``scan`` is (t_us, n, coa, coa_n, x, y, z); a sample near midnight belongs to both days' batches, and an event to
    the day its peak falls on. The end belongs to the span unless it is a midnight.
    """
    if start_us > end_us:
        raise ConfigError("the span ends before it starts")
    day, pad = 86_400_000_000, int(config.pad * 1e6)
    t = F.col("t_us")
    first, last = start_us // day, (end_us - 1) // day
    low = F.greatest(F.floor((t - pad) / day), F.lit(first))
    high = F.least(F.floor((t + pad) / day), F.lit(last))
    near = scan.where(t.between(start_us - pad, end_us + pad)).withColumn("_day", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    rows = near.withColumn("batch", F.date_from_unix_date(F.col("_day").cast("int")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("batch").orderBy("t_us", "n")).cast("long") - 1).drop("_day")
    events = trigger(rows, config, rate)
    of_day = F.unix_date("batch").cast("long") * day
    inside = F.col("coa_us").between(F.greatest(of_day, F.lit(start_us)), F.least(of_day + day - 1, F.lit(end_us - (end_us % day == 0))))
    return ops.inside(events.where(inside), start_us, end_us, region)
