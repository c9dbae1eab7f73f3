"""Onset functions over samples (keys..., n, value): short- and long-term averages as window frames.

All windows are partitioned by the trace key, so traces spread over the cluster and no frame crosses one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from .signal import map_traces

TINY = 2.2e-308


def _window(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("n")


def _ratio(sta: Column, lta: Column) -> Column:
    return F.when(lta < TINY, F.lit(1.0)).otherwise(F.try_divide(sta, lta))


def energy(value: Column) -> Column:
    return value * value


def classic(df: DataFrame, nsta: int, nlta: int, keys: list[str], value: str = "value", out: str = "onset") -> DataFrame:
    """Mean of the last ``nsta`` over mean of the last ``nlta`` samples; 1 until the long window is full."""
    w = _window(keys)
    sta = F.sum(value).over(w.rowsBetween(1 - nsta, 0)) / nsta
    lta = F.sum(value).over(w.rowsBetween(1 - nlta, 0)) / nlta
    seen = F.row_number().over(w)
    return df.withColumn(out, F.when(seen >= nlta, _ratio(sta, lta)).otherwise(F.lit(1.0)))


def centred(df: DataFrame, nsta: int, nlta: int, keys: list[str], value: str = "value", out: str = "onset") -> DataFrame:
    """Mean of the next ``nsta`` over mean of the last ``nlta`` samples; 1 where either window is not full."""
    w = _window(keys)
    sta = F.sum(value).over(w.rowsBetween(1, nsta)) / nsta
    lta = F.sum(value).over(w.rowsBetween(1 - nlta, 0)) / nlta
    seen = F.row_number().over(w)
    ahead = F.count(value).over(w.rowsBetween(1, nsta))
    return df.withColumn(out, F.when((seen >= nlta) & (ahead == nsta), _ratio(sta, lta)).otherwise(F.lit(1.0)))


def recursive(traces: DataFrame, nsta: int, nlta: int, samples: str = "samples", out: str = "onset") -> DataFrame:
    """Exponential averages over an array column, starting at the second sample; the first ``nlta`` values are 1.

    An Arrow kernel on whole batches: its cost is in proportion to the samples.
    """
    return map_traces(traces.withColumn(out, F.col(samples)), lambda x: kernels.recursive_sta_lta(x, nsta, nlta), out)


def combine(df: DataFrame, keys: list[str], onset: str = "onset", floor: float = 0.4) -> DataFrame:
    """Root mean square of the components of each (keys, n), not below ``floor``."""
    return df.groupBy(*keys, "n").agg(F.greatest(F.sqrt(F.avg(F.col(onset) * F.col(onset))), F.lit(floor)).alias(onset))


def trim_edges(df: DataFrame, nsta: int, nlta: int, taper: int, keys: list[str], onset: str = "onset") -> DataFrame:
    """1 on the samples that taper and windows spoil: the first taper + nlta - 1 and the last nsta + taper."""
    w = _window(keys)
    first = F.row_number().over(w)
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    spoilt = (first <= taper + nlta - 1) | (first > total - nsta - taper)
    return df.withColumn(onset, F.when(spoilt, F.lit(1.0)).otherwise(F.col(onset)))


METHODS = {"classic": classic, "centred": centred}
