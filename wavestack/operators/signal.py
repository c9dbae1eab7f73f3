"""Trace conditioning: native where columns do, Arrow kernels for filters and transforms."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError
from ..functions import kernels


def detrend(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Less the least-squares line of each trace."""
    w = Window.partitionBy(*keys)
    x, y = F.col("n").cast("double"), F.col(value)
    slope = F.coalesce(F.regr_slope(y, x).over(w), F.lit(0.0))
    return df.withColumn("_s", slope).withColumn("_x", F.avg(x).over(w)).withColumn("_y", F.avg(y).over(w)).withColumn(value, y - F.col("_y") - F.col("_s") * (x - F.col("_x"))).drop("_s", "_x", "_y")


def taper(df: DataFrame, keys: list[str], value: str = "value", share: float = 0.05) -> DataFrame:
    """Cosine edges of ``share`` of each trace."""
    w = Window.partitionBy(*keys)
    total = F.count(F.lit(1)).over(w)
    at = F.col("n") - F.min("n").over(w)
    edge = F.floor(total * share + 0.5)
    near = F.least(at, total - 1 - at)
    ramp = 0.5 * (1 - F.cos(F.lit(math.pi) * F.try_divide(near.cast("double"), (edge - 1).cast("double"))))
    return df.withColumn(value, F.when((edge > 1) & (near < edge), ramp * F.col(value)).otherwise(F.col(value)))


def upsample(df: DataFrame, factor: int, keys: list[str], value: str = "value", pad: tuple[int, int] = (0, 0)) -> DataFrame:
    """Linear interpolation at ``factor`` times the rate; the last sample has no successor and stands alone.

    ``pad`` repeats the first and the last value by so many new samples, fewer than ``factor`` each, so that a
    trace whose ends lie within a sample of a span's covers it.
    """
    if not all(0 <= p < factor for p in pad):
        raise ConfigError("ends are padded by less than one sample")
    w = Window.partitionBy(*keys).orderBy("n")
    first, after = F.lag(value).over(w).isNull(), F.lead(value).over(w)
    steps = F.when(F.col("_next").isNotNull(), F.sequence(F.lit(0), F.lit(factor - 1))).otherwise(F.sequence(F.lit(0), F.lit(pad[1])))
    if pad[0]:
        steps = F.concat(F.when(F.col("_first"), F.sequence(F.lit(-pad[0]), F.lit(-1))).otherwise(F.array().cast("array<int>")), steps)
    wide = df.withColumn("_next", after).withColumn("_first", first).withColumn("_k", F.explode(steps))
    between = F.col(value) + F.when(F.col("_k") > 0, F.coalesce("_next", value) - F.col(value)).otherwise(F.lit(0.0)) * F.col("_k") / factor
    return wide.withColumn(value, between).withColumn("n", F.col("n") * factor + F.col("_k")).drop("_next", "_first", "_k")


def spread(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """rms, population standard deviation and mean of each trace."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.stddev_pop(value).alias("std"), F.avg(value).alias("mean"))


def fill_gaps(df: DataFrame, spine: DataFrame, keys: list[str], value: str = "value", filler: float = math.sqrt(np.finfo(float).tiny)) -> DataFrame:
    """Every (keys, n) of ``spine``, with ``filler`` where ``df`` has no sample."""
    return spine.join(df, [*keys, "n"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(filler)))


def _on_rows(column: pa.Array, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """``function(matrix, rows)`` on the arrays of a list column, those of one length at a time as the rows of a matrix."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.cumsum(size) - size
    done, length = [], np.zeros(len(column), np.int64)
    for n in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == n))
        out = np.asarray(function(values[first[rows][:, None] + np.arange(n)], rows), dtype=float)
        length[rows] = out.shape[1]
        done.append((rows, out))
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.empty(start[-1])
    for rows, out in done:
        flat[start[rows][:, None] + np.arange(out.shape[1])] = out
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat), mask=pa.array(~valid))


def map_traces(traces: DataFrame, function: Callable[[np.ndarray], np.ndarray], samples: str = "samples") -> DataFrame:
    """``function`` along the last axis of matrices of equally long arrays, in Arrow batches; other columns pass. Null arrays stay null."""
    at = traces.columns.index(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = _on_rows(columns[at], lambda x, rows: function(x))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    typed = traces.withColumn(samples, F.col(samples).cast("array<double>"))
    return typed.mapInArrow(run, typed.schema)


def bandpass(traces: DataFrame, rate: float, band: tuple[float, float, int], samples: str = "samples") -> DataFrame:
    """Detrend, taper and zero-phase band-pass of every trace."""
    if band[1] >= rate / 2:
        raise ConfigError("the high corner must be below Nyquist")
    return map_traces(traces, lambda x: kernels.preprocess(x, rate, band), samples)


def envelope(traces: DataFrame, squared: bool = False, samples: str = "samples") -> DataFrame:
    return map_traces(traces, lambda x: kernels.envelope(x) ** (2 if squared else 1), samples)


def resample(traces: DataFrame, rate: float, to: float, upfactor: int | None = None, samples: str = "samples") -> DataFrame:
    """Decimate where the rate divides; else raise it by ``upfactor`` first; else log it and leave the trace as it is.

    A trace left as it is fails the check of rates (``quality.channel_flags``).
    """
    if rate == to:
        return traces
    if rate % to == 0:
        return map_traces(traces, lambda x: kernels.decimate(x, rate, to), samples)
    if upfactor:
        if rate * upfactor % to:
            raise ConfigError(f"{rate} x {upfactor} is not a multiple of {to}")

        def both(x: np.ndarray) -> np.ndarray:
            return kernels.decimate(kernels.refine(x, upfactor), rate * upfactor, to)

        return map_traces(traces, both, samples)
    logging.getLogger(__name__).warning("cannot resample from %s to %s without an upfactor", rate, to)
    return traces


def shift_to_sample(df: DataFrame, rate: float, time_us: str = "t_us") -> DataFrame:
    """Nearest whole sample of each time stamp, and the shift in microseconds."""
    n = F.rint(F.col(time_us) * rate / 1e6).cast("long")
    return df.withColumn("n", n).withColumn("shift_us", (F.rint(n * 1e6 / rate).cast("long") - F.col(time_us)))


def shift_lanczos(traces: DataFrame, shift: str, samples: str = "samples", a: int = 20) -> DataFrame:
    """Traces moved onto whole samples: ``shift`` is the column with the part of a sample to move by; null gives null."""
    at, by = traces.columns.index(samples), traces.columns.index(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            moves = columns[by].cast(pa.float64()).to_numpy(zero_copy_only=False)
            moved = _on_rows(columns[at], lambda x, rows: kernels.lanczos_shift(x, moves[rows], a))  # noqa: B023
            columns[at] = pc.if_else(columns[by].is_valid(), moved, pa.scalar(None, moved.type))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    typed = traces.withColumn(samples, F.col(samples).cast("array<double>"))
    return typed.mapInArrow(run, typed.schema)


def remove_response(traces: DataFrame, rate: float, response: dict, water_level: float = 60.0, samples: str = "samples") -> DataFrame:
    """Ground motion: every trace divided by a poles-and-zeros response with a water level in dB."""
    return map_traces(traces, lambda x: kernels.apply_response(x, rate, response, None, water_level), samples)


def simulate_wood_anderson(traces: DataFrame, rate: float, response: dict | None, instrument: dict, water_level: float = 60.0, samples: str = "samples") -> DataFrame:
    """What a Wood-Anderson seismograph would have written, the recorder's response being removed if given."""
    return map_traces(traces, lambda x: kernels.apply_response(x, rate, response, instrument, water_level), samples)
