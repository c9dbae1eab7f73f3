"""Detect: traces to a coalescence series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataAvailability
from ..functions.scalar import glob_regex
from ..operators import grid, migrate, onset, quality
from ..session import staged
from .plugins import OnsetMethod, checked


def onsets(traces: DataFrame, nsta: int, nlta: int, position: str = "classic", floor: float = 0.4, phase: str = "P") -> DataFrame:
    """(station, phase, n, onset) from (station, channel, n, value): energy, STA/LTA, RMS over channels."""
    rows = traces.withColumn("value", onset.energy(F.col("value")))
    rows = onset.METHODS[position](rows, nsta, nlta, ["station", "channel"])
    return onset.combine(rows, ["station"], floor=floor).select("station", F.lit(phase).alias("phase"), "n", "onset")


def coalescence(onsets: DataFrame, travel_times: DataFrame, rate: int, first: int, last: int) -> DataFrame:
    """(node, t, coa)."""
    return migrate.stack(onsets, grid.travel_samples(travel_times, rate), first, last)


def detect(traces: DataFrame, travel_times: DataFrame, rate: int, nsta: int, nlta: int, first: int, last: int, digits: int | None = None) -> DataFrame:
    """(t, max_coa, max_coa_n, node) through one span of time, by blocks of nodes."""
    rows = onsets(traces, nsta, nlta).withColumn("chunk", F.lit(0))
    table = grid.travel_samples(travel_times.where("phase = 'P'"), rate)
    return migrate.detect_blocks(rows, table, first, last, digits=digits).drop("chunk")


def usable_onsets(samples: DataFrame, method: OnsetMethod, keys: tuple[str, ...], expected: int) -> tuple[DataFrame, DataFrame]:
    """(onsets, availability) of every phase: (keys..., station, phase, n, onset) and (keys..., station, phase, available).

    A station takes part with a phase if it has the wanted number of channels and all of them cover the span
    of ``expected`` samples without gaps, overlaps or flat lines.
    """
    config, parts, flags = method.config, [], []
    for phase in config.phases:
        own = samples.where(F.col("channel").rlike(glob_regex(config.channels[phase])))
        channels = quality.channel_flags(own, [*keys, "station", "channel"], expected)
        stations = quality.station_flags(channels, [*keys, "station"], config.channel_counts[phase])
        flags.append(stations.select(*keys, "station", F.lit(phase).alias("phase"), "available"))
        good = own.join(stations.where("available = 1").select(*keys, "station"), [*keys, "station"], "left_semi")
        parts.append(method.onsets(good, phase, keys))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, flags)


def detect_chunks(traces: DataFrame, travel_times: DataFrame, method: OnsetMethod, nodes: DataFrame, rate: int, length: int, chunks: int, before: int, after: int, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The scan series and the availability of ``chunks`` spans of ``length`` samples, each read with its pads.

    Series: (chunk, t, n, max_coa, max_coa_n, x, y, z) with every sample of every chunk; a chunk without a usable onset,
    and a sample that no node's onsets all reach, has zeros. Availability: (chunk, station, phase, available).
    """
    checked(method, OnsetMethod)
    spread = quality.chunks(traces, length, before, after).where(F.col("chunk") < chunks).withColumn("n", F.col("n") - F.col("chunk") * length)
    rows, availability = usable_onsets(spread, method, ("chunk",), length + before + after)
    rows = staged(rows, "onsets")
    found = migrate.detect_blocks(rows, grid.travel_samples(travel_times, rate), 0, length, digits=digits)
    placed = found.join(nodes.select("node", "x", "y", "z"), "node")
    spine = traces.sparkSession.range(chunks * length).select(F.floor(F.col("id") / length).alias("chunk"), (F.col("id") % length).alias("t"), F.col("id").alias("n"))
    filled = spine.join(placed, ["chunk", "t"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return filled.select("chunk", "t", "n", *[zero(c) for c in ("max_coa", "max_coa_n", "x", "y", "z")]), availability


def require_onsets(availability: DataFrame) -> None:
    """An error if no station can be used with any phase."""
    if availability.where("available = 1").isEmpty():
        raise DataAvailability("no onset passes the quality checks")
