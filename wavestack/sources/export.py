"""Exports: nested catalogues, observation and marker lines, cut waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import wood_anderson
from ..operators.signal import remove_response, simulate_wood_anderson


def catalogue(events: DataFrame, picks: DataFrame, amplitudes: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with their picks (events without any are left out) and amplitudes (empty if none) as arrays."""
    nest = lambda df, name: df.groupBy(key).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias(name))
    inner = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in amplitudes.schema.fields if f.name != key)
    none = F.array().cast(f"array<struct<{inner}>>")
    return events.join(nest(picks, "picks"), key).join(nest(amplitudes, "amplitudes"), key, "left").withColumn("amplitudes", F.coalesce("amplitudes", none))


def nlloc_lines(picks: DataFrame) -> DataFrame:
    """Observation lines of picks (station, phase, pick_us, pick_error_s), to be sorted by the writer.

    Fields: station, instrument, component, onset, phase, motion, date, time, seconds, error kind and size,
    coda, amplitude, period, weight; unknown ones are ? or -1.
    """
    time = F.timestamp_micros("pick_us")
    seconds = F.pmod(F.col("pick_us"), F.lit(60_000_000)) / 1e6
    number = lambda c: F.format_string("%9.2e", c)
    line = F.concat_ws(" ", F.rpad("station", 6, " "), F.lit("?   "), F.lit("?   "), F.lit("?"), F.rpad("phase", 6, " "), F.lit("?"), F.date_format(time, "yyyyMMdd"), F.date_format(time, "HHmm"), F.format_string("%7.4f", seconds), F.lit("GAU"), number(F.coalesce("pick_error_s", F.lit(-1.0))), *[F.format_string("%.2e", F.lit(v)) for v in (-1.0, -1.0, -1.0, 1.0)])
    return picks.select(line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").sort("line").write.mode("overwrite").text(path)


def snuffler_stations(stations: DataFrame) -> DataFrame:
    """One line per station: network.station., latitude, longitude, elevation, depth."""
    return stations.select(F.concat(F.coalesce("network", F.lit("")), F.lit("."), F.col("station"), F.lit(". "), F.concat_ws(" ", "latitude", "longitude", "elevation", F.lit("0"))).alias("line"))


def snuffler_markers(events: DataFrame, picks: DataFrame) -> DataFrame:
    """(event_id, ord, line): the event marker and a marker per pick, P on the vertical, S on the north component."""
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    heads = events.select("event_id", F.lit(0).alias("ord"), F.concat(F.lit("event: "), stamp("coa_us"), F.lit(" 0 "), F.col("event_id"), F.lit(" 0.0 0.0 None None None Event None")).alias("line"))
    component = F.when(F.col("phase") == "P", "BHZ").otherwise("BHN")
    marks = picks.select("event_id", F.lit(1).alias("ord"), F.concat(F.lit("phase: "), stamp("pick_us"), F.lit(" 0 "), F.concat_ws(".", F.coalesce("network", F.lit("")), "station", F.lit(""), component), F.lit(" None None None "), F.col("phase"), F.lit(" None False")).alias("line"))
    return heads.unionByName(marks)


def cut(samples: DataFrame, events: DataFrame, before: float, after: float, batch: str = "batch") -> DataFrame:
    """Samples around each event's time: an equi-join on time buckets and a residual range filter."""
    width = int(max(before + after, 1.0) * 1e6)
    low, high = F.col("coa_us") - int(before * 1e6), F.col("coa_us") + int(after * 1e6)
    spans = events.select("event_id", batch, low.alias("_l"), high.alias("_h")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_l") / width), F.floor(F.col("_h") / width))))
    return samples.withColumn("_b", F.floor(F.col("t_us") / width)).join(spans, [batch, "_b"]).where(F.col("t_us").between(F.col("_l"), F.col("_h"))).drop("_b", "_l", "_h")


def in_metres(rows: DataFrame, columns: list[str], unit: str = "km") -> DataFrame:
    """Lengths in metres, as catalogues hold them."""
    factor = {"km": 1000.0, "m": 1.0}[unit]
    return rows.withColumns({c: F.col(c) * factor for c in columns})


def cut_arrays(samples: DataFrame, keys: list[str], rate: float, kind: str = "raw", response: dict | None = None, value: str = "value") -> DataFrame:
    """Cut samples (keys..., n, value) as traces (keys..., start_n, samples): raw, ``real`` (ground motion) or ``wa`` (Wood-Anderson)."""
    arrays = samples.groupBy(*keys).agg(F.min("n").alias("start_n"), F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("samples"))
    if kind == "real":
        return remove_response(arrays, rate, response)
    return simulate_wood_anderson(arrays, rate, response, wood_anderson()) if kind == "wa" else arrays
