"""Sources: stations, velocity models, archives, scan series, events, availability, travel-time grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid
from ..errors import ArchiveError, ConfigError, DataGap
from ..operators.joins import with_small
from ..operators.quality import merge_segments
from ..operators.signal import shift_to_sample

# The named folder layouts of waveform archives as path patterns, relative to the archive.
LAYOUTS = {
    "SeisComp3": "{year}/*/{station}/{channels}.D/*.{station}.*.*.D.{year}.{jday:03d}",
    "YEAR/JD/*_STATION_*": "{year}/{jday:03d}/*_{station}_{channels}",
    "YEAR/JD/STATION": "{year}/{jday:03d}/{station}*",
    "STATION.YEAR.JULIANDAY": "*{station}.*.{year}.{jday:03d}",
    "/STATION/STATION.YearMonthDay": "{station}/{station}.{year}{month:02d}{day:02d}",
    "YEAR_JD/STATION*": "{year}_{jday:03d}/{station}*",
    "YEAR_JD/STATION_*": "{year}_{jday:03d}/{station}_*",
}


def archive_paths(root: str, layout: str, days: list, stations: list[str] | None = None, channels: str = "*") -> list[str]:
    """Path patterns of the given dates; a layout of our own may be given as a pattern."""
    pattern = LAYOUTS.get(layout, layout if "{" in layout else None)
    if pattern is None:
        raise ArchiveError(f"unknown archive layout {layout}")
    out = []
    for d in days:
        for s in stations or ["*"]:
            out.append(f"{root}/" + pattern.format(year=d.year, month=d.month, day=d.day, jday=d.timetuple().tm_yday, station=s, channels=channels).replace("**", "*"))
    return out


def read_traces(spark: SparkSession, path: str, start_us: int, end_us: int, pre: float = 0.0, post: float = 0.0, stations: DataFrame | None = None) -> DataFrame:
    """Samples (station, channel, t_us, value, year, jday) of a Parquet archive by day within the padded span.

    The day bounds prune partitions, the time bounds reach the scan; negative pads count as none.
    """
    low, high = start_us - int(max(0.0, pre) * 1e6), end_us + int(max(0.0, post) * 1e6)
    day = lambda us: F.expr(f"date_from_unix_date({us // 86_400_000_000})")
    key = F.col("year") * 1000 + F.col("jday")
    bound = lambda us: F.year(day(us)) * 1000 + F.dayofyear(day(us))
    rows = spark.read.parquet(path).where((key >= bound(low)) & (key <= bound(high)) & F.col("t_us").between(low, high))
    return with_small(rows, stations.select("station").distinct(), "station", "left_semi") if stations is not None else rows


def within(rows: DataFrame, low_us: int, high_us: int, day: str | None = None) -> DataFrame:
    """Rows with low <= t_us <= high; ``day`` names a date column by which the table is partitioned."""
    keep = F.col("t_us").between(low_us, high_us)
    if day:
        of = lambda us: F.expr(f"date_from_unix_date({us // 86_400_000_000})")
        keep = keep & F.col(day).between(of(low_us), of(high_us))
    return rows.where(keep)


def read_waveforms(spark: SparkSession, path: str, start_us: int, end_us: int, rate: float, pre: float = 0.0, post: float = 0.0, stations: DataFrame | None = None) -> DataFrame:
    """(station, channel, n, value): the padded span on whole samples, merged by channel and cut to start and end.

    ``n`` is the number of the sample since the epoch. Samples that come twice are one; a channel whose copies differ
    is left out. What was read, before all this, is ``read_traces``. No sample at all is an error.
    """
    raw = read_traces(spark, path, start_us, end_us, pre, post, stations)
    if raw.isEmpty():
        raise DataGap("no samples in the span")
    rows = merge_segments(shift_to_sample(raw, rate).select("station", "channel", "n", "value"), ["station", "channel"])
    return rows.where(F.col("n").between(round(start_us * rate / 1e6), round(end_us * rate / 1e6)))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """(station, latitude, longitude, depth) from a CSV of Latitude, Longitude, Elevation, Name in any order."""
    rows = spark.read.option("header", True).csv(path)
    need = {"Latitude", "Longitude", "Elevation", "Name"}
    if not need <= set(rows.columns):
        raise ConfigError(f"station file lacks {sorted(need - set(rows.columns))}")
    more = [c for c in rows.columns if c not in need]
    return rows.select(F.col("Name").cast("string").alias("station"), F.col("Latitude").cast("double").alias("latitude"), F.col("Longitude").cast("double").alias("longitude"), (-F.col("Elevation").cast("double")).alias("depth"), *[F.col(c).alias(c.lower()) for c in more])


def read_velocity(spark: SparkSession, path: str) -> DataFrame:
    """(phase, depth, speed) from a CSV of Depth and one V column per phase; lines from # on are comments."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    speeds = [c for c in rows.columns if c.startswith("V")]
    if "Depth" not in rows.columns or not speeds:
        raise ConfigError("velocity file needs Depth and V columns")
    typed = rows.select(F.col("Depth").cast("double").alias("depth"), *[F.col(c).cast("double").alias(c) for c in speeds])
    return typed.unpivot(["depth"], speeds, "phase", "speed").withColumn("phase", F.upper(F.expr("substring(phase, 2)"))).where("speed IS NOT NULL")


def read_scan(spark: SparkSession, path: str, start_us: int, end_us: int, pad: float = 0.0, day: str = "batch") -> DataFrame:
    """The scan series of the padded span, back from fixed point; no row at all is an error."""
    from .writers import dequantised

    rows = within(spark.read.parquet(path), start_us - int(pad * 1e6), end_us + int(pad * 1e6), day)
    if rows.isEmpty():
        raise DataGap("no scan data in the span")
    return dequantised(rows)


def read_events(spark: SparkSession, path: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Triggered events; the end belongs to the span unless it is exactly midnight."""
    rows = spark.read.parquet(path)
    if start_us is not None:
        rows = rows.where(F.col("coa_us") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("coa_us") < end_us if end_us % 86_400_000_000 == 0 else F.col("coa_us") <= end_us)
    if rows.isEmpty():
        raise DataGap("no triggered events")
    return rows


def read_triggered(spark: SparkSession, path: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Triggered events back from CSV: (EventID, coa_us, then the columns as they were written)."""
    rows = spark.read.option("header", True).csv(path)
    numbers = {"COA_X", "COA_Y", "COA_Z", "MinTime", "MaxTime"}
    typed = rows.select("EventID", F.unix_micros(F.to_timestamp("CoaTime")).alias("coa_us"), *[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in rows.columns if c not in ("EventID", "CoaTime")])
    if start_us is not None:
        typed = typed.where(F.col("coa_us") >= start_us)
    if end_us is not None:
        typed = typed.where(F.col("coa_us") < end_us if end_us % 86_400_000_000 == 0 else F.col("coa_us") <= end_us)
    if typed.isEmpty():
        raise DataGap("no triggered events")
    return typed


def read_lut(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Travel times (station, phase, node, tt) and the grid they belong to, as ``writers.write_lut`` keeps them."""
    g = spark.read.parquet(f"{path}/grid").first()
    return spark.read.parquet(f"{path}/times"), Grid(tuple(g["origin"]), tuple(g["spacing"]), tuple(g["counts"]))


def read_maps(spark: SparkSession, path: str, events: list, key: str = "event") -> DataFrame:
    """Coalescence maps (key, node, c) of the given events; only their folders are read."""
    return spark.read.parquet(path).where(F.col(key).isin(events))


RESPONSE = "id string, start_us long, end_us long, poles array<struct<re:double,im:double>>, zeros array<struct<re:double,im:double>>, gain double, sensitivity double"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Instrument responses, a JSON line for each channel and period of validity."""
    return spark.read.schema(RESPONSE).json(path)


def read_availability(spark: SparkSession, path: str, step: str = "step") -> DataFrame:
    """Long availability from wide CSVs; columns without a phase stand for both."""
    from ..operators.quality import availability_long

    rows = spark.read.option("header", True).csv(path)
    return availability_long(rows.select(F.col(step).cast("timestamp"), *[F.col(c).cast("int") for c in rows.columns if c != step]), step)


_HEADER = "stem string, station string, phase string, counts array<int>, origin array<double>, spacing array<double>, projection string, settings map<string,double>"


def _header(text: str) -> tuple:
    """(station, counts, origin, spacing, projection, settings) of a header file.

    First line: counts, origin, spacing; second: station and its place; then, if there, ``TRANSFORM name key value ...``.
    """
    lines = text.splitlines()
    first = lines[0].split()
    words = next((line.split()[1:] for line in lines if line.startswith("TRANSFORM")), ["NONE"])
    settings = {}
    for key, value in zip(words[1::2], words[2::2], strict=False):
        try:
            settings[key] = float(value)
        except ValueError:
            continue  # names, as of the ellipsoid, are no numbers
    return lines[1].split()[0], [int(v) for v in first[:3]], [float(v) for v in first[3:6]], [float(v) for v in first[6:9]], words[0], settings


def _travel_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.time.*").load(path)
    stem = F.regexp_replace(F.col("path"), r"\.(hdr|buf)$", "")
    of = lambda kind: F.max(F.when(F.col("path").endswith(kind), F.col("content")))
    return files.groupBy(stem.alias("stem")).agg(of(".hdr").alias("hdr"), of(".buf").alias("buf"))


def read_travel_headers(spark: SparkSession, path: str) -> DataFrame:
    """(stem, station, phase, counts, origin, spacing, projection, settings) of travel-time grid files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                station, counts, origin, spacing, projection, settings = _header(row["hdr"].decode())
                rows.append({"stem": row["stem"], "station": station, "phase": row["stem"].rsplit(".", 3)[-3], "counts": counts, "origin": origin, "spacing": spacing, "projection": projection, "settings": list(settings.items())})
            kinds = [("stem", pa.string()), ("station", pa.string()), ("phase", pa.string()), ("counts", pa.list_(pa.int32())), ("origin", pa.list_(pa.float64())), ("spacing", pa.list_(pa.float64())), ("projection", pa.string()), ("settings", pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return _travel_files(spark, path).drop("buf").mapInArrow(run, _HEADER)


def read_travel_grids(spark: SparkSession, path: str) -> DataFrame:
    """(station, phase, node, tt) from header and buffer pairs (``*.PHASE.STATION.time.hdr`` / ``.buf``).

    The header gives counts, origin, spacing and the station line; the buffer is 32-bit floats, node order
    (x, y, z) with z fastest. One file pair is one row of bytes, decoded in Arrow batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                station, counts, *_ = _header(row["hdr"].decode())
                n = counts[0] * counts[1] * counts[2]
                phase = row["stem"].rsplit(".", 3)[-3]
                tt = np.frombuffer(row["buf"], "<f4", n).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([station] * n), pa.array([phase] * n), pa.array(np.arange(n)), pa.array(tt)], names=["station", "phase", "node", "tt"])

    return _travel_files(spark, path).mapInArrow(run, "station string, phase string, node long, tt double")
