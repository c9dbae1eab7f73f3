"""Sinks: fixed-point scan series, events, picks, amplitudes, availability, travel times and maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.scalar import fixed_point, general

FACTORS = {"coa": 1e5, "coa_n": 1e5, "x": 1e6, "y": 1e6, "z": 1e3}


def quantised(scan: DataFrame, factors: dict[str, float] = FACTORS) -> DataFrame:
    """The scan series as whole numbers; thresholds apply to what is read back."""
    return scan.withColumns({c: fixed_point(F.col(c), f) for c, f in factors.items() if c in scan.columns})


def dequantised(scan: DataFrame, factors: dict[str, float] = FACTORS) -> DataFrame:
    return scan.withColumns({c: F.col(c) / f for c, f in factors.items() if c in scan.columns})


def write_scan(scan: DataFrame, path: str, day: str = "batch") -> None:
    """One folder a day; writing a day again replaces it."""
    quantised(scan).repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Travel times, maps, waveforms: Parquet, clustered by ``by``."""
    out = df.repartition(*by).sortWithinPartitions(*by) if by else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_lut(table: DataFrame, grid: Grid, path: str) -> None:
    """Travel times with the grid they belong to; ``readers.read_lut`` gives both back."""
    write_table(table, f"{path}/times", ["station", "phase"])
    row = [(list(map(float, grid.origin)), list(map(float, grid.spacing)), list(grid.counts))]
    table.sparkSession.createDataFrame(row, "origin array<double>, spacing array<double>, counts array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def write_maps(maps: DataFrame, path: str, key: str = "event") -> None:
    """Coalescence maps, a folder for each event."""
    maps.repartition(key).write.mode("overwrite").option("compression", "zstd").partitionBy(key).parquet(path)


# Columns of the files of triggered and of located events, and what they are called here.
TRIGGERED = {"EventID": "event_id", "CoaTime": "coa_us", "TRIG_COA": "trig_coa", "COA_X": "coa_x", "COA_Y": "coa_y", "COA_Z": "coa_z", "COA": "coa", "COA_NORM": "coa_norm"}
TRIGGER_WINDOWS = {"MinTime": "min_us", "MaxTime": "max_us"}
LOCATED = {
    "EventID": "event_id", "DT": "otime_us", "X": "spline_x", "Y": "spline_y", "Z": "spline_z", "COA": "coa", "COA_NORM": "coa_norm",
    "GAU_X": "gau_x", "GAU_Y": "gau_y", "GAU_Z": "gau_z", "GAU_ErrX": "gau_err_x", "GAU_ErrY": "gau_err_y", "GAU_ErrZ": "gau_err_z",
    "COV_ErrX": "err_x", "COV_ErrY": "err_y", "COV_ErrZ": "err_z", "COV_Err_XYZ": "err_xyz", "TRIG_COA": "trig_coa", "DEC_COA": "dec_coa", "DEC_COA_NORM": "dec_coa_norm",
}
MAGNITUDES = {"ML": "ml", "ML_Err": "ml_err", "ML_r2": "ml_r2"}


def triggered_rows(events: DataFrame, windows: bool = False, precision: int = 6, depth_precision: int = 3) -> DataFrame:
    """Triggered events in the columns of their file, with their time windows if wanted."""
    out = []
    for name, column in (TRIGGERED | (TRIGGER_WINDOWS if windows else {})).items():
        value = F.col(column)
        if column.endswith("_us"):
            value = F.timestamp_micros(value)
        elif column.startswith("coa_") and column[-1] in "xyz":
            value = F.round(value, depth_precision if column[-1] == "z" else precision)
        elif name != "EventID":
            value = general(value, 4)
        out.append(value.alias(name))
    return events.select(*out)


def event_rows(events: DataFrame, grid: Grid, km: bool = True) -> DataFrame:
    """Located events in the columns of their file; magnitudes too if the events have them.

    Coalescence has four significant digits and magnitudes three. Places are rounded to two digits beyond the grid's
    precision: lon and lat to six at least, depth and all errors to three at least if they are in km.
    """
    digits = [2 - math.floor(math.log10(s)) for s in grid.spacing]
    flat, deep = [max(d, 6) for d in digits[:2]], max(digits[2], 3 if km else 0)
    out = []
    for name, column in (LOCATED | (MAGNITUDES if "ml" in events.columns else {})).items():
        value = F.col(column)
        if column.endswith("_us"):
            value = F.timestamp_micros(value)
        elif "COA" in name:
            value = general(value, 4)
        elif name.startswith("ML"):
            value = general(value, 3)
        elif name != "EventID":
            places = flat["XY".index(name[-1])] if name[-1] in "XY" and "Err" not in name else deep
            value = F.round(value, places)
            value = value.cast("long") if places <= 0 else value
        out.append(value.alias(name))
    return events.select(*out)


def pick_rows(picks: DataFrame) -> DataFrame:
    return picks.withColumns({c: general(F.col(c), 3) for c in ("pick_error", "snr") if c in picks.columns})


def amplitude_rows(rows: DataFrame) -> DataFrame:
    digits = {"epi_dist": 5, "z_dist": 5, "p_amp": 5, "s_amp": 5, "noise_amp": 5, "p_freq": 2, "s_freq": 2, "p_filter_gain": 3, "s_filter_gain": 3, "ml": 3, "ml_err": 3}
    return rows.withColumns({c: general(F.col(c), d) for c, d in digits.items() if c in rows.columns})


def write_csv(df: DataFrame, path: str, day: str | None = None) -> None:
    # times to the microsecond, which is not the writer's own choice
    out = df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    (out.partitionBy(day) if day else out).csv(path)
