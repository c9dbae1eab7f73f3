"""From an archive of synthetic traces to located events: what was put in must come out."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wavestack.config import Amplitude, Grid, Magnitude, Onset, Picker, Trigger
from wavestack.errors import ConfigError
from wavestack.operators import grid as grids
from wavestack.plans import run as runs
from wavestack.plans.plugins import StaLta
from wavestack.sources import readers, synthetic, writers

GRID = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (9, 9, 6))
SPEEDS = {"P": 5.0, "S": 2.9}
RATE = 50
START = 1_704_067_190_000_000  # ten seconds before a midnight
SOURCES = ((3, 5, 2, 1_704_067_204_000_000), (6, 4, 3, 1_704_067_232_000_000))


@pytest.fixture(scope="module")
def located(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    places = [(f"ST{i}", float(x), float(y), -0.5) for i, (x, y) in enumerate([(0, 0), (8, 0), (0, 8), (8, 8), (4, 1), (4, 7), (1, 4), (7, 4)])]
    sites = spark.createDataFrame(places, "station string, x double, y double, z double").cache()
    table = grids.homogeneous(grids.nodes(spark, GRID), sites, SPEEDS)
    writers.write_lut(table, GRID, str(root / "lut"))
    parts = []
    for i, j, k, time in SOURCES:
        node = (i * 9 + j) * 6 + k
        own = table.where(F.col("node") == node).select("station", "phase", (F.col("tt") + (time - START) / 1e6).alias("tt"))
        parts.append(synthetic.traces(own, RATE, 3500, 2.0, 6.0, noise=0.0, speed=0.2))
    waves = parts[0].withColumnRenamed("value", "a").join(parts[1].withColumnRenamed("value", "b"), ["station", "phase", "n"])
    channel = F.explode(F.when(F.col("phase") == "P", F.array(F.lit("HHZ"))).otherwise(F.array(F.lit("HHN"), F.lit("HHE"))))
    noise = (F.pmod(F.xxhash64("station", "channel", "n"), F.lit(2001)) - 1000) / 1e7
    rows = waves.withColumn("channel", channel).select("station", "channel", (F.lit(START) + F.col("n") * 20_000).alias("t_us"), (F.col("a") + F.col("b") + noise).alias("value"))
    time = F.timestamp_micros("t_us")
    rows.withColumns({"year": F.year(time), "jday": F.dayofyear(time)}).write.partitionBy("year", "jday").parquet(str(root / "archive"))
    config = Onset(rate=RATE, windows={"P": (0.2, 1.0), "S": (0.2, 1.0)}, bandpass={"P": (2.0, 16.0, 2), "S": (2.0, 14.0, 2)})
    run = runs.Run(str(root / "archive"), str(root / "lut"), str(root / "out"), StaLta(config, filtered=True))
    runs.run_detect(spark, run, START + 6_000_000, START + 54_000_000, 12.0)
    runs.run_trigger(spark, run, Trigger(threshold=1.5, marginal=1.0, interval=4.0, pad=10.0), START + 6_000_000, START + 54_000_000)
    runs.run_locate(spark, run, sites, 1.0, picker=Picker(marginal=1.0), amplitude=Amplitude(noise_window=1.0, signal_window=0.5), mags=Magnitude(noise_filter=1.0, use_hyp_dist=True))
    return run


def test_detect_writes_every_sample(spark, located):
    scan = readers.read_scan(spark, f"{located.out}/scan", 0, 2 * START)
    assert scan.count() == 48 * RATE and {str(r.batch) for r in scan.select("batch").distinct().collect()} == {"2023-12-31", "2024-01-01"}
    flags = spark.read.parquet(f"{located.out}/availability")
    assert flags.count() == 4 * 16 and flags.where("available = 1").count() == 4 * 16


def test_trigger_finds_the_sources(spark, located):
    got = sorted(r.coa_us for r in readers.read_triggered(spark, f"{located.out}/triggered").collect())
    assert len(got) == 2 and all(abs(a - s[3]) < 400_000 for a, s in zip(got, SOURCES))


def test_locate_gives_places_and_times(spark, located):
    got = spark.read.option("header", True).csv(f"{located.out}/events").orderBy("EventID").collect()
    assert len(got) == 2
    for r, (i, j, k, time) in zip(got, SOURCES):
        assert abs(float(r.X) - i) <= 0.6 and abs(float(r.Y) - j) <= 0.6 and abs(float(r.Z) - k) <= 1.1
        when = datetime.datetime.fromisoformat(r.DT.replace("Z", "+00:00")).replace(tzinfo=datetime.UTC).timestamp()
        assert abs(when - time / 1e6) < 0.3
        assert r.ML is not None and float(r.ML_Err) >= 0 and float(r.COV_Err_XYZ) > 0


def test_picks_are_near_the_arrivals(spark, located):
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{located.out}/picks")
    made = rows.where("pick_us IS NOT NULL")
    assert rows.count() == 2 * 16 and made.count() >= 24
    assert made.agg(F.expr("percentile(abs(residual), 0.5)")).first()[0] < 0.3


def test_amplitudes_fall_with_distance(spark, located):
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{located.out}/amplitudes")
    assert rows.count() == 2 * 24 and rows.where("s_amp > noise_amp").count() >= 2 * 12


def test_runs_leave_nothing_staged(spark, located, tmp_path):
    from wavestack.session import passing, remove, scratch, staged

    with passing(spark):
        table = staged(spark.range(3), "few")
        kept = table.inputFiles()
        table.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert not any(Path(f.removeprefix("file://")).exists() for f in kept)
    remove(spark, scratch(spark, "nothing"))


def test_span_in_the_wrong_order(spark, located):
    with pytest.raises(ConfigError):
        runs.run_detect(spark, located, 10, 5, 1.0)
