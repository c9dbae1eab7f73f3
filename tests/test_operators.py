"""Operators on small fixtures: edge cases that the query catalogue does not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wavestack.config import Grid, Magnitude, Trigger
from wavestack.errors import ArchiveError, DataGap, TravelTimeError
from wavestack.functions import scalar
from wavestack.operators import grid, magnitude, migrate, onset, quality, trigger
from wavestack.sources import export, readers, writers


def _series(spark, values, name="value"):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], f"trace int, n int, {name} double")


def test_step_signal(spark):
    x = [1.0] * 6 + [4.0] * 6
    got = [r.onset for r in onset.classic(_series(spark, x), 2, 4, ["trace"]).orderBy("n").collect()]
    assert got[:3] == [1.0] * 3 and got[6] == pytest.approx(2.5 / 1.75) and got[7] == pytest.approx(4 / 2.5)
    got = [r.onset for r in onset.centred(_series(spark, x), 2, 4, ["trace"]).orderBy("n").collect()]
    assert got[5] == pytest.approx(4.0) and got[-1] == 1.0 and got[-2] == 1.0


def test_zero_signal_is_one(spark):
    got = onset.classic(_series(spark, [0.0] * 8), 2, 4, ["trace"]).select("onset").distinct().collect()
    assert [r.onset for r in got] == [1.0]


def test_static_candidates_and_merge(spark):
    coa = [1, 1, 5, 6, 5, 1, 1, 1, 7, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 9, 1]
    scan = spark.createDataFrame([("d", i, i * 1_000_000, float(c), 1.0, 0.0, 0.0, 0.0) for i, c in enumerate(coa)], "batch string, n long, t_us long, coa double, coa_n double, x double, y double, z double")
    config = Trigger(method="static", threshold=5.0, marginal=2.0, interval=4.0)
    found = trigger.candidates(trigger.threshold(scan, config, 1.0), config)
    assert sorted(r.coa_us for r in found.collect()) == [3_000_000, 8_000_000, 21_000_000]
    events = trigger.refine(found, config).orderBy("coa_us").collect()
    assert [e.coa_us for e in events] == [8_000_000, 21_000_000]
    assert events[0].event_id == "19700101000008000"


def test_threshold_is_inclusive(spark):
    scan = spark.createDataFrame([("d", 0, 0, 1.5, 1.0, 0.0, 0.0, 0.0)], "batch string, n long, t_us long, coa double, coa_n double, x double, y double, z double")
    assert trigger.candidates(trigger.threshold(scan, Trigger(), 1.0), Trigger()).count() == 1


def test_union_needs_equal_grids(spark):
    table = spark.createDataFrame([("A", "P", 0, 1.0)], "station string, phase string, node long, tt double")
    g = Grid((0, 0, 0), (1, 1, 1), (2, 2, 2))
    with pytest.raises(TravelTimeError):
        grid.union(table, table, g, Grid((0, 0, 0), (1, 1, 1), (3, 2, 2)))


def test_stack_of_equal_onsets(spark):
    onsets = spark.createDataFrame([(s, "P", n, 2.0) for s in "AB" for n in range(10)], "station string, phase string, n int, onset double")
    table = spark.createDataFrame([(s, "P", v, d) for s in "AB" for v, d in ((0, 1), (1, 3))], "station string, phase string, node long, tt_n int")
    got = migrate.find_max(migrate.stack(onsets, table, 0, 6)).collect()
    assert len(got) == 6 and all(r.max_coa == pytest.approx(2.0) and r.node == 0 and r.max_coa_n == pytest.approx(1.0) for r in got)


def test_availability_of_gappy_channels(spark):
    rows = [("A", "Z", n, float(n % 3)) for n in range(10)] + [("A", "N", n, 1.0) for n in range(10)] + [("B", "Z", n, float(n % 2)) for n in range(10) if n != 4]
    flags = quality.channel_flags(spark.createDataFrame(rows, "station string, channel string, n int, value double"), ["station", "channel"], expected=10)
    assert {(r.station, r.channel): r.usable for r in flags.collect()} == {("A", "Z"): True, ("A", "N"): False, ("B", "Z"): False}
    both = quality.station_flags(flags, ["station"], wanted=2).collect()
    assert {r.station: r.available for r in both} == {"A": 0, "B": 0}


def test_single_observation_has_its_own_error(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.3, True), (2, 1.0, 0.1, True), (2, 3.0, 0.1, True)], "event_id int, ml double, ml_err double, used boolean")
    got = {r.event_id: (r.ml, r.ml_err) for r in magnitude.network(rows).collect()}
    assert got[1] == (2.0, 0.3) and got[2] == pytest.approx((2.0, 1.0))


def test_magnitude_below_noise_is_null(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 2.0, 10.0, None)], "event_id int, id string, amp double, noise_amp double, dist double, filter_gain double")
    assert magnitude.channel_magnitudes(rows, Magnitude()).first().ml is None


def test_general_format(spark):
    values = [3.3, 112.5, 0.00012345, 1234567.0, 0.000012345, 5.0]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "x double").select(scalar.general(F.col("x"), 4).alias("s")).collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_general_format_of_every_branch(spark, sf):
    values = [12.35, 2.675, 0.125, 0.135, 2.5, 99.95, 999.5, 1e-4, 9.9996e-5, 1e5, -0.0, 0.0, -1234.5, 1e300, 5e-324, float("inf"), float("nan"), None]
    for digits in (1, 2, 3, 4, 5):
        got = [r.s for r in spark.createDataFrame([(v,) for v in values], "x double").select(scalar.general(F.col("x"), digits).alias("s")).collect()]
        assert got == [None if v is None else f"{v:.{digits}g}" for v in values]
    from wavestack.plans import views
    from wavestack.plans.queries import QUERIES

    want = {(r.batch, r.n): f"{r.coa:.3g}" for r in views.scan(spark, sf).collect()}
    assert {(r.batch, r.n): r.short for r in QUERIES["general_format_all"](spark, sf).collect()} == want


def test_scan_files(spark, tmp_path):
    scan = spark.createDataFrame([("2024-01-01", 0, 1_704_067_200_000_000, 1.234567, 2.0)], "batch string, n long, t_us long, coa double, coa_n double").withColumn("batch", F.col("batch").cast("date"))
    writers.write_scan(scan, str(tmp_path / "scan"))
    writers.write_scan(scan, str(tmp_path / "scan"))
    got = readers.read_scan(spark, str(tmp_path / "scan"), 1_704_067_200_000_000, 1_704_067_200_000_000)
    assert [r.coa for r in got.collect()] == [1.23457]
    with pytest.raises(DataGap):
        readers.read_scan(spark, str(tmp_path / "scan"), 0, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Elevation,Latitude,Longitude\nA1,0.5,64.1,-17.0\n")
    assert readers.read_stations(spark, str(tmp_path / "s.csv")).first().depth == -0.5
    (tmp_path / "v.csv").write_text("# model\nDepth,Vp,Vs\n0,3.0,1.7\n5,4.0,\n")
    assert sorted((r.phase, r.depth, r.speed) for r in readers.read_velocity(spark, str(tmp_path / "v.csv")).collect()) == [("P", 0.0, 3.0), ("P", 5.0, 4.0), ("S", 0.0, 1.7)]
    import datetime

    assert readers.archive_paths("/a", "YEAR/JD/STATION", [datetime.date(2020, 2, 1)], ["X"]) == ["/a/2020/032/X*"]
    with pytest.raises(ArchiveError):
        readers.archive_paths("/a", "none", [])


def test_events_at_midnight(spark, tmp_path):
    day = 86_400_000_000
    spark.createDataFrame([(day,), (day - 1,)], "coa_us long").write.parquet(str(tmp_path / "e"))
    assert readers.read_events(spark, str(tmp_path / "e"), 0, day).count() == 1
    assert readers.read_events(spark, str(tmp_path / "e"), 0, day + 1).count() == 2


def test_marker_lines(spark):
    events = spark.createDataFrame([("e1", 1_000_000)], "event_id string, coa_us long")
    picks = spark.createDataFrame([("e1", "ST", "P", 2_500_000, None)], "event_id string, station string, phase string, pick_us long, network string")
    lines = [r.line for r in export.snuffler_markers(events, picks).orderBy("ord").collect()]
    assert lines[0].startswith("event: 1970-01-01 00:00:01.000000 0 e1") and ".ST..BHZ" in lines[1]


def test_builtin_onset_is_a_plugin(spark):
    from wavestack.config import Onset
    from wavestack.errors import ConfigError
    from wavestack.plans import plugins

    method = plugins.StaLta(Onset(rate=50))
    plugins.checked(method, plugins.OnsetMethod)
    plugins.checked(plugins.GaussianPicker(), plugins.PickMethod)
    with pytest.raises(ConfigError):
        plugins.checked(object(), plugins.PickMethod)
    rows = spark.createDataFrame([("A", "HHZ", n, float(n % 5)) for n in range(80)] + [("A", "HHN", n, 1.0) for n in range(80)], "station string, channel string, n int, value double")
    got = method.onsets(rows, "P")
    assert got.count() == 80 and got.agg(F.min("onset")).first()[0] >= 0.4


def test_gain_matches_the_filter(spark):
    from wavestack.functions import kernels

    sections = kernels.butterworth(3, 2.0, 12.0, 100.0)
    rows = spark.createDataFrame([(f,) for f in (1.0, 2.0, 5.0, 20.0)], "freq double")
    for r in magnitude.filter_gain(rows, 100.0, (2.0, 12.0, 3)).collect():
        assert r.filter_gain == pytest.approx(kernels.section_gain(sections, r.freq, 100.0), abs=1e-9)


@pytest.mark.parametrize(("position", "transform"), [("recursive", "energy"), ("recursive", "abs"), ("classic", "env"), ("centred", "env_squared"), ("recursive", "env")])
def test_onset_methods_on_whole_traces(spark, position, transform):
    """Every position and transform against the same steps in plain numbers."""
    import numpy as np

    from wavestack.config import Onset
    from wavestack.functions import kernels
    from wavestack.plans import plugins

    x = np.sin(np.arange(90) / 3) + np.arange(90) % 4
    rows = spark.createDataFrame([("A", "HHZ", n + 5, float(v)) for n, v in enumerate(x)], "station string, channel string, n int, value double")
    config = Onset(rate=50, position=position, transform=transform)
    got = {r.n: r.onset for r in plugins.StaLta(config).onsets(rows, "P").collect()}
    y = {"energy": x * x, "abs": np.abs(x), "env": kernels.envelope(x), "env_squared": kernels.envelope(x) ** 2}[transform]
    sta, lta = config.samples("P")
    if position == "recursive":
        want = kernels.recursive_sta_lta(y, sta, lta)
    else:
        mean = lambda a, b: y[a:b].mean()
        want = np.ones(90)
        for i in range(lta - 1, 90):
            if position == "classic" or i + sta < 90:
                short = mean(i - sta + 1, i + 1) if position == "classic" else mean(i + 1, i + 1 + sta)
                want[i] = short / mean(i - lta + 1, i + 1)
    assert [got[n + 5] for n in range(90)] == pytest.approx(np.maximum(np.abs(want), 0.4).tolist(), rel=1e-6)


def test_blocks_keep_sample_numbers(spark):
    """A missing sample spoils the cells that need it and moves none; an offset start is no shift."""
    onsets = [(0, s, "P", n, 1.0 + (n * 3 + i) % 7) for i, s in enumerate("AB") for n in range(4, 40) if (s, n) != ("B", 20)]
    rows = spark.createDataFrame(onsets, "chunk int, station string, phase string, n int, onset double")
    table = spark.createDataFrame([(s, "P", v, (v + i) % 5) for i, s in enumerate("AB") for v in range(9)], "station string, phase string, node long, tt_n int")
    plain = {r.t: (r.node, round(r.max_coa, 9), round(r.max_coa_n, 9)) for r in migrate.find_max(migrate.stack(rows.drop("chunk"), table, 4, 30, available=2)).collect()}
    for block, width in ((4, 7), (100, 1000)):
        got = {r.t: (r.node, round(r.max_coa, 9), round(r.max_coa_n, 9)) for r in migrate.detect_blocks(rows, table, 4, 30, block=block, width=width).collect()}
        assert got == plain
    sums = {r.node: r.s for r in migrate.marginal_blocks(rows, table, spark.createDataFrame([(0, 6, 19)], "chunk int, first int, last int"), block=4, width=5).collect()}
    cells = migrate.stack(rows.drop("chunk"), table, 6, 19, available=2).groupBy("node").agg(F.sum("coa").alias("s")).collect()
    assert sums == pytest.approx({r.node: r.s for r in cells})


def test_detect_without_data_is_zero(spark):
    from wavestack.errors import DataAvailability
    from wavestack.plans import detect, stage_queries

    g = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2, 2, 1))
    traces = spark.createDataFrame([("A", "HHZ", n, 1.0) for n in range(60)], "station string, channel string, n int, value double")
    table = spark.createDataFrame([("A", "P", v, 1.0) for v in range(4)], "station string, phase string, node long, tt double")
    series, availability = detect.detect_chunks(traces, table, stage_queries.METHOD, grid.nodes(spark, g), 1, 10, 3, 5, 5)
    rows = series.collect()
    assert len(rows) == 30 and {(r.max_coa, r.max_coa_n, r.x) for r in rows} == {(0.0, 0.0, 0.0)}
    with pytest.raises(DataAvailability):
        detect.require_onsets(availability)


def test_station_outside_the_grid(spark):
    g = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3, 3, 3))
    sites = spark.createDataFrame([("IN", 1.0, 1.0, 1.0), ("OUT", 9.0, 1.0, 1.0)], "station string, x double, y double, z double")
    with pytest.raises(TravelTimeError, match="OUT"):
        grid.eikonal(grid.nodes(spark, g).select(F.lit("P").alias("phase"), "node", F.lit(2.0).alias("speed")), sites, g)


def test_travel_time_methods(spark):
    """A layered model of one speed gives straight rays, by either way of sweeping; unknown methods are errors."""
    g = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (5, 4, 4))
    sites = spark.createDataFrame([("A", 1.0, 2.0, 0.0)], "station string, x double, y double, z double")
    model = spark.createDataFrame([("P", 0.0, 2.0), ("P", 9.0, 2.0)], "phase string, depth double, speed double")
    straight = {r.node: r.tt for r in grid.travel_times(spark, g, sites, "homogeneous", ("P",), {"P": 2.0}).collect()}
    for method, off in (("1dfmm", 0.45), ("1dsweep", 0.35)):
        got = {r.node: r.tt for r in grid.travel_times(spark, g, sites, method, ("P",), model=model).collect()}
        assert set(got) == set(straight) and all(0 <= got[n] - straight[n] + 1e-6 <= off for n in got), method
    for method, kwargs in (("3dfmm", {}), ("homogeneous", {"speeds": {"S": 1.0}}), ("1dfmm", {})):
        with pytest.raises(TravelTimeError):
            grid.travel_times(spark, g, sites, method, ("P",), **kwargs)


def test_travel_time_files(spark, tmp_path):
    import numpy as np

    tt = np.arange(12, dtype="<f4") / 7
    (tmp_path / "m.P.STA.time.hdr").write_text("2 3 2  -1.5 0.0 -0.5  0.5 0.5 1.0 TIME FLOAT\nSTA 1.0 2.0 0.0\nTRANSFORM  LAMBERT RefEllipsoid WGS-84  LatOrig 64.0  LongOrig -17.0  FirstStdParal 63.0  SecondStdParal 65.0  RotCW 0.0\n")
    (tmp_path / "m.P.STA.time.buf").write_bytes(tt.tobytes())
    got = sorted((r.station, r.phase, r.node, r.tt) for r in readers.read_travel_grids(spark, str(tmp_path)).collect())
    assert [r[2] for r in got] == list(range(12)) and [r[3] for r in got] == pytest.approx(tt.tolist()) and got[0][:2] == ("STA", "P")
    head = readers.read_travel_headers(spark, str(tmp_path)).first()
    assert (head.counts, head.origin, head.spacing, head.projection) == ([2, 3, 2], [-1.5, 0.0, -0.5], [0.5, 0.5, 1.0], "LAMBERT")
    assert head.settings == {"LatOrig": 64.0, "LongOrig": -17.0, "FirstStdParal": 63.0, "SecondStdParal": 65.0, "RotCW": 0.0}


def test_lines_are_sorted(spark, tmp_path):
    lines = spark.range(500).select(F.concat(F.lit("S"), (F.col("id") * 7919 % 500).cast("string")).alias("line")).repartition(6)
    export.write_lines(lines, str(tmp_path / "l"))
    got = [x for f in sorted((tmp_path / "l").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == sorted(got) and len(got) == 500


def test_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "XX.A..HHZ", "start_us": 0, "end_us": 9, "poles": [{"re": -4.4, "im": 4.4}], "zeros": [], "gain": 2.0, "sensitivity": 1500.0}\n')
    got = readers.read_responses(spark, str(tmp_path / "r.json")).first()
    assert got.id == "XX.A..HHZ" and got.poles[0].im == 4.4 and got.zeros == [] and got.sensitivity == 1500.0


def test_amplitude_filter_falls_back(spark):
    from wavestack.config import Amplitude

    config = Amplitude(bandpass=(2.0, 20.0, 3))
    assert magnitude.amplitude_band(config, 100.0) == (2.0, 20.0, 3) and magnitude.amplitude_band(config, 30.0) == (2.0, None, 3)
    assert magnitude.amplitude_band(Amplitude(highpass=(1.0, 2)), 30.0) == (1.0, None, 2) and magnitude.amplitude_band(Amplitude(), 30.0) is None


def test_unresampled_rate_is_kept(spark, caplog):
    from wavestack.operators import signal

    rows = spark.createDataFrame([([1.0, 2.0, 3.0],)], "samples array<double>")
    assert signal.resample(rows, 40.0, 50.0).collect() == rows.collect() and "cannot resample" in caplog.text
