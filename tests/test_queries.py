"""Every query against its SQL; those without SQL against plain numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, sql_rows
from wavestack.functions import kernels, scalar
from wavestack.plans import views
from wavestack.plans.queries import ORACLES, QUERIES


#: Queries without a row at the smallest scale, which these tests run; they have some at the next one.
EMPTY = {"discarded_events", "marginal_window_test"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    names, want = sql_rows(ORACLES[name], sf)
    assert sorted(got.columns) == names
    assert rows(got) == want
    assert want or name in EMPTY, "an empty result shows nothing"


PLAIN = {"response_removal", "wood_anderson", "gaussian_pick", "peak_to_trough_kernel", "locations", "eikonal_tt", "synthetic_traces", "locate_spline_gaussian", "pick_fits", "cut_real"}


def test_all_queries_are_checked():
    assert set(QUERIES) == set(ORACLES) | PLAIN


@pytest.fixture(scope="module")
def arrays(spark, sf):
    return {(r.station, r.channel): np.array(r.samples) for r in views.trace_arrays(spark, sf).collect()}


def _traces(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault((r.station, r.channel), {})[r.n] = r.value
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _divided(x: np.ndarray, remove, simulate) -> np.ndarray:
    """One trace's spectrum by its sums, divided and multiplied by responses, with a water level of 60 dB."""
    size = len(x)
    t = np.arange(size)
    slope, level = np.polyfit(t, x, 1)
    edge = np.ones(size)
    edge[:3] = edge[-3:][::-1] = 0.5 * (1 - np.cos(np.pi * np.arange(3) / 2))
    edge[-3:] = edge[:3][::-1]
    y = (x - slope * t - level) * edge
    n = 128
    k = np.arange(n // 2 + 1)
    spectrum = np.exp(-2j * np.pi * np.outer(k, t) / n) @ y
    s = 2j * np.pi * k * 50.0 / n
    curve = lambda r: r["gain"] * r["sensitivity"] * np.prod([s - z for z in r["zeros"]], axis=0) / np.prod([s - p for p in r["poles"]], axis=0)
    if remove:
        h = curve(remove)
        least = np.abs(h).max() / 1000
        h = np.where(np.abs(h) < least, np.where(np.abs(h) > 0, h / np.maximum(np.abs(h), 1e-300), 0) * least, h)
        spectrum = np.where(h == 0, 0, spectrum / np.where(h == 0, 1, h))
        spectrum[0] = 0
    if simulate:
        spectrum = spectrum * curve(simulate)
    weight = np.where((k == 0) | (k == n // 2), 1, 2)
    return (np.exp(2j * np.pi * np.outer(t, k) / n) @ (spectrum * weight)).real / n


def test_response_removal(spark, sf, arrays):
    response = {"poles": [complex(-4.4, 4.4), complex(-4.4, -4.4)], "zeros": [0j, 0j], "gain": 1.0, "sensitivity": 1500.0}
    got = _traces(QUERIES["response_removal"](spark, sf))
    assert set(got) == set(arrays)
    for k in list(arrays)[:10]:
        assert np.allclose(got[k], _divided(arrays[k], response, None), atol=2e-6)


def test_wood_anderson(spark, sf, arrays):
    got = _traces(QUERIES["wood_anderson"](spark, sf))
    for k in list(arrays)[:10]:
        want = _divided(arrays[k], None, scalar.wood_anderson())
        assert np.allclose(got[k], want, atol=1e-6 * np.abs(want).max() + 1e-6)


def test_peak_to_trough(spark, sf, arrays):
    got = {(r.station, r.channel): r for r in QUERIES["peak_to_trough_kernel"](spark, sf).collect()}
    for key, x in arrays.items():
        turn = [i for i in range(1, 63) if (x[i] - x[i - 1]) * (x[i + 1] - x[i]) < 0]
        gaps = [abs(x[b] - x[a]) for a, b in zip(turn, turn[1:])]
        best = max(gaps)
        a, b = next((p, q) for (p, q), g in zip(zip(turn, turn[1:]), gaps) if g == best)
        assert (got[key].amp, got[key].freq, got[key].time_s) == pytest.approx((best * 500, 25 / (b - a), (a + b) / 100), abs=1e-5)


def test_gaussian_picks(spark, sf):
    found = QUERIES["gaussian_pick"](spark, sf).collect()
    assert found
    for r in found:
        if r.pick_n is not None:
            assert r.low_n < r.pick_n < r.high_n and r.pick_error_s > 0
    fits = QUERIES["pick_fits"](spark, sf).collect()
    arrivals = {(r.event, r.station, r.phase): r for r in QUERIES["pick_events"](spark, sf).collect()}
    assert fits
    for r in fits:
        a = arrivals[r.event, r.station, r.phase]
        assert a.low_n < r.pick_n < a.high_n and r.residual == pytest.approx(r.pick_n - a.arrival_n, abs=2e-6)


def test_locations(spark, sf):
    """The estimators on the collected map of each event, and the marks that any location must bear."""
    from wavestack.plans import queries, stage_queries

    g = stage_queries.GRID
    got = {r.event: r for r in QUERIES["locate_spline_gaussian"](spark, sf).collect()}
    maps: dict = {}
    for r in QUERIES["locate_maps"](spark, sf).collect():
        maps.setdefault(r.event, np.zeros(g.nodes))[r.node] = r.c
    assert got and set(got) == set(maps)
    for event, values in maps.items():
        top = np.array(np.unravel_index(values.argmax(), g.counts))
        spline = np.array([got[event][f"spline_{c}"] for c in "xyz"])
        assert np.abs(spline - top).max() <= 2.0
        if ((top < 2) | (top > np.array(g.counts) - 3)).any():
            assert np.allclose(spline, top)
        fitted = kernels.gaussian_location(kernels.smooth_3d(values.reshape(g.counts)))
        if fitted:
            assert np.allclose([got[event][f"gau_{c}"] for c in "xyz"], fitted[0], atol=1e-3)
    flat = QUERIES["locations"](spark, sf).collect()
    assert len({r.event for r in flat}) == len(flat) == queries._station_cells(spark, sf).select("event").distinct().count()
    assert all(0 <= r.cov_x <= 7 and 0 <= r.spline_x <= 7 and r.err_x >= 0 for r in flat)


def test_eikonal(spark, sf):
    """First arrivals obey the equation they solve: along each edge no later than its slowness allows, 0 at the source."""
    got: dict = {}
    for r in QUERIES["eikonal_tt"](spark, sf).collect():
        got.setdefault(r.station, np.zeros(64))[r.node] = r.tt
    speed = 2.0 + np.arange(8) / 10
    assert got
    for tt in got.values():
        tt = tt.reshape(8, 8)
        assert tt.min() == 0 and (tt == 0).sum() == 1
        assert (np.abs(np.diff(tt, axis=1)) <= 1 / speed[:, None] + 1e-6).all()
        assert (np.abs(np.diff(tt, axis=0)) <= 1 / np.minimum(speed[1:], speed[:-1])[:, None] + 1e-6).all()


def test_synthetic_noise(spark, sf):
    """The noise of the traces: repeatable, of the wanted size, without mean."""
    a, b = (QUERIES["synthetic_traces"](spark, sf) for _ in range(2))
    clean = QUERIES["synthetic_clean"](spark, sf).withColumnRenamed("value", "clean").withColumn("station", F.col("station").cast("string"))
    assert a.exceptAll(b).count() == 0
    noise = a.join(clean, ["station", "phase", "n"]).agg(F.avg(F.col("value") - F.col("clean")).alias("m"), F.stddev_pop(F.col("value") - F.col("clean")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert noise.n == a.count() and abs(noise.m) < 1e-3 and noise.s == pytest.approx(0.01, rel=0.1)


def test_cut_traces(spark, sf):
    cut = {(r.event_id, r.batch): r for r in QUERIES["cut_real"](spark, sf).collect()}
    sizes = {(r.event_id, r.batch): r["count"] for r in QUERIES["cut_waveforms"](spark, sf).groupBy("event_id", "batch").count().collect()}
    assert {k: len(r.samples) for k, r in cut.items()} == sizes and all(np.isfinite(r.samples).all() for r in cut.values())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
