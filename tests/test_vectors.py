"""Published vectors: short signals and the values that onsets, thresholds and smoothing must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wavestack.config import Trigger
from wavestack.operators import onset, trigger

# Signals and results.
RAMP = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
CLASSIC = [1.0, 1.0, 1.5, 1.25, 21 / 18, 27 / 24]
CENTRED = [1.0, 1.0, 3.5, 2.25, 1.0, 1.0]
STEPS = [1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 4.0, 1.0]
MAD = [1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 5.0]
MEDIAN = [2.0, 2.0, 2.0, 2.0, 9.0, 9.0, 9.0, 9.0]
PULSE = [1.0, 1.0, 1.0, 5.0, 1.0, 1.0, 1.0]
SMOOTH = [1.01826277, 1.21596451, 1.96788578, 2.59577388, 1.96788578, 1.21596451, 1.01826277]


def _series(spark, values):
    return spark.createDataFrame([("d", i, v, v) for i, v in enumerate(values)], "batch string, n long, coa double, coa_n double")


@pytest.mark.parametrize(("method", "want"), [("classic", CLASSIC), ("centred", CENTRED)])
def test_onsets(spark, method, want):
    got = onset.METHODS[method](_series(spark, RAMP), 2, 3, ["batch"], "coa").orderBy("n").collect()
    assert [r.onset for r in got] == pytest.approx(want)


def test_recursive_onset(spark):
    """Against the recurrence itself, sample by sample."""
    rows = [("a", [float((i * 7) % 5) for i in range(150)]), ("b", [0.0] * 10), ("c", []), ("d", None), ("e", [float(i % 3) for i in range(150)])]
    got = {r.id: r.onset for r in onset.recursive(spark.createDataFrame(rows, "id string, samples array<double>"), 3, 9).collect()}
    for name, x in rows:
        if x is None:
            assert got[name] is None
            continue
        sta = lta = 0.0
        want = [1.0] * min(1, len(x))
        for v in x[1:]:
            sta, lta = v / 3 + sta * 2 / 3, v / 9 + lta * 8 / 9
            want.append(1.0 if len(want) < 9 or lta < 2.2e-308 else sta / lta)
        assert got[name] == pytest.approx(want)


@pytest.mark.parametrize(("method", "factor", "want"), [("mad", 1 / 1.4826, MAD), ("median_ratio", 2.0, MEDIAN)])
def test_thresholds(spark, method, factor, want):
    config = Trigger(method=method, multiplier=factor, window=4.0)
    got = trigger.threshold(_series(spark, STEPS), config, 1.0).orderBy("n").collect()
    assert [r.threshold for r in got] == pytest.approx(want)


def test_smoothing(spark):
    got = trigger.smooth(_series(spark, PULSE), 0.2 * 5.0, ["coa", "coa_n"]).orderBy("n").collect()
    assert [r.coa for r in got] == pytest.approx(SMOOTH, abs=1e-8) and [r.coa_n for r in got] == pytest.approx(SMOOTH, abs=1e-8)


def test_smoothing_of_batches_shorter_than_the_kernel(spark):
    """Mirrored again and again: the weights still add up to one."""
    rows = _series(spark, [3.0, 3.0]).unionByName(_series(spark, [2.0]).withColumn("batch", F.lit("e")))
    got = trigger.smooth(rows, 4.0, ["coa"]).collect()
    assert {(r.batch, round(r.coa, 9)) for r in got} == {("d", 3.0), ("e", 2.0)}
