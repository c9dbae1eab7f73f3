"""Numerical kernels against closed forms and published vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wavestack.config import Grid, Onset, Trigger
from wavestack.errors import ConfigError, TravelTimeError
from wavestack.functions import kernels, scalar


def test_butterworth_gain():
    sections = kernels.butterworth(2, 2.0, 16.0, 100.0)
    assert kernels.section_gain(sections, 2.0, 100.0) == pytest.approx(math.sqrt(0.5), abs=1e-6)
    assert kernels.section_gain(sections, 16.0, 100.0) == pytest.approx(math.sqrt(0.5), abs=1e-6)
    assert kernels.section_gain(kernels.butterworth(4, 5.0, None, 100.0), 5.0, 100.0) == pytest.approx(math.sqrt(0.5), abs=1e-6)
    assert kernels.section_gain(kernels.butterworth(3, None, 5.0, 100.0), 5.0, 100.0) == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_filter_keeps_band():
    t = np.arange(2000) / 100
    low, mid = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 8 * t)
    out = kernels.zero_phase(kernels.butterworth(4, 4.0, 16.0, 100.0), low + mid)
    assert np.abs(out[400:1600] - mid[400:1600]).max() < 0.02


def test_envelope_of_a_tone():
    x = 3 * np.cos(2 * np.pi * 10 * np.arange(500) / 100)
    assert np.allclose(kernels.envelope(x), 3, atol=1e-6)


def test_detrend_and_decimate():
    assert np.allclose(kernels.detrend(2.0 + 0.5 * np.arange(50)), 0, atol=1e-9)
    assert len(kernels.decimate(np.random.default_rng(0).normal(size=100), 100, 50)) == 50


def test_gaussian_fit():
    t = np.arange(40) / 50
    got = kernels.fit_gaussian(t, 2.5 * np.exp(-((t - 0.41) ** 2) / (2 * 0.1**2)), (2.0, 0.4, 0.05))
    assert got == pytest.approx((2.5, 0.41, 0.1), abs=1e-6)
    assert kernels.fit_gaussian(t[:2], t[:2], (1, 1, 1)) is None


def test_peak_to_trough():
    x = np.array([0, 1, 0, -2, 0, 0.5, 0]) / 1000
    amp, freq, time = kernels.peak_to_trough(x, 100.0)
    assert (amp, freq, time) == pytest.approx((1.5, 25.0, 0.02))
    assert kernels.peak_to_trough(np.arange(5.0), 100.0) is None


def test_locations_of_a_gaussian_blob():
    g = np.stack(np.meshgrid(*[np.arange(21)] * 3, indexing="ij"), -1)
    blob = np.exp(-((g - np.array([10.3, 9.8, 10.1])) ** 2).sum(-1) / (2 * 2.0**2))
    assert kernels.spline_location(blob) == pytest.approx((10.3, 9.8, 10.1), abs=0.11)
    centre, widths = kernels.gaussian_location(kernels.smooth_3d(blob))
    assert centre == pytest.approx([10.3, 9.8, 10.1], abs=0.1)
    assert (widths > 0).all()
    corner = np.zeros((8, 8, 8))
    corner[0, 0, 0] = 1
    assert kernels.spline_location(corner) == (0.0, 0.0, 0.0)


def test_eikonal_against_straight_rays():
    tt = kernels.sweep_eikonal(np.full((15, 15, 15), 2.0), (1.0, 1.0, 1.0), (7, 7, 7))
    g = np.stack(np.meshgrid(*[np.arange(15)] * 3, indexing="ij"), -1)
    true = np.sqrt(((g - 7) ** 2).sum(-1)) / 2
    assert tt[7, 7, 7] == 0
    assert np.abs(tt - true).max() < 0.8
    assert np.allclose(tt[7, 7, :], true[7, 7, :], atol=1e-6)


def test_eikonal_sweeps_until_nothing_changes():
    speed = np.full((301, 7, 1), 1e-4)
    speed[::2] = 1.0
    for i in range(1, 301, 2):  # a corridor that turns at alternating ends
        speed[i, 0 if i % 4 == 1 else 6] = 1.0
    tt = kernels.sweep_eikonal(speed, (1.0, 1.0, 1.0), (0, 6, 0))[:, :, 0]
    slow = 1 / speed[:, :, 0]
    for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
        assert (tt[a] <= tt[b] + slow[a] + 1e-6).all() and (tt[b] <= tt[a] + slow[b] + 1e-6).all()
    with pytest.raises(TravelTimeError):
        kernels.sweep_eikonal(speed, (1.0, 1.0, 1.0), (0, 6, 0), rounds=2)


def test_vincenty():
    assert kernels.vincenty(0, 0, 0, 1) == pytest.approx(111.319491, abs=1e-5)
    assert kernels.vincenty(10, 20, 10, 20) == 0
    assert np.isnan(kernels.vincenty(0.0, 0.0, 0.5, 179.7))
    assert kernels.vincenty(np.array([0.0, 10.0]), 0.0, 0.0, 1.0) == pytest.approx([111.319491, 1111.2], abs=5.0)


def test_response_roundtrip():
    x = np.random.default_rng(1).normal(size=512)
    flat = {"poles": [], "zeros": [], "gain": 4.0}
    shaped = kernels.detrend(x) * kernels.cosine_taper(len(x))
    assert np.allclose(kernels.apply_response(x, 100.0, None, flat), 4 * shaped, atol=1e-9)


def test_lanczos_whole_shift():
    x = np.random.default_rng(2).normal(size=200)
    assert np.allclose(kernels.lanczos_shift(x, 1.0)[30:150], x[31:151], atol=1e-9)


def test_config():
    with pytest.raises(ConfigError):
        Trigger(marginal=3.0, interval=4.0)
    with pytest.raises(ConfigError):
        Onset(rate=20)
    with pytest.raises(ConfigError):
        Grid((0, 0, 0), (1, 0, 1), (2, 2, 2))
    grid, first = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (10, 9, 8)).decimated((2, 2, 2))
    assert grid.counts == (5, 5, 4) and first == (0, 0, 0)
    assert Onset().samples("P") == (11, 51)


def test_scalar_helpers():
    assert scalar.trim_to_sample(1.234567, 50) == 1.24
    assert scalar.glob_regex("*[N,E,1,2]") == "^.*[N,E,1,2]$"
    assert len(scalar.wood_anderson(convert="VEL2VEL")["zeros"]) == 2


def test_filter_against_its_recurrence():
    rng = np.random.default_rng(3)
    sections = kernels.butterworth(3, 2.0, 9.0, 50.0)
    x = rng.normal(size=(3, 333))
    for steady in (False, True):
        got = kernels.sos_filter(sections, x, steady)
        for row, out in zip(x, got, strict=True):
            y = row.tolist()
            for b0, b1, b2, a0, a1, a2 in sections.tolist():
                z1 = z2 = 0.0
                if steady:
                    level = (b0 + b1 + b2) / (a0 + a1 + a2)
                    z2 = (b2 - a2 * level) / a0 * y[0]
                    z1 = (b1 - a1 * level) / a0 * y[0] + z2
                for i, v in enumerate(y):
                    y[i] = b0 / a0 * v + z1
                    z1, z2 = (b1 * v - a1 * y[i]) / a0 + z2, (b2 * v - a2 * y[i]) / a0
            assert np.allclose(out, y, atol=1e-9)
    assert kernels.sos_filter(sections, np.zeros(0)).shape == (0,)


def test_shift_of_rows():
    x = np.random.default_rng(4).normal(size=(2, 90))
    got = kernels.lanczos_shift(x, np.array([0.3, -0.4]))
    assert np.allclose(got[0], kernels.lanczos_shift(x[0], 0.3)) and np.allclose(got[1], kernels.lanczos_shift(x[1], -0.4))


def test_refine():
    assert np.allclose(kernels.refine(np.array([0.0, 3.0, 6.0]), 3), np.arange(7))
    assert kernels.refine(np.array([2.0]), 3).tolist() == [2.0]


def test_flat_map_has_no_gaussian():
    assert kernels.gaussian_location(np.ones((9, 9, 9))) is None
