"""Synthetic traces: a Gaussian-derivative wavelet at each arrival, attenuated, with repeatable noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import attenuation


def traces(arrivals: DataFrame, rate: int, samples: int, magnitude: float, frequency: float, noise: float = 0.01, curve: str = "Hutton-Boore", speed: float = 1.7) -> DataFrame:
    """(station, phase, n, value) from arrivals (station, phase, tt).

    Noise is a hash of station, phase and sample, so a run gives the same traces again on any cluster.
    """
    sigma = 1 / (2 * math.pi * frequency)
    n = arrivals.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("n") / rate - F.col("tt")
    wavelet = -t * F.exp(-(t * t) / (2 * sigma**2)) / sigma * math.exp(0.5)
    size = F.pow(F.lit(10.0), F.lit(magnitude) - attenuation(F.greatest(F.col("tt") * speed, F.lit(1e-3)), curve))
    uniform = lambda salt: (F.pmod(F.xxhash64("station", "phase", "n", F.lit(salt)), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    return n.select("station", "phase", "n", (size * wavelet + noise * normal).alias("value"))


def to_zne(l: Column, q: Column, t: Column, incidence: Column, back_azimuth: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Ray components (along it, across it in its plane, across its plane) as vertical, north and east; angles in radians."""
    si, ci, sb, cb = F.sin(incidence), F.cos(incidence), F.sin(back_azimuth), F.cos(back_azimuth)
    level = q * ci - l * si
    return l * ci + q * si, level * cb + t * sb, level * sb - t * cb
