"""Column functions: sample arithmetic, geometry, attenuation, text formats."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError, MagnitudeError

# Attenuation curves of the literature as (a, reference distance, b, level), for
# a * log10(d / reference) + b * (d - reference) + level.
CURVES = {
    "keir2006": (1.196997, 17.0, 0.001066, 2.0),
    "Danakil2017": (1.274336, 17.0, -0.000273, 2.0),
    "Greenfield2018_askja": (1.4406, 17.0, 0.003, 2.0),
    "Greenfield2018_bardarbunga": (1.2534, 17.0, 0.0032, 2.0),
    "Greenfield2018_comb": (1.1999, 17.0, 0.0016, 2.0),
    "Hutton-Boore": (1.11, 100.0, 0.00189, 3.0),
    "Langston1998": (0.776, 17.0, 0.000902, 2.0),
}
# The curve for the UK, a * log10(d) + b * d + c * exp(e * d) + level.
UK = (1.11, 0.00189, -1.16, -0.2, -2.09)
# Wood-Anderson poles by definition, and the common sensitivity.
WOOD_ANDERSON = {"rounded": (complex(-6.283185, -4.712), complex(-6.283185, 4.712)), "iris": (complex(-5.49779, 5.60886), complex(-5.49779, -5.60886))}
WOOD_ANDERSON_SENSITIVITY = 2080.0


def wood_anderson(definition: str = "rounded", convert: str = "DIS2VEL") -> dict:
    """Poles, zeros, gain and sensitivity; same-unit conversions have one more zero."""
    zeros = [0j] * (2 if convert in ("DIS2DIS", "VEL2VEL") else 1)
    return {"poles": list(WOOD_ANDERSON[definition]), "zeros": zeros, "gain": 1.0, "sensitivity": WOOD_ANDERSON_SENSITIVITY}


def time_to_sample(time: Column, rate: Column | float) -> Column:
    """Seconds to samples, half to even, the rate truncated to a whole number."""
    return F.rint(time * F.floor(rate if isinstance(rate, Column) else F.lit(rate))).cast("long")


def trim_to_sample(time: Column | float, rate: int) -> Column | float:
    """Seconds rounded up to a whole sample and down to a millisecond."""
    if isinstance(time, Column):
        return F.floor(F.ceil(time * rate) / rate * 1000) / 1000
    return int(math.ceil(time * rate) / rate * 1000) / 1000


def padded_span(timespan: float, pre: float, post: float, rate: int, taper: float = 0.06) -> tuple[float, float]:
    """(pre, post) pads grown by the taper of the whole padded span."""
    whole = timespan + pre + post
    return trim_to_sample(pre + math.ceil(whole * taper), rate), trim_to_sample(post + math.ceil(whole * taper), rate)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; members of a class are literal."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|.", pattern):
        out += {"*": ".*", "?": "."}.get(part, part if len(part) > 1 else re.escape(part))
    return f"^{out}$"


def event_id(time: Column) -> Column:
    """17 digits: date, time and truncated milliseconds."""
    return F.date_format(time, "yyyyMMddHHmmssSSS")


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def hypocentral(epicentral: Column, vertical: Column) -> Column:
    """Straight distance; zero becomes null."""
    return F.nullif(F.sqrt(epicentral * epicentral + vertical * vertical), F.lit(0.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2))))


def attenuation(distance: Column, curve) -> Column:
    """-log A0 of a named curve, or of a function from Column to Column."""
    if callable(curve):
        return curve(distance)
    if curve == "UK":
        a, b, c, e, level = UK
        return a * F.log10(distance) + b * distance + c * F.exp(e * distance) + level
    if curve not in CURVES:
        raise MagnitudeError(f"unknown attenuation curve {curve}")
    a, reference, b, level = CURVES[curve]
    return a * F.log10(distance / reference) + b * (distance - reference) + level


def gaussian_1d(x: Column, height: Column | float, mean: Column | float, sigma: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return lit(height) * F.exp(-F.pow(x - lit(mean), 2) / (2 * F.pow(lit(sigma), 2)))


def gaussian_3d(at: list[Column], height: float, mean: tuple[float, ...], sigma: tuple[float, ...]) -> Column:
    """A Gaussian along three axes without correlation."""
    power = F.lit(0.0)
    for x, m, s in zip(at, mean, sigma, strict=True):
        power = power + F.pow(x - F.lit(m), 2) / (2 * s * s)
    return height * F.exp(-power)


def general(x: Column, digits: int) -> Column:
    """``%.{digits}g`` with trailing zeros dropped, as Python's ``format`` writes it."""
    if digits < 1:
        raise ConfigError("at least one digit")

    # the exact binary value decides the last digit, which no formatter of Spark looks at
    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, f".{digits}g") for v in values.to_pylist()], pa.string())

    return text(x.cast("double"))


def fixed_point(x: Column, factor: float, most: float = 21474.0) -> Column:
    """Value clipped and kept as a whole number of 1 / factor, half to even."""
    return F.rint(F.least(x, F.lit(most)) * factor).cast("int")
