"""Vectorised functions for formulae that iterate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from . import kernels


@F.pandas_udf("double")
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """WGS84 distance in km; null near antipodes."""
    return pd.Series(kernels.vincenty(lat1.to_numpy(), lon1.to_numpy(), lat2.to_numpy(), lon2.to_numpy()), dtype="float64")
