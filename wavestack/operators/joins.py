"""Joins whose small side is broadcast only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def with_small(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` if it has at most ``most`` rows (counted no further), else shuffles both."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)
