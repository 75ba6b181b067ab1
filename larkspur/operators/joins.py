"""Joins that choose by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def join_by_size(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """right is broadcast only if it is counted to have at most ``rows`` rows; else Spark plans the join."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def join_wide(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join two tables that grow by sorted shuffles: neither side is broadcast, however small Spark takes what an explode makes of it to be."""
    return left.hint("merge").join(right.hint("merge"), on, how)
