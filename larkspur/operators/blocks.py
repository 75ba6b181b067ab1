"""Counts and numbers along an order, without one task for a whole key.

The order of all rows is cut into ranges by approximate quantiles, so a block (a
key's rows of one range) holds at most about one in ``RANGES`` of all rows, even
if one key has nearly all of them.  What comes before a block is a running sum over
its key's blocks, at most ``RANGES`` of them; the rest is a window within the block.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def cuts(rows: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Where the values of a numeric column are cut; fewer cuts if values repeat."""
    return sorted(set(rows.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))


def ranged(rows: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """rows with _range: how many bounds are at most the value, found by halving them; nulls are last."""
    if not bounds:
        return rows.withColumn("_range", F.lit(0.0))
    placed = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=column, outputCol="_range", handleInvalid="keep").transform(rows)
    return placed.withColumn("_range", F.coalesce("_range", F.lit(float(len(bounds) + 1))))


def _with_sums(blocks: DataFrame, placed: DataFrame, keys: list[str], amount: Column, name: str, newest_first: bool = False) -> DataFrame:
    """blocks with ``name``: the amounts of ``placed`` in the ranges of the same keys that come before."""
    order = F.desc("_range") if newest_first else F.asc("_range")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return blocks.join(sums, same).drop("_at", *(f"_{k}" for k in keys))


def numbered(rows: DataFrame, keys: list[str], by: str, name: str, ranges: int = RANGES) -> DataFrame:
    """rows with ``name``: their number from 1 within their keys, by a numeric column whose values differ there."""
    placed = ranged(rows, by, cuts(rows, by, ranges))
    own = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(by)))
    made = _with_sums(own, placed, keys, F.lit(1), "_before")
    return made.withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_range", "_row", "_before")


def count_later(marks: DataFrame, rows: DataFrame, keys: list[str], at: str, amount: str, name: str, bounds: list[float]) -> DataFrame:
    """marks with ``name``: the summed ``amount`` of the rows with the same keys that come after the mark."""
    columns = [*keys, at]
    both = marks.withColumns({"_amount": F.lit(0).cast("long"), "_mark": F.lit(True)}).unionByName(rows.select(*columns, F.col(amount).cast("long").alias("_amount"), F.lit(False).alias("_mark")), allowMissingColumns=True)
    placed = ranged(both, at, bounds)
    newest = Window.partitionBy(*keys, "_range").orderBy(F.desc(at), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("_within", F.sum("_amount").over(newest)).where("_mark")
    made = _with_sums(own, placed, keys, F.col("_amount"), "_before", newest_first=True)
    return made.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before", "_amount", "_mark")
