"""Constraints as checks, since files enforce none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once (among the rows of a partial index, if ``where`` is given)."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n: rows that break each check, in one pass; a null result isn't a violation."""
    counted = df.agg(*(F.count(F.when(~c, 1)).alias(name) for name, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks))).alias("r")).select("r.*")


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNotNull() != b.isNotNull()


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose foreign key, if set, has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Null or missing columns filled at ingest."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
