"""The general read builder: equality matches, conditional filters, cardinality, files by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.ingest import key_valid


def match(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows that equal every value; a null value asks for null."""
    conditions = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items()]
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def is_in(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is among the values: a short list as a filter, a table as a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin([v for v in dict.fromkeys(values) if v not in (None, "")]))


def page(df: DataFrame, order: list[Column], k: int, condition: Column | None = None) -> DataFrame:
    """The first k rows in order, of those that meet the condition, whichever came first in the call."""
    return (df if condition is None else df.where(condition)).orderBy(*order).limit(k)


def maybe_single(df: DataFrame) -> Row | None:
    """The only row, None if there is none; more than one is an error.  At most two rows reach the driver."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def single(df: DataFrame) -> Row:
    """The only row; none, or more than one, is an error."""
    row = maybe_single(df)
    if row is None:
        raise ValueError("no row")
    return row


def files(spark: SparkSession, root: str, catalogue: DataFrame) -> DataFrame:
    """path, key, length, content of the stored files whose key is in the catalogue and has a safe shape."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = root.rstrip("/").rpartition(":")[2].replace("//", "/")
    keyed = stored.withColumn("key", F.regexp_replace(F.regexp_extract("path", f"{place}/(.*)$", 1), "^/+", ""))
    return keyed.where(key_valid(F.col("key"))).join(catalogue.select("key").distinct(), "key", "left_semi").select("path", "key", "length", "content")
