"""Substring search with an index of trigrams.

``postings`` lists under every three characters the rows that hold them; a
search intersects the lists of its own trigrams and verifies the few rows left
on their whole texts, so its result is the scan's.  Searches without three
characters in a row, between wildcards, have no trigrams and scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
_EVERY_THREE = r"(?s)(?=(...))"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(items: DataFrame, key: str, column: Column) -> DataFrame:
    """gram, key, bucket: each trigram of each item's text once; null and shorter texts have none."""
    grams = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(_EVERY_THREE), F.lit(1)))
    return items.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).select("gram", "key", _bucket(F.col("gram")).alias("bucket"))


def write(listed: DataFrame, path: str) -> None:
    """The postings as a table whose folders are buckets of trigrams; a bucket's frequent trigrams lie in several files."""
    listed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def grams_of(pattern: str) -> list[str]:
    """Trigrams that a text must hold to be like a pattern (``%`` and ``_`` are wildcards, a backslash escapes one)."""
    literal = re.sub(r"\\(.)|[%_]", lambda m: m[1] or "\0", pattern, flags=re.S).lower()
    return sorted({run[i : i + 3] for run in literal.split("\0") for i in range(len(run) - 2)})


def candidates(listed: DataFrame, grams: list[str]) -> DataFrame:
    """key of the items that hold all trigrams; only their buckets are read."""
    buckets = listed.sparkSession.range(1).select(*(_bucket(F.lit(g)) for g in grams)).first()
    asked = listed.where(F.col("bucket").isin(*set(buckets)) & F.col("gram").isin(*grams))
    return asked.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("key")


def like(items: DataFrame, listed: DataFrame, key: str, column: Column, pattern: str) -> DataFrame:
    """items whose text is like the pattern, whatever the case."""
    grams = grams_of(pattern)
    few = items.join(candidates(listed, grams).withColumnRenamed("key", key), key, "left_semi") if grams else items
    return few.where(column.ilike(pattern))
