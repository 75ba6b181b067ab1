"""Search over questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text


def find(items: DataFrame, query: str, category: str = "all", k: int | None = None) -> DataFrame:
    """Items (id, cat, q, a) whose folded question or answer holds the folded query."""
    needle = text.fold_search(F.lit(query))
    in_category = items if category == "all" else items.where(F.col("cat") == category)
    found = in_category.where(F.contains(text.fold_search(F.col("q")), needle) | F.contains(text.fold_search(F.col("a")), needle))
    return found.orderBy("id").limit(k) if k else found


def popular(items: DataFrame, k: int = 5) -> DataFrame:
    return items.where(F.coalesce("popular", F.lit(False))).orderBy("id").limit(k)


def flatten_groups(groups: DataFrame) -> DataFrame:
    """One row for each question below a group (q, subs)."""
    return groups.select(F.col("q").alias("group"), F.posexplode("subs").alias("place", "sub")).select("group", "place", "sub.q", "sub.a")
