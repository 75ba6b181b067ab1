"""Connected components on Spark, by repeated contraction.

Each round every node points to the smallest node among itself and its
neighbours; pointers are followed to their ends by doubling; the edges are
rewritten to those ends and the ones inside a group vanish.  Each round at
least halves the nodes that still have an edge, so a few rounds suffice.  All
state is in tables of the shared folder: nothing is gathered on the driver but
counts, and a lost executor costs only its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import discard, join_wide, materialise


def _follow(pointers: DataFrame) -> DataFrame:
    """node, next: each pointer (node > next) followed to its end."""
    current = materialise(pointers, "pointers")
    while True:
        onward = current.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        stepped = materialise(join_wide(current, onward, "next", "left").select("node", F.coalesce("beyond", "next").alias("next"), F.col("beyond").isNotNull().alias("moved")), "pointers")
        discard(current)
        current = stepped
        if stepped.where("moved").isEmpty():
            return stepped


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b) but the roots; the root is one node of the component, the same for all of it."""
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, roots = materialise(ordered(edges), "edges"), None
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("next"))
        followed = _follow(lowest.where("node <> next"))
        ends = followed.select("node", F.col("next").alias("root"))
        later = ends.select(F.col("node").alias("root"), F.col("root").alias("final"))
        now = ends if roots is None else join_wide(roots, later, "root", "left").select("node", F.coalesce("final", "root").alias("root")).union(ends)
        of_a, of_b = ends.select(F.col("node").alias("a"), F.col("root").alias("root_a")), ends.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved = join_wide(join_wide(rest, of_a, "a", "left"), of_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        now, left = materialise(now, "roots"), materialise(ordered(moved), "edges")
        discard(rest, followed, *([] if roots is None else [roots]))
        rest, roots = left, now
    return rest.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
