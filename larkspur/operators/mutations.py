"""Writes: each takes a table's state and a batch of changes and returns the new state.

Parquet has no row updates; a new state is written whole or by partition, and
in streams these functions run in ``foreachBatch``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(rows, allowMissingColumns=True)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Changed keys take the values that the last change sets, nulls too; columns that changes lack keep theirs; new keys are added."""
    values = [c for c in state.columns if c not in keys]
    new = latest(changes, keys, order).select(*keys, F.lit(True).alias("_changed"), *(F.col(c).alias(f"_new_{c}") for c in values if c in changes.columns))
    return state.join(new, keys, "full_outer").select(*keys, *(F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in values))


def insert_if_absent(state: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of keys that aren't there yet are added, the earliest of each key."""
    return state.unionByName(latest(rows, keys, order).join(state.select(*keys), keys, "left_anti"))


def append_events(events: DataFrame, batch: DataFrame) -> DataFrame:
    """Events whose id was seen before are duplicates and change nothing."""
    return insert_if_absent(events, batch, ["event_id"], [F.col("received")])


def update_where(state: DataFrame, predicate: Column, values: dict[str, Column], as_of: Column | None = None) -> DataFrame:
    """Set columns where the predicate holds (not where it is null), and updated_at if ``as_of`` is given."""
    hit = F.coalesce(predicate, F.lit(False))
    values = values if as_of is None else values | {"updated_at": as_of}
    return state.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(state: DataFrame, predicate: Column) -> DataFrame:
    return state.where(~F.coalesce(predicate, F.lit(False)))


def delete_cascade(tables: dict[str, DataFrame], root: str, predicate: Column, children: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Delete from ``root`` and, along (child, parent, foreign key) in order, every row that refers to a deleted row's id."""
    gone = {root: tables[root].where(F.coalesce(predicate, F.lit(False))).select("id")}
    for child, parent, key in children:
        if parent in gone:
            hit = tables[child].join(gone[parent].withColumnRenamed("id", key), key, "left_semi").select("id")
            gone[child] = gone[child].union(hit).distinct() if child in gone else hit
    return {name: df.join(gone[name], "id", "left_anti") if name in gone else df for name, df in tables.items()}


def set_null(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The foreign key becomes null where its parent no longer exists."""
    known = parents.select(F.col("id").alias("_id"))
    return child.join(known, child[key] == known["_id"], "left").withColumn(key, F.when(F.col("_id").isNull(), None).otherwise(F.col(key))).drop("_id")


def reaction_state(events: DataFrame) -> DataFrame:
    """post_id, user_id, kind: where each pair stands after its toggles, in order; like and dislike exclude each other.

    The last event of a pair decides: the same kind twice takes it back.  So
    only the length of the run of equal kinds at the end matters.
    """
    pair = Window.partitionBy("post_id", "user_id").orderBy("seq")
    switched = F.coalesce(F.lag("kind").over(pair) != F.col("kind"), F.lit(True)).cast("int")
    runs = events.withColumn("run", F.sum(switched).over(pair))
    ends = runs.groupBy("post_id", "user_id", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("n"))
    last = ends.groupBy("post_id", "user_id").agg(F.max_by(F.struct("kind", "n"), "run").alias("last"))
    return last.where("last.n % 2 = 1").select("post_id", "user_id", "last.kind")


def keep_blob(paths: DataFrame, folder: Column, keep: Column) -> DataFrame:
    """All paths outside the folder, and inside it only the one to keep."""
    return paths.where(~F.col("path").startswith(folder) | (F.col("path") == keep))


def merge_missing(local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Local rows win; server rows of other keys are added."""
    return local.unionByName(server.join(local.select(key), key, "left_anti"))


def overlay(*layers: DataFrame, key: str) -> DataFrame:
    """Keyed rows, later layers winning."""
    stacked = reduce(lambda a, b: a.unionByName(b), (x.withColumn("_layer", F.lit(i)) for i, x in enumerate(layers)))
    return latest(stacked, [key], [F.desc("_layer")]).drop("_layer")


def sign_up(profiles: DataFrame, subscriptions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A profile and a free subscription for each new user."""
    new = users.join(profiles.select("id"), "id", "left_anti")
    free = new.select(F.col("id").alias("user_id"), F.lit("free").alias("tier"), F.lit("inactive").alias("status"))
    return profiles.unionByName(new.withColumn("role", F.lit("student")), allowMissingColumns=True), subscriptions.unionByName(free.join(subscriptions.select("user_id"), "user_id", "left_anti"), allowMissingColumns=True)
