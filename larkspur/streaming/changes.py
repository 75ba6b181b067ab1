"""Change feeds as Structured Streaming.

Each function takes a streaming DataFrame of change rows and returns a
streaming DataFrame, or starts a query; the rules are those of the batch
operators.  Files give no order across batches, so stateful rules order the
rows of a batch by time and decide rows that come late as if they came now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators import inbox, mutations
from larkspur.operators.feed import KINDS
from larkspur.streaming.store import Store, for_each, latest_wins


def feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Rows of files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def subscribe(changes: DataFrame, kind: str, column: str | None = None, value: object = None) -> DataFrame:
    """Changes of one kind (INSERT, UPDATE), and of one value of a column if asked for."""
    rows = changes.where(F.col("change") == kind)
    return rows if column is None else rows.where(F.col(column) == value)


def inserted_posts(changes: DataFrame, profiles: DataFrame) -> DataFrame:
    """New posts, each id once for good, with their author."""
    rows = subscribe(changes, "INSERT").dropDuplicates(["id"])
    return rows.join(profiles.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def notifications(reactions: DataFrame, posts: DataFrame) -> DataFrame:
    """Notifications to owners, a stream against a table."""
    return inbox.fan_out(reactions, posts)


def unread_counts(rows: DataFrame) -> DataFrame:
    """Unread notifications of each user by their own flag; for output mode update or complete (``live.unread`` has marks that reset)."""
    return rows.groupBy("user_id").agg(F.count(F.when(~F.col("read"), 1)).alias("unread"))


def merge_counters(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Counters that never go below 0, kept as sum and deepest point, so that a batch needs nothing of what came before but these two.

    state: key, total, low (at most 0); batch: key, seq, delta; batches come in
    order of seq.  The counter is total - low.
    """
    walk = batch.withColumn("sum", F.sum("delta").over(Window.partitionBy("key").orderBy("seq")))
    new = walk.groupBy("key").agg(F.sum("delta").alias("more"), F.least(F.lit(0), F.min("sum")).alias("dip"))
    total, more = F.coalesce("total", F.lit(0)), F.coalesce("more", F.lit(0))
    low = F.least(F.coalesce("low", F.lit(0)), total + F.coalesce("dip", F.lit(0)))
    return state.join(new, "key", "full_outer").select("key", (total + more).cast("long").alias("total"), low.cast("long").alias("low"))


def merge_reactions(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Counters of posts by kind, moved by the batch's rows (post_id, kind, change: INSERT or DELETE); rows may come in any order."""
    step = F.when(F.col("change") == "DELETE", -1).otherwise(1)
    new = batch.groupBy("post_id").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, step)), F.lit(0)).alias(f"more_{k}") for k in KINDS))
    moved = [(F.coalesce(f"{k}s_count", F.lit(0)) + F.coalesce(f"more_{k}", F.lit(0))).cast("long").alias(f"{k}s_count") for k in KINDS]
    return state.join(new, "post_id", "full_outer").select("post_id", *moved)


def settle(batch: DataFrame, epoch: int, seen: Store, users: Store) -> int:
    """A batch of payment events (event_id, received, user_id, event_name, status, period_end): each event id counts once, for good; users get their last event.

    Ids that an earlier epoch has are dropped before anything else; a batch that
    failed between the two commits finds its own ids again.  An event that comes out of
    order doesn't displace a later one.  Returns how many buckets of ids were read.
    """
    first = mutations.latest(batch.where("event_id is not null"), ["event_id"], [F.col("received")])
    fresh, read = seen.unseen(first, epoch)
    fresh = fresh.persist()
    try:
        seen.append(fresh.select("event_id", F.lit(epoch).cast("long").alias("epoch")), epoch)
        users.merge(fresh.where("user_id is not null"), epoch, latest_wins(["user_id"], [F.desc("received"), F.desc("event_id")]))
    finally:
        fresh.unpersist()
    return read


SEEN, USERS = "event_id string, epoch long", "user_id long, event_id string, received long, event_name string, status string, period_end timestamp_ntz"


def payments(events: DataFrame, seen: Store, users: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Subscriptions by payment events; ``subscriptions.tiers`` of what users has is the subscription of each."""
    return for_each(events, lambda batch, epoch: settle(batch, epoch, seen, users), checkpoint, trigger=trigger)


def into_table(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch is applied to the rows of a keyed table that share a bucket with it; other buckets aren't read or written."""
    return store.follow(changes, apply, checkpoint, trigger=trigger)


class Windowed(StatefulProcessor):
    """Anchored rate windows for each user: state is the open window's start and the events allowed in it."""

    def __init__(self, limit: int, window_us: int, inclusive: bool = False):
        self.limit, self.window_us, self.inclusive = limit, window_us, inclusive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        start, n = self.window.get() if self.window.exists() else (None, 0)
        allowed = []
        for us in events["us"]:
            fresh = start is None or us - start > self.window_us or (self.inclusive and us - start == self.window_us)
            if fresh:
                start, n = us, 0
            allowed.append(bool(n < self.limit))
            n += allowed[-1]
        self.window.update((int(start), int(n)))
        yield pd.DataFrame({"user_id": key[0], "event_id": events["event_id"], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_window(events: DataFrame, limit: int, window_us: int, inclusive: bool = False) -> DataFrame:
    """user_id, event_id, allowed; needs the RocksDB state store."""
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Windowed(limit, window_us, inclusive), "user_id long, event_id long, allowed boolean", "append", "none")
