"""Queries that run a stream of the given tables to its end and read the state it leaves.

A table's rows are written as files to the shared folder, as a feed would bring
them, and streamed in several micro-batches: in no order where the operator
takes any, in slices one after another where the feed has an order.  The state
lies in keyed stores in the shared folder; the files go once they are streamed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators import subscriptions
from larkspur.plans import feed_queries, member_queries
from larkspur.sources import tables as t
from larkspur.streaming import changes, live
from larkspur.streaming.store import Store, latest_wins, shared_path

FILES, FILES_PER_BATCH, SLICES = 6, 2, 3
#: Rows of a file of the feed: larger tables come in more files, and in as many batches, so that no task reads, sorts or caches more.
FILE_ROWS = 100_000
#: Longer than the tables' time, so that files in no order lose nothing to the watermark and no session expires.
ALL_TIME = "4000 days"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _streamed(rows: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], slices: list[Column] | None = None) -> None:
    """Stream rows as files, all of them in batches of some files or each slice as a batch, until all are read; start(stream, checkpoint)."""
    spark = rows.sparkSession
    feed, checkpoint = shared_path(spark, "feed"), shared_path(spark, "stream")
    times = max(1, -(-rows.count() // (FILES * FILE_ROWS)))
    for part in slices or [F.lit(True)]:
        rows.where(part).repartition(FILES * times).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", (FILES if slices else FILES_PER_BATCH) * times).parquet(feed)
        start(stream, checkpoint).awaitTermination()
    _delete(spark, feed)
    _delete(spark, checkpoint)


def _by_thirds(rows: DataFrame, column: str) -> list[Column]:
    bounds = rows.approxQuantile(column, [i / SLICES for i in range(1, SLICES)], 0.01)
    edges = [float("-inf"), *bounds, float("inf")]
    return [(F.col(column) > a) & (F.col(column) <= b) for a, b in zip(edges, edges[1:], strict=False)]


def _replaced(*keys: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda state, batch: state.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch.select(*state.columns))


def live_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread badges: sign-up events are read marks, all others notifications."""
    rows = t.events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("mark"))
    store = Store(shared_path(spark, "unread"), live.WAITING, ("user_id",))
    _streamed(rows, lambda stream, at: store.follow(stream, live.merge_unread, at))
    return live.unread_of(store.read(spark))


def live_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks by runs of days that events in no order extend, join or begin."""
    store = Store(shared_path(spark, "streaks"), live.RUNS, ("user_id",))
    _streamed(t.events(spark, sf_dir).select("user_id", "ts"), lambda stream, at: store.follow(stream, live.merge_streaks, at))
    return live.streaks_of(store.read(spark))


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that no revocation has ended, from heartbeats in no order."""
    store = Store(shared_path(spark, "sessions"), live.SESSIONS, live.KEYS)
    _streamed(member_queries._beats(spark, sf_dir), lambda stream, at: store.follow(stream, live.merge_sessions(ALL_TIME), at))
    return subscriptions.active_sessions(store.read(spark)).select("user_id", "session_id", "last_active_at")


def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floored counters from three files of moves, each merged into sums and deepest points."""
    store = Store(shared_path(spark, "counters"), "key long, total long, low long", ("key",))
    _streamed(member_queries._moves(spark, sf_dir), lambda stream, at: store.follow(stream, changes.merge_counters, at), [F.col("seq") <= 2, F.col("seq").between(3, 4), F.col("seq") > 4])
    return store.read(spark).select("key", (F.col("total") - F.col("low")).alias("value"))


def live_reaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of posts while reactions come, go (those with an odd seq) and come again, in no order."""
    kinds = "post_id long, likes_count long, dislikes_count long, reposts_count long, comments_count long"
    acts = t.reactions(spark, sf_dir).select("post_id", "kind", F.explode(F.when(F.col("seq") % 2 == 1, F.array(*map(F.lit, ("INSERT", "DELETE", "INSERT")))).otherwise(F.array(F.lit("INSERT")))).alias("change"))
    store = Store(shared_path(spark, "reactions"), kinds, ("post_id",))
    _streamed(acts, lambda stream, at: store.follow(stream, changes.merge_reactions, at))
    posts = t.posts(spark, sf_dir).select(F.col("id").alias("post_id"))
    return posts.join(store.read(spark), "post_id", "left").fillna(0)


def live_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by payment events that come again much later: each id counts once for good."""
    seen, users = Store(shared_path(spark, "seen"), changes.SEEN, ("event_id",)), Store(shared_path(spark, "users"), changes.USERS, ("user_id",))
    rows = member_queries._payments(spark, sf_dir)
    _streamed(rows, lambda stream, at: changes.payments(stream, seen, users, at), _by_thirds(rows, "received"))
    return subscriptions.tiers(users.read(spark))


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as their inserts come in, each once for good, with their author from the table of members; updates among them change nothing here."""
    kind = F.explode(F.when(F.col("status") == "O", F.array(*map(F.lit, ("INSERT", "UPDATE", "INSERT")))).otherwise(F.array(F.lit("INSERT")))).alias("change")
    acts = t.posts(spark, sf_dir).select("id", "user_id", "created_at", kind)
    people = t.profiles(spark, sf_dir)
    store = Store(shared_path(spark, "posts"), "id long, user_id long, created_at timestamp, username string", ("id",))
    with live.with_rocksdb(spark):
        _streamed(acts, lambda stream, at: store.follow(changes.inserted_posts(stream, people), _replaced("id"), at))
    return store.read(spark)


def live_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each post while updates come in, in no order: the last one by seq, then by status, also when an earlier one comes late."""
    moves = t.reactions(spark, sf_dir).select(F.col("post_id").alias("id"), "seq", F.col("kind").alias("status"), F.lit("UPDATE").alias("change"))
    store = Store(shared_path(spark, "updates"), "id long, seq int, status string", ("id",))
    merge = latest_wins(["id"], [F.desc("seq"), F.desc("status")])
    _streamed(moves, lambda stream, at: store.follow(changes.subscribe(stream, "UPDATE").drop("change"), merge, at))
    return store.read(spark)


QUERIES = {f.__name__: f for f in (live_feed, live_posts, live_unread, live_streaks, live_sessions, live_counters, live_reaction_counts, live_subscriptions)}

_STREAKS = """with d as (select distinct user_id, (ts + interval 3 hours)::date as day from events),
i as (select *, day - row_number() over (partition by user_id order by day)::int as island from d),
r as (select user_id, island, count(*) - 1 as n, max(day) as last from i group by user_id, island)
select user_id, max_by(n, last)::bigint as current_streak, max(n)::bigint as longest_streak, max(last) as last_day from r group by user_id"""
ORACLE_SQL = {
    "live_feed": "select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, c_name as username from orders left join customer on c_custkey = o_custkey",
    "live_posts": """with r as (select l_orderkey as id, l_linenumber as seq, case when l_returnflag = 'R' then 'like' when l_returnflag = 'A' then 'dislike' when l_linenumber % 2 = 0 then 'repost' else 'comment' end as status from lineitem)
select id, max(seq) as seq, arg_max(status, (seq, status)) as status from r group by 1""",
    "live_unread": """select e.user_id, count(*) filter (event_type <> 'signup' and ts > coalesce(mark, timestamp '1900-01-01')) as unread
from events e left join (select user_id, max(ts) as mark from events where event_type = 'signup' group by user_id) m on m.user_id = e.user_id group by e.user_id""",
    "live_streaks": _STREAKS,
    "live_sessions": member_queries.ORACLE_SQL["active_sessions"],
    "live_counters": member_queries.ORACLE_SQL["counters_floored"],
    "live_reaction_counts": feed_queries.ORACLE_SQL["reaction_counts_reconcile"],
    "live_subscriptions": member_queries.ORACLE_SQL["subscription_state"],
}
