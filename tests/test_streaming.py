"""Streams against the batch rules on the same rows."""

import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from larkspur.operators import mutations, sequential, subscriptions
from larkspur.plans import live_queries
from larkspur.streaming import changes, live
from larkspur.streaming import store as store_module
from larkspur.streaming.store import Store, for_each

NOW = dt.datetime(2024, 6, 1)


def parts(df, path, n):
    """One file for each part of the rows, in time order."""
    for i in range(n):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def drain(stream, spark, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_rate_window_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    rows = sorted((NOW + dt.timedelta(minutes=rng.randrange(3000)), rng.randrange(6)) for _ in range(240))
    df = spark.createDataFrame([(u, i, t, i // 80) for i, (t, u) in enumerate(rows)], "user_id long, event_id long, ts timestamp_ntz, part int")
    path = parts(df, tmp_path / "in", 3)
    stream = changes.feed(spark, path, "user_id long, event_id long, ts timestamp_ntz")
    got = {(r["user_id"], r["event_id"]): r["allowed"] for r in drain(changes.rate_window(stream, 2, 8 * 3_600_000_000), spark, "rates").collect()}
    want = {(r["user_id"], r["event_id"]): r["allowed"] for r in sequential.decide(df, 2, 8 * 3_600_000_000).collect()}
    assert got == want and not all(want.values())


def test_feed_notifications_and_counts(spark, tmp_path):
    posts = spark.createDataFrame([(1, 10), (2, 20)], "id long, user_id long")
    acts = spark.createDataFrame([(1, 10, "like", NOW, 0), (1, 11, "like", NOW, 0), (2, 11, "dislike", NOW, 1), (2, 12, "comment", NOW, 1)], "post_id long, user_id long, kind string, created_at timestamp_ntz, part int")
    stream = changes.feed(spark, parts(acts, tmp_path / "acts", 2), "post_id long, user_id long, kind string, created_at timestamp_ntz")
    assert {(r["user_id"], r["actor_id"], r["type"]) for r in drain(changes.notifications(stream, posts), spark, "notes").collect()} == {(10, 11, "like"), (20, 12, "comment")}
    notes = spark.createDataFrame([(1, False, 0), (1, True, 0), (1, False, 1), (2, True, 1)], "user_id long, read boolean, part int")
    counts = changes.unread_counts(changes.feed(spark, parts(notes, tmp_path / "notes", 2), "user_id long, read boolean"))
    assert {tuple(r) for r in drain(counts, spark, "counts", "complete").collect()} == {(1, 2), (2, 0)}


def test_inserts_once_and_filtered(spark, tmp_path):
    rows = spark.createDataFrame([("INSERT", 1, 10, NOW, 0), ("INSERT", 1, 10, NOW, 1), ("UPDATE", 2, 10, NOW, 1), ("INSERT", 3, 11, NOW, 1)], "change string, id long, user_id long, created_at timestamp, part int")
    path = parts(rows, tmp_path / "posts", 2)
    people = spark.createDataFrame([(10, "ten")], "id long, username string")
    schema = "change string, id long, user_id long, created_at timestamp"
    got = drain(changes.inserted_posts(changes.feed(spark, path, schema), people), spark, "posts").collect()
    assert {(r["id"], r["username"]) for r in got} == {(1, "ten"), (3, None)}
    assert drain(changes.subscribe(changes.feed(spark, path, schema), "INSERT", "user_id", 11), spark, "mine").count() == 1


def stored(spark, store):
    return sorted(tuple(r) for r in store.read(spark).collect())


def test_updates_into_a_table(spark, tmp_path):
    """Only the buckets of a batch's keys are written; a batch that is run again changes nothing."""
    store = Store(str(tmp_path / "state"), "id long, v string", ("id",), buckets=8)
    apply = lambda old, batch: mutations.upsert(old, batch, ["id"], [F.desc("seq")])
    first = spark.range(200).selectExpr("id", "cast(id as string) as v", "0L as seq")
    store.merge(first, 0, apply)
    assert len(store.held(spark)) == 8
    rows = spark.createDataFrame([(1, "x", 1, 0), (1, "z", 3, 0), (None, "n", 1, 0)], "id long, v string, seq long, part int")
    stream = changes.feed(spark, parts(rows, tmp_path / "rows", 1), "id long, v string, seq long")
    changes.into_table(stream, apply, store, str(tmp_path / "none")).awaitTermination(120)
    assert stored(spark, store)[:2] != [(1, "z")] and store.commits(spark) == [0]  # epoch 0 is committed already
    batch = rows.drop("part")
    store.merge(batch, 1, apply)
    held = store.held(spark)
    assert sum(g == [1] for g in held.values()) <= 2 and sum(g == [0] for g in held.values()) >= 6
    want = sorted([(i, "z" if i == 1 else str(i)) for i in range(200)])
    assert sorted(r for r in map(tuple, store.read(spark).where("id is not null").collect())) == want and store.read(spark).count() == 201
    store.merge(batch.withColumn("v", F.lit("again")), 1, apply)
    assert store.read(spark).where("v = 'again'").count() == 0
    store.merge(spark.createDataFrame([(5, "five", 1)], "id long, v string, seq long"), 2, lambda old, new: old.join(new, "id", "left_anti"))
    assert store.read(spark).where("id = 5").count() == 0 and store.commits(spark) == [1, 2]
    for epoch in range(3, 6):
        store.merge(batch, epoch, apply)
    assert set(store._names(spark, "data")) == {f"epoch={g}" for e in store.commits(spark) for of in store.held(spark, e).values() for g in of}


def payment(i, received, user=1, name="subscription_created", status="active"):
    return (i, received, user, name, status, NOW)


PAYMENT = "event_id string, received long, user_id long, event_name string, status string, period_end timestamp_ntz"


def stores(tmp_path, n=8):
    return Store(str(tmp_path / "seen"), changes.SEEN, ("event_id",), n), Store(str(tmp_path / "users"), changes.USERS, ("user_id",), n)


def test_payment_ids_are_kept_for_good(spark, tmp_path):
    seen, users = stores(tmp_path)
    frame = lambda *rows: spark.createDataFrame(rows, PAYMENT)
    tiers = lambda: {r["user_id"]: r["tier"] for r in subscriptions.tiers(users.read(spark)).collect()}
    changes.settle(frame(*(payment(f"e{i}", i, i) for i in range(50))), 0, seen, users)
    assert tiers() == dict.fromkeys(range(50), "elite")
    two_days = 2 * 86_400_000_000
    read = changes.settle(frame(payment("e7", two_days, 7, "subscription_expired", "expired"), payment("new", two_days + 1, 8, "subscription_expired", "expired")), 1, seen, users)
    assert tiers()[7] == "elite" and tiers()[8] == "free" and 1 <= read <= 2
    assert changes.settle(frame(payment("e51", 3, 8)), 2, seen, users) <= 1  # out of order: the later one stays
    assert tiers()[8] == "free" and seen.read(spark).count() == 52
    assert changes.settle(frame(payment("e60", 4, None), payment(None, 5, 3, "x", "expired")), 3, seen, users) <= 1
    assert tiers()[3] == "elite" and seen.read(spark).count() == 53


def test_a_batch_that_failed_between_its_commits_is_whole_the_next_time(spark, tmp_path):
    seen, users = stores(tmp_path)
    batch = spark.createDataFrame([payment("a", 1), payment("b", 2, 2)], PAYMENT)
    seen.append(batch.select("event_id", F.lit(0).cast("long").alias("epoch")), 0)
    assert users.commits(spark) == []
    changes.settle(batch, 0, seen, users)
    assert users.read(spark).count() == 2 and seen.read(spark).count() == 2
    changes.settle(batch, 0, seen, users)
    changes.settle(batch, 1, seen, users)
    assert users.read(spark).count() == 2 and seen.read(spark).count() == 2


def test_many_generations_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MAX_GENERATIONS", 3)
    seen, _ = stores(tmp_path, 2)
    for epoch in range(7):
        rows = spark.range(epoch * 10, epoch * 10 + 10).selectExpr("cast(id as string) as event_id", f"{epoch}L as epoch")
        fresh, _ = seen.unseen(rows, epoch)
        assert fresh.count() == 10
        seen.append(rows, epoch)
    assert max(map(len, seen.held(spark).values())) <= 3 and seen.read(spark).count() == 70
    again, read = seen.unseen(spark.range(70).selectExpr("cast(id as string) as event_id", "9L as epoch"), 9)
    assert again.count() == 0 and read == 2


def last_rows(spark, stream, tmp_path, key):
    """All rows of a stream in update mode, in order of their batches, by key."""
    got = {}

    def keep(batch, epoch):
        for r in batch.collect():
            got.setdefault(tuple(r[k] for k in key), []).append(r)

    for_each(stream, keep, str(tmp_path / "checkpoint"), "update").awaitTermination(180)
    return got


def test_unread_badges_reset(spark, tmp_path):
    """Marks that come late, or before what they mark, and repeated notifications."""
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [
        (1, 10, at(10), False, 0), (1, 11, at(30), False, 0), (1, None, at(20), True, 0), (1, 11, at(30), False, 1), (1, 12, at(15), False, 1), (1, None, at(12), True, 1), (1, 13, at(4000), False, 1),
        (2, None, at(50), True, 0), (2, 20, at(60), False, 1), (2, 21, at(40), False, 1), (3, 30, at(1), False, 0), (3, 31, at(2), False, 0), (3, None, at(3), True, 1), (None, 40, at(1), False, 0),
    ]
    df = spark.createDataFrame(rows, "user_id long, id long, at timestamp_ntz, mark boolean, part int")
    stream = changes.feed(spark, parts(df, tmp_path / "in", 2), "user_id long, id long, at timestamp_ntz, mark boolean")
    with live.with_rocksdb(spark):
        got = last_rows(spark, live.unread(stream), tmp_path, ["user_id"])
    assert {k[0]: [r["unread"] for r in v] for k, v in got.items()} == {1: [1, 2], 2: [0, 1], 3: [2, 0], None: [1]}


def test_streaks_break_by_timers(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=n)
    rows = [(1, day(0), 0), (1, day(1), 0), (1, day(2), 0), (2, day(1), 0), (2, day(0), 1), (2, day(3), 1), (2, day(2), 1), (9, day(8), 2), (9, day(8), 3), (1, day(9), 4), (1, day(10), 4)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, part int")
    stream = changes.feed(spark, parts(df, tmp_path / "in", 5), "user_id long, ts timestamp_ntz")
    with live.with_rocksdb(spark):
        got = last_rows(spark, live.streaks(stream, "3 days"), tmp_path, ["user_id"])
    row = lambda r: (r["current_streak"], r["longest_streak"], r["last_day"].day, r["alive"])
    assert row(got[1,][-1]) == (1, 2, 11, True) and row(got[2,][-1]) == (3, 3, 4, False)
    assert (2, 2, 3, False) in map(row, got[1,]) and row(got[1,][0]) == (2, 2, 3, True)


def test_sessions_expire_and_stay_revoked(spark, tmp_path):
    at = lambda h: NOW + dt.timedelta(hours=h)
    rows = [(1, "a", "revoke", at(1), 0), (1, "a", "beat", at(0), 1), (1, "a", "beat", at(2), 1), (2, "b", "beat", at(0), 0), (3, "c", "beat", at(31), 2), (3, "c", "beat", at(30), 3), (3, "d", "revoke", at(31), 3)]
    df = spark.createDataFrame(rows, "user_id long, session_id string, kind string, ts timestamp_ntz, part int")
    schema = "user_id long, session_id string, kind string, ts timestamp_ntz"
    store = Store(str(tmp_path / "sessions"), live.SESSIONS, live.KEYS, 1)
    path, apply = parts(df.where("part < 2"), tmp_path / "in", 2), live.merge_sessions("1 day")
    follow = lambda: store.follow(changes.feed(spark, path, schema), apply, str(tmp_path / "ck")).awaitTermination(180)
    found = lambda: {(r["user_id"], r["session_id"]): (r["last_active_at"], r["revoked_at"]) for r in store.read(spark).collect()}
    follow()
    assert found() == {(1, "a"): (at(2), at(1)), (2, "b"): (at(0), None)}
    assert subscriptions.active_sessions(store.read(spark)).count() == 1
    assert live.current_sessions(store.read(spark), at(25), "1 day").count() == 1
    parts(df.where("part = 2 or part = 3"), tmp_path / "in", 4)
    follow()
    assert found() == {(3, "c"): (at(31), None), (3, "d"): (None, at(31))}  # a (revoked) and b have been silent for a day


def test_counters_merge_without_a_recount(spark, tmp_path):
    rng = random.Random(3)
    moves = [(rng.randrange(40), i, rng.choice([-1, 1, -2])) for i in range(900)]
    store = Store(str(tmp_path / "counters"), "key long, total long, low long", ("key",), 4)
    df = spark.createDataFrame(moves, "key long, seq long, delta long")
    for epoch in range(3):
        store.merge(df.where(F.floor(F.col("seq") / 300) == epoch), epoch, changes.merge_counters)
    got = {r["key"]: r["total"] - r["low"] for r in store.read(spark).collect()}
    want = {}
    for k, _, d in moves:
        want[k] = max(0, want.get(k, 0) + d)
    assert got == want


def test_large_tables_come_in_more_files_and_large_buckets_in_several(spark, tmp_path, monkeypatch):
    """No task reads or writes more rows when there are more, and the batches stay as many; results are the same."""
    monkeypatch.setattr(live_queries, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 10, raising=False)
    files, delete = [], live_queries._delete
    monkeypatch.setattr(live_queries, "_delete", lambda spark, path: files.append(len(list(Path(path.removeprefix("file:")).glob("part-*.parquet")))) or delete(spark, path))
    kept = Store(str(tmp_path / "kept"), "id long, seq int", ("id",), buckets=2)
    rows = spark.range(1000).select((F.col("id") % 100).alias("id"), F.col("id").cast("int").alias("seq"))
    merge, sizes = store_module.latest_wins(["id"], [F.desc("seq")]), []

    def counted(state, batch):
        sizes.append(batch.count())
        return merge(state, batch)

    live_queries._streamed(rows, lambda stream, at: kept.follow(stream, counted, at))
    assert sorted(map(tuple, kept.read(spark).collect())) == [(i, 900 + i) for i in range(100)]
    assert len(sizes) == 3 and sum(sizes) == 1000 and files[0] == 24
    written = [len(list((tmp_path / "kept" / "data" / f"epoch={g}" / f"_bucket={b}").glob("*.parquet"))) for b, (g,) in kept.held(spark).items()]
    assert len(written) == 2 and min(written) > 2


def _random_events(seed):
    """Events of 60 users and a null one over 40 days, some twice; a few users have most."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(4), *range(4), *range(60)]), i, NOW + dt.timedelta(minutes=rng.randrange(40 * 24 * 60)), rng.random() < 0.15) for i in range(700)]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    return [(*r, i % 3) for i, r in enumerate(rows)]


def test_streaks_merge_without_a_call_for_each_user(spark, tmp_path):
    rows = _random_events(8)
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, mark boolean, part int")
    store = Store(str(tmp_path / "runs"), live.RUNS, ("user_id",), 4)
    for epoch in range(3):
        store.merge(df.where(F.col("part") == epoch).select("user_id", "ts"), epoch, live.merge_streaks)
    days = {}
    for user, _, ts, *_ in rows:
        days.setdefault(user, set()).add((ts + dt.timedelta(hours=3)).date())
    want = {}
    for user, of in days.items():
        runs = []
        for day in sorted(of):
            runs = [*runs[:-1], (runs[-1][0], day)] if runs and (day - runs[-1][1]).days == 1 else [*runs, (day, day)]
        lengths = [(b - a).days for a, b in runs]
        want[user] = (lengths[-1], max(lengths), runs[-1][1])
    assert {r[0]: tuple(r[1:]) for r in live.streaks_of(store.read(spark)).collect()} == want and None in want


def test_unread_merges_without_a_call_for_each_user(spark, tmp_path):
    rows = _random_events(9)
    df = spark.createDataFrame(rows, "user_id long, id long, at timestamp_ntz, mark boolean, part int")
    store = Store(str(tmp_path / "waiting"), live.WAITING, ("user_id",), 4)
    for epoch in range(3):
        store.merge(df.where(F.col("part") == epoch).drop("part"), epoch, live.merge_unread)
    want = {}
    for user in {r[0] for r in rows}:
        last = max((at for u, _, at, mark, _ in rows if u == user and mark), default=dt.datetime.min)
        want[user] = len({(i, at) for u, i, at, mark, _ in rows if u == user and not mark and at > last})
    assert {tuple(r) for r in live.unread_of(store.read(spark)).collect()} == set(want.items())
    assert 0 in want.values() and max(want.values()) > 3


def test_live_queries_of_users_keep_no_state_by_key_in_python(spark, monkeypatch):
    """The work of a batch is joins and windows over its rows, so it doesn't grow by a Python call for each user."""
    ended = []
    follow = Store.follow
    monkeypatch.setattr(Store, "follow", lambda *a, **k: ended.append(follow(*a, **k)) or ended[-1])
    sf_dir = "/root/testdata/sf0.001"
    assert live_queries.live_streaks(spark, sf_dir).count() > 0 and live_queries.live_unread(spark, sf_dir).count() > 0
    assert len(ended) == 2 and all(not p["stateOperators"] for q in ended for p in q.recentProgress)
