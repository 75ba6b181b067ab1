"""Counts and numbers in blocks, handles and substring search, against plain versions."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from larkspur.operators import blocks, handles, inbox, substrings

NOW = dt.datetime(2024, 1, 1)


def test_numbers_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice("ab")) for i in rng.sample(range(10**9), 3000)] + [(7, None), (3, None)]
    got = blocks.numbered(spark.createDataFrame(rows, "id long, k string"), ["k"], "id", "n", 32)
    want, seen = {}, Counter()
    for i, k in sorted(rows):
        seen[k] += 1
        want[i, k] = seen[k]
    assert {(r["id"], r["k"]): r["n"] for r in got.collect()} == want
    bounds = blocks.cuts(got, "id", 32)
    sizes = Counter(r["_range"] for r in blocks.ranged(got.where("k = 'hot'"), "id", bounds).collect())
    assert len(sizes) == 32 and max(sizes.values()) < 3000 / 8


def test_ranges_of_few_values(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long")
    assert blocks.cuts(df.where("x is null"), "x") == []
    bounds = blocks.cuts(df, "x", 4)
    placed = {r["x"]: r["_range"] for r in blocks.ranged(df, "x", bounds).collect()}
    assert placed[1] < placed[2] < placed[None]


def test_unread_of_a_hot_conversation(spark):
    rng = random.Random(2)
    sent = [(9 if rng.random() < 0.9 else rng.randrange(3), rng.choice([1, 1, 1, 2, 3]), NOW + dt.timedelta(seconds=rng.randrange(400))) for _ in range(4000)]
    parts = [(c, u, NOW + dt.timedelta(seconds=rng.randrange(400)) if u % 3 else None) for c in (0, 1, 2, 9, 50) for u in (1, 2, 3, 4)]
    messages = spark.createDataFrame(sent, "conversation_id long, sender_id long, created_at timestamp_ntz")
    participants = spark.createDataFrame(parts, "conversation_id long, user_id long, last_read_at timestamp_ntz")
    want = {(u, c): sum(1 for mc, s, at in sent if mc == c and s != u and (mark is None or at > mark)) for c, u, mark in parts}
    made = inbox.unread_messages(participants, messages, ranges=16)
    assert {(r["user_id"], r["conversation_id"]): r["unread"] for r in made.collect()} == want
    assert inbox.unread_messages(participants, messages.limit(0)).agg(F.sum("unread")).first()[0] == 0
    assert inbox.unread_messages(participants.limit(0), messages).isEmpty()


def test_handles_are_unique(spark):
    rng = random.Random(3)
    names = ["", None, "Sara Ali", "sara  ali", "a_1", "a", "x_2_3", "User"]
    members = [(i, rng.choice(names)) for i in range(2000)]
    taken = [("user_7",), ("a_1",), ("a_1_5",), ("sara_ali_x",), ("user_99999999999999999",), ("user_007",), (None,)]
    df = spark.createDataFrame(members, "id long, name string")
    got = {r["id"]: r["handle"] for r in handles.assign(df, spark.createDataFrame(taken, "handle string"), 8).collect()}
    assert len(got) == 2000 and len(set(got.values()) | {t for (t,) in taken}) == 2000 + len(taken)
    by_base = defaultdict(list)
    for i, name in members:
        by_base["user" if not name else name.lower().replace("  ", "_").replace(" ", "_")].append(i)
    start = {"user": 7, "a": 1, "a_1": 5}
    assert all(got[i] == f"{base}_{start.get(base, 0) + n}" for base, ids in by_base.items() for n, i in enumerate(sorted(ids), 1))


def test_substrings_by_index(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(200))) for _ in range(400)] + [None, "", "ab", "100%_ABCd", "é😀x!"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    substrings.write(substrings.postings(items, "id", F.col("body")), str(tmp_path / "grams"))
    listed = spark.read.parquet(str(tmp_path / "grams"))
    for pattern in ("%abcd%", "%ABÉ%", "%a_cda%", "%ab%", "100\\%\\_abc%", "%é😀x%", "%abc%dab%", "", "%", "%zzz%"):
        want = sorted(r["id"] for r in items.where(F.col("body").ilike(pattern)).collect())
        assert sorted(r["id"] for r in substrings.like(items, listed, "id", F.col("body"), pattern).collect()) == want, pattern
    assert substrings.grams_of("%a_bcde\\%%") == ["bcd", "cde", "de%"]
    verified = substrings.candidates(listed, substrings.grams_of("%abcda%")).count()
    assert verified < 0.2 * len(texts) and "bucket" in substrings.candidates(listed, ["abc"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:40]
