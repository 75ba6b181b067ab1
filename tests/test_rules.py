"""Boundary cases of the rules, on small hand-made frames."""

import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import identity, text, timeexpr
from larkspur.operators import audit, catalog, feed, inbox, ingest, joins, mutations, policy, profile, quiz, search, sequential, subscriptions

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def ago(**kw):
    return NOW - dt.timedelta(**kw)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("then", "label"),
    [
        (ago(seconds=44), "قبل لحظات"), (ago(seconds=45), "قبل 0 دقيقة"), (ago(seconds=60), "قبل دقيقة"), (ago(minutes=2), "قبل دقيقتين"), (ago(minutes=3), "قبل 3 دقائق"), (ago(minutes=11), "قبل 11 دقيقة"),
        (ago(minutes=59, seconds=59), "قبل 59 دقيقة"), (ago(hours=1), "قبل ساعة"), (ago(hours=23), "قبل 23 ساعة"), (ago(hours=24), "قبل يوم"), (ago(days=6), "قبل 6 أيام"), (ago(days=7), "قبل أسبوع"),
        (ago(days=34), "قبل 4 أسابيع"), (ago(days=35), "قبل شهر"), (ago(days=359), "قبل 11 شهر"), (ago(days=360), "7 يونيو 2023"), (NOW + dt.timedelta(days=1), "قبل لحظات"), (None, ""),
    ],
)
def test_relative_label(spark, then, label):
    assert one(spark, then, lambda x: timeexpr.relative_label(x, F.to_timestamp_ntz(F.lit(str(NOW)))), "timestamp_ntz") == label


def test_clock_and_rounding(spark):
    assert one(spark, 3_600_000 * 123 + 1, timeexpr.clock, "long") == "123:00:01"
    assert [one(spark, x, timeexpr.half_up, "double") for x in (2.5, -2.5, 0.49)] == [3, -2, 0]


def test_riyadh_midnight(spark):
    assert one(spark, dt.datetime(2024, 1, 1, 20, 59), timeexpr.riyadh_day, "timestamp_ntz") == dt.date(2024, 1, 1)
    assert one(spark, dt.datetime(2024, 1, 1, 21, 0), timeexpr.riyadh_day, "timestamp_ntz") == dt.date(2024, 1, 2)


def test_tags_and_mentions(spark):
    said = "#ab x#no  #Cd\n#c #" + "z" * 50 + " #" + "y" * 51 + " #علم #AB @me_1 a@no"
    assert one(spark, said, text.tags) == ["ab", "cd", "z" * 50, "y" * 50, "علم"]
    assert one(spark, said, text.mentions) == ["me_1"]
    kinds = [(r["token"], r["kind"]) for r in one(spark, "a #tag  @me #x", text.tokens)]
    assert kinds == [("a", "word"), (" ", "space"), ("#tag", "tag"), ("  ", "space"), ("@me", "mention"), (" ", "space"), ("#x", "word")]


def test_text_folds(spark):
    assert one(spark, "  a \n b ", text.collapse) == "a b"
    assert one(spark, "x" * 39, lambda x: text.shorten(x, 38)) == "x" * 38 + "…"
    assert one(spark, " أُحْمَد ة", text.fold_reading) == "احمدة"
    assert one(spark, "مدرسة ", text.fold_search) == "مدرسه"
    assert one(spark, None, text.handle_base) == "user"
    assert one(spark, "  Sara Ali!  ", text.handle_base) == "sara_ali"
    assert one(spark, "x", text.phone) is None


def test_identity(spark):
    rows = [(None, "u1", False, True, None), ("", "u2", False, True, False), ("N", "u3", True, True, True)]
    df = spark.createDataFrame(rows, "full string, user string, anon boolean, elite boolean, show boolean")
    got = df.select(identity.display_name(F.col("full"), F.col("anon")), identity.badge(F.col("elite"), F.col("show"))).collect()
    assert [tuple(r) for r in got] == [("مستخدم", True), ("مستخدم", False), ("مجهول", True)]


def test_streaks(spark):
    days = [(1, d) for d in (1, 2, 3, 5, 6)] + [(2, 9)] + [(3, 1), (3, 1), (3, 4)]
    df = spark.createDataFrame([(u, dt.datetime(2024, 1, d, 10)) for u, d in days], "user_id long, ts timestamp_ntz")
    got = {r["user_id"]: (r["current_streak"], r["longest_streak"]) for r in sequential.streaks(df).collect()}
    assert got == {1: (1, 2), 2: (0, 0), 3: (0, 0)}


def fold(times, limit, window, inclusive):
    start, n, out = None, 0, []
    for t in times:
        if start is None or t - start > window or (inclusive and t - start == window):
            start, n = t, 0
        out.append(n < limit)
        n += out[-1]
    return out


@pytest.mark.parametrize(("limit", "inclusive"), [(5, False), (1, True), (2, False)])
def test_windows_equal_a_fold(spark, limit, inclusive):
    rng, hours = random.Random(limit), 8
    rows = [(u, i, NOW + dt.timedelta(hours=rng.randrange(60))) for u in range(20) for i in range(30)]
    rows += [(99, 0, NOW), (99, 1, NOW + dt.timedelta(hours=8)), (99, 2, NOW + dt.timedelta(hours=8, milliseconds=1))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz")
    got = {(r["user_id"], r["event_id"]): r["allowed"] for r in sequential.decide(df, limit, hours * 3_600_000_000, inclusive).collect()}
    for user in {r[0] for r in rows}:
        own = sorted((t, i) for u, i, t in rows if u == user)
        assert [got[user, i] for _, i in own] == fold([t for t, _ in own], limit, dt.timedelta(hours=hours), inclusive)
    assert not all(got.values())


def test_phones_change_once_a_day(spark):
    rows = [(1, 1, 0, "05-1234567"), (1, 2, 23, "051234568"), (1, 3, 24, None), (1, 4, 30, "12"), (1, 5, 47, "051234569"), (1, 6, 48, "051234569"), (2, 7, 1, "x"), (None, 8, 1, "05 1234 567")]
    df = spark.createDataFrame([(u, i, NOW + dt.timedelta(hours=h), p) for u, i, h, p in rows], "user_id long, event_id long, ts timestamp_ntz, phone string")
    got = {r["event_id"]: (r["status"], r["phone"]) for r in sequential.phone_changes(df).collect()}
    late = ("phone_cooldown", None)
    assert got == {1: ("changed", "+966051234567"), 2: late, 3: ("changed", None), 4: ("invalid_phone", None), 5: late, 6: ("changed", "+966051234569"), 7: ("changed", None), 8: ("changed", "+966051234567")}


def test_one_users_events_are_never_in_one_row(spark):
    n, hours = 50_000, 8
    df = spark.range(n).selectExpr("cast(null as long) as user_id", "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 999 as int)) as ts")
    made = sequential.decide(df, 2, hours * 3_600_000_000)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    rows = made.collect()
    own = sorted((r["ts"], r["event_id"], r["allowed"]) for r in rows)
    assert len(own) == n and [a for *_, a in own] == fold([t for t, *_ in own], 2, dt.timedelta(hours=hours), False)


def test_floored_counters_equal_a_fold(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice((-1, -1, 1))) for k in range(30) for i in range(25)]
    got = {r["key"]: r["value"] for r in sequential.floored_counters(spark.createDataFrame(rows, "key long, seq long, delta int")).collect()}
    for key in range(30):
        n = 0
        for _, _, d in rows[key * 25 : key * 25 + 25]:
            n = max(0, n + d)
        assert got[key] == n


def test_reactions_equal_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(4), rng.choice(("like", "dislike")), i) for i in range(300)]
    state = {}
    for post, user, kind, _ in rows:
        state[post, user] = None if state.get((post, user)) == kind else kind
    got = mutations.reaction_state(spark.createDataFrame(rows, "post_id long, user_id long, kind string, seq long")).collect()
    assert {(r["post_id"], r["user_id"]): r["kind"] for r in got} == {k: v for k, v in state.items() if v}


def test_unread(spark):
    part = spark.createDataFrame([(1, 5, None), (2, 5, NOW), (3, 6, NOW)], "user_id long, conversation_id long, last_read_at timestamp_ntz")
    msg = spark.createDataFrame([(1, 5, 1, NOW), (2, 5, 2, NOW), (3, 5, 1, NOW + dt.timedelta(seconds=1))], "id long, conversation_id long, sender_id long, created_at timestamp_ntz")
    assert {(r["user_id"], r["unread"]) for r in inbox.unread_messages(part, msg).collect()} == {(1, 1), (2, 1), (3, 0)}


def test_ilike_wildcard(spark):
    bodies = spark.createDataFrame([(1, "x #aXb"), (2, "x #a_b"), (3, "none")], "post_id long, content string")
    posts = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(days=1)), (3, NOW)], "id long, created_at timestamp_ntz")
    assert [r["post_id"] for r in feed.tag_page_by_pattern(posts, bodies, "a_b", 9).collect()] == [1, 2]


def test_settings_row_absent_or_null(spark):
    people = spark.createDataFrame([(1,), (2,)], "id long")
    stored = spark.createDataFrame([(1, None, False)], "user_id long, allow_messages boolean, show_likes_on_profile boolean")
    got = {r["id"]: (r["allow_messages"], r["show_likes_on_profile"]) for r in profile.settings(people, stored).collect()}
    assert got == {1: (None, False), 2: (True, True)}


def test_leaderboard_numbers_like_one_window(spark):
    rows = [(i, f"u{i}", float(i % 50 - 5) if i % 7 else None) for i in range(500)]
    got = {r["id"]: r["rank"] for r in profile.leaderboard_view(spark.createDataFrame(rows, "id long, username string, xp double")).collect()}
    order = sorted((r for r in rows if r[2] is not None and r[2] > 0), key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(order, 1)}


@pytest.mark.parametrize(("event", "status", "elite"), [("x", "active", True), ("x", "cancelled", False), ("subscription_created", "expired", False), ("order_created", "", True), (None, None, False)])
def test_elite(spark, event, status, elite):
    df = spark.createDataFrame([(event, status)], "e string, s string")
    assert df.select(subscriptions.is_elite(F.col("e"), F.col("s"))).first()[0] is elite


def test_signature(spark):
    good = hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "0" * 64), (None, good)], "raw string, sig string")
    assert [r[0] for r in df.select(subscriptions.signature_valid("raw", "sig", "k")).collect()] == [True, False, False]


def test_policies(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "referrer_id long, referred_id long")
    assert policy.visible(rows, "referrals", 2).count() == 2
    assert policy.visible(rows, "payment_events", 2).count() == 0 == policy.visible(rows, "not a table", 2).count()
    assert rows.where(policy.may_insert("referrals", 4)).count() == 0
    assert one(spark, "7/a.png", lambda x: policy.owns_folder(x, "7")) is True


def test_catalogue(spark):
    found = catalog.resources(catalog.subjects(spark))
    assert catalog.nodes(spark).count() == 35 and found.count() == 1245 and found.select("key").distinct().count() == 1245
    stage = {r[0]: r[1] for r in found.groupBy(F.split("path", "/")[0]).count().collect()}
    assert stage == {"elementary": 360, "middle": 198, "high-school": 453, "continuing": 126, "special": 108}
    asked = spark.createDataFrame([("1447/high-school/sharia/tafsir/t1/student-book.pdf",), ("1447/high-school/grade-2/sharia/tafsir/t1/student-book.pdf",)], "key string")
    assert [r["subject"] for r in catalog.by_key(found, asked).collect()] == ["tafsir"]
    assert catalog.trail(catalog.nodes(spark), "no/such").count() == 0
    assert catalog.nodes(spark).where("is_leaf").count() == len(catalog.leaves())


def test_trees_and_trails(spark):
    """A path may be both leaf and branch; null, empty and repeated paths add nothing."""
    leaves = spark.createDataFrame([("a/b/c",), ("a/b",), ("a/b/c",), ("d",), (None,), ("",)], "path string")
    tree = catalog.tree(leaves)
    assert sorted(map(tuple, tree.collect())) == [("a", None, 1, False), ("a/b", "a", 2, True), ("a/b/c", "a/b", 3, True), ("d", None, 1, True)]
    asked = spark.createDataFrame([("a/b",), ("a/b",), ("a/x",), ("d",), (None,)], "path string")
    assert sorted((r["asked"], r["path"]) for r in catalog.trails(tree, asked).collect()) == [("a/b", "a"), ("a/b", "a/b"), ("d", "d")]
    assert catalog.tree(leaves.limit(0)).count() == 0


def test_import(spark, tmp_path):
    manifest = tmp_path / "m.json"
    manifest.write_text('{"sources": [{"key": "a.pdf", "url": "https://x.org/1"}, {"key": "", "url": "https://x.org/2"}, {"key": "b.pdf", "url": "https://evil.org/3"}, {"key": "../c.pdf", "url": "https://x.org/4"}, {"key": "d.pdf", "url": "https://x.org/5"}]}')
    rows = ingest.read_manifest(spark, str(manifest))
    assert rows.count() == 4 and ingest.read_manifest(spark, str(manifest), 2).count() == 2
    known = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "key string")
    done = known.where("key = 'a.pdf'")
    got = lambda **kw: {r["key"]: r["status"] for r in ingest.status(rows, known, done, ["x.org"], **kw).collect()}
    assert got() == {"a.pdf": "skipped", "b.pdf": "host_not_allowed", "../c.pdf": "bad_key", "d.pdf": "unknown_key"}
    assert got(force=True)["a.pdf"] == "fetch" and got(force=True, dry_run=True)["a.pdf"] == "dry_run"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/ok.pdf").write_bytes(b"%PDF" + b"0" * 2000)
    (tmp_path / "f/no.pdf").write_bytes(b"<html>" + b"0" * 2000)
    (tmp_path / "f/small.pdf").write_bytes(b"%PDF")
    checked = ingest.pdf_valid(spark.read.format("binaryFile").load(str(tmp_path / "f"))).collect()
    assert {r["path"].rpartition("/")[2]: r["ok"] for r in checked} == {"ok.pdf": True, "no.pdf": False, "small.pdf": False}


def test_quiz_draw_keeps_the_answer(spark):
    questions = spark.createDataFrame([(i, [f"{i}-{j}" for j in range(4)], i % 4) for i in range(20)], "id long, options array<string>, answer_index int")
    drawn = quiz.draw(questions, 12, 5).collect()
    assert len(drawn) == 12 and quiz.draw(questions, 99, 5).count() == 20
    assert all(r["options"][r["answer_index"]] == f"{r['id']}-{r['id'] % 4}" and len(set(r["options"])) == 4 for r in drawn)
    assert any(r["options"] != sorted(r["options"]) for r in drawn)


def test_faq(spark):
    items = spark.createDataFrame([(1, "a", True, "أحمد", "x"), (2, "b", False, "q", "مدرسة"), (3, "a", True, "y", "z")], "id long, cat string, popular boolean, q string, a string")
    assert [r["id"] for r in search.find(items, "احمد").collect()] == [1]
    assert [r["id"] for r in search.find(items, "مدرسه ").collect()] == [2]
    assert [r["id"] for r in search.popular(items, 1).collect()] == [1]
    groups = spark.createDataFrame([("g", [("q1", "a1"), ("q2", "a2")])], "q string, subs array<struct<q:string,a:string>>")
    assert search.flatten_groups(groups).count() == 2


def test_defaults_overlay_and_sign_up(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert {tuple(r) for r in mutations.overlay(a, b, key="id").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert audit.with_defaults(a, {"v": "d", "n": 1}).collect()[0]["n"] == 1
    profiles, subs = mutations.sign_up(a, spark.createDataFrame([], "user_id long, tier string, status string"), spark.createDataFrame([(2, "q"), (9, "n")], "id long, v string"))
    assert profiles.count() == 3 and [tuple(r) for r in subs.collect()] == [(9, "free", "inactive")]


def test_join_by_size_gives_the_same(spark):
    a, b = spark.range(50).withColumnRenamed("id", "k"), spark.range(30).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert joins.join_by_size(a, b, "k").count() == joins.join_by_size(a, b, "k", rows=3).count() == 30


def test_names_with_several_spaces(spark):
    rows = spark.createDataFrame([("Sara  Ali",), ("Sara Ali",), ("Sara",), ("Sara\tAli",), ("علي   حسن",), ("Sara Ali 2",)], "x string")
    assert [r[0] for r in rows.select(F.col("x").rlike(text.SERVER_NAME)).collect()] == [True, True, False, False, True, False]


def test_gates_are_apart(spark):
    rows = spark.createDataFrame([(1, "admin", False), (2, "student", True), (3, "admin", None), (4, None, True)], "id long, role string, is_elite boolean")
    assert {r["id"] for r in profile.with_role(rows).collect()} == {1, 3} and {r["id"] for r in profile.elite_only(rows).collect()} == {2, 4}


def test_upsert_writes_nulls_but_not_absent_columns(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    changes = spark.createDataFrame([(1, None, 2), (1, "z", 1), (3, "c", 1)], "id long, v string, seq long")
    got = {tuple(r) for r in mutations.upsert(state, changes, ["id"], [F.desc("seq")]).collect()}
    assert got == {(1, None, "x"), (2, "b", "y"), (3, "c", None)}


def test_links_of_notifications(spark):
    notes = spark.createDataFrame([(1, "follow", 7), (2, "follow", 8), (3, "follow", None), (4, "request_accepted", 7), (5, "other", 7)], "id long, type string, actor_id long")
    actors = spark.createDataFrame([(7, "sara"), (8, "")], "id long, username string")
    got = {r["id"]: (r["link"], r["icon"]) for r in inbox.with_links(notes, actors).collect()}
    assert got == {1: ("/u/sara", "UserPlus"), 2: ("/community", "UserPlus"), 3: ("/community", "UserPlus"), 4: ("/chat", "CheckCheck"), 5: ("/community", "Heart")}


def test_ranks_of_ties_are_split_over_buckets(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(F.lit(500.0)).alias("xp"))
    got = {r["id"]: r["rank"] for r in profile.number_rows(rows, "rank", "xp", "id", 16).collect()}
    want = sorted(((r["xp"], r["id"]) for r in rows.collect()), key=lambda p: (-p[0], p[1]))
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}


def test_bios(spark):
    state = spark.createDataFrame([(i, "old") for i in range(5)], "id long, bio string")
    changes = spark.createDataFrame([(0, " new "), (1, "  "), (2, "x" * 301), (3, " " + "x" * 300 + " ")], "id long, bio string")
    assert {r["id"]: r["bio"] for r in profile.set_bio(state, changes).collect()} == {0: "new", 1: None, 2: "old", 3: "x" * 300, 4: "old"}


def test_elite_cooldowns(spark):
    day = 86_400_000_000
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in (0, 1, 1, 14)]
    rows = spark.createDataFrame([(u, i, t, elite) for u, elite in ((1, True), (2, False), (3, None)) for i, t in enumerate(ts)], "user_id long, event_id long, ts timestamp_ntz, is_elite boolean")
    tiers = {(r["user_id"], r["event_id"]) for r in sequential.decide(rows, 1, 14 * day, inclusive=True, elite_us=day).where("allowed").collect()}
    assert tiers == {(1, 0), (1, 1), (1, 3), (2, 0), (2, 3), (3, 0), (3, 3)}
    assert sequential.decide(rows, 1, 14 * day, inclusive=True).where("allowed and user_id = 1").count() == 4


def test_catalogue_joins_are_never_broadcast(spark, tmp_path):
    """Keys and resources, paths and trees grow together, so no side of their joins goes through the driver, whatever Spark takes its size for."""
    catalog.subjects(spark).write.parquet(f"{tmp_path}/subjects")
    catalog.nodes(spark).write.parquet(f"{tmp_path}/tree")
    found, tree = catalog.resources(spark.read.parquet(f"{tmp_path}/subjects")), spark.read.parquet(f"{tmp_path}/tree")
    for made in (catalog.by_key(found, found.select("key")), catalog.trails(tree, tree.select("path"))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert catalog.by_key(found, found.select("key")).count() == 1245
