"""Queries over members, their standing, messages and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import identity, timeexpr
from larkspur.operators import handles, inbox, mutations, policy, profile, reads, sequential, subscriptions
from larkspur.sources import tables as t

AS_OF = "2024-01-31 00:00:00"
#: Times from which every form of a relative label occurs, with the columns of the labels.
LABELS_AS_OF = {"label": AS_OF, "in_spring": "2024-03-20 00:00:00", "in_autumn": "2024-10-15 00:00:00", "next_year": "2025-01-10 00:00:00"}


def _follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reacted to whose posts, as follow edges."""
    posts = t.posts(spark, sf_dir).select(F.col("id").alias("post_id"), F.col("user_id").alias("followee_id"), "created_at")
    acts = t.reactions(spark, sf_dir).where("kind = 'like'").select("post_id", F.col("user_id").alias("follower_id"))
    return acts.join(posts, "post_id").where("follower_id <> followee_id").groupBy("follower_id", "followee_id").agg(F.min("created_at").alias("created_at"))


def _counted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = t.reactions(spark, sf_dir).groupBy(F.col("post_id").alias("id")).agg(F.count(F.when(F.col("kind") == "like", 1)).alias("likes_count"), F.count(F.when(F.col("kind") == "repost", 1)).alias("reposts_count"))
    return t.posts(spark, sf_dir).select("id", "user_id").join(acts, "id", "left")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")


def _participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user in the conversations user_id % 10 and user_id % 7 + 100; read until their last sign-up event."""
    read = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last_read_at"))
    return read.select("user_id", "last_read_at", F.explode(F.array(F.col("user_id") % 10, F.col("user_id") % 7 + 100)).alias("conversation_id"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _events(spark, sf_dir).where("event_type = 'click'")
    return clicks.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("conversation_id"), F.col("user_id").alias("sender_id"), F.col("ts").alias("created_at"))


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for x in ("signup", "follow", "error", "request_accepted", "click", "message", "view", "like", "purchase", "comment")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 97).alias("actor_id"), F.element_at(kinds, F.col("event_type")).alias("type"), (F.col("value") > 50).alias("read"), F.col("ts").alias("created_at"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.profiles(spark, sf_dir).where("id % 3 = 0").select(
        F.col("id").alias("user_id"), (F.col("id") % 2 == 0).alias("allow_message_requests"), F.when(F.col("id") % 4 == 0, F.col("id") % 8 == 0).alias("show_likes_on_profile"), (F.col("id") % 9 == 0).alias("show_reposts_on_profile")
    )


def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.statistics(t.profiles(spark, sf_dir), _counted_posts(spark, sf_dir), _follows(spark, sf_dir))


def leaderboard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leaderboard_view(t.profiles(spark, sf_dir).select("id", "username", "xp", "is_elite"))


def leaderboard_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leaderboard_top(t.profiles(spark, sf_dir).select("id", "username", F.when(F.col("id") % 700 != 0, F.col("xp")).alias("xp")), 10)


def level_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.levels(t.profiles(spark, sf_dir))


def achievement_unlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.achievements(t.profiles(spark, sf_dir))


def _referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'signup' and value > 60").groupBy("user_id").agg(F.count("*").alias("n"))


def referral_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.referral_progress(_referrals(spark, sf_dir))


def entitlement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = _events(spark, sf_dir).where("event_type = 'purchase' and value > 80").select(F.col("user_id").alias("id")).distinct()
    return profile.entitlement(t.profiles(spark, sf_dir), _referrals(spark, sf_dir), trials)


def identity_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.profiles(spark, sf_dir).withColumn("full_name", F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 11 == 0, None).otherwise(F.col("full_name"))).withColumn("show_elite_badge", F.when(F.col("id") % 13 != 0, F.col("show_elite_badge")))
    shown = identity.badge(F.col("is_elite"), F.col("show_elite_badge"))
    return p.select("id", identity.display_name(F.col("full_name"), F.col("anonymous_community")).alias("name"), identity.avatar(F.concat(F.lit("/a/"), F.col("id")), F.col("anonymous_community")).alias("avatar"), shown.alias("badge_feed"), (shown & ~F.col("anonymous_community")).alias("badge_profile"))


def settings_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.settings(t.profiles(spark, sf_dir), _settings(spark, sf_dir)).select("id", "allow_message_requests", "show_likes_on_profile", "show_reposts_on_profile", "notif_sound")


def tab_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.visible_tabs(t.profiles(spark, sf_dir), _settings(spark, sf_dir), 21)


def preference_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = t.profiles(spark, sf_dir).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, F.lit(False)).alias("sound"), F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, "en").alias("language"), F.when(F.col("id") % 5 == 0, F.lit(False)).alias("ai_suggestions"))
    return profile.preferences(stored)


def role_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.profiles(spark, sf_dir).withColumn("role", F.when(F.col("id") % 10 == 0, "admin").otherwise("student"))
    return profile.with_role(p).select("id", "role", "is_elite")


def elite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.profiles(spark, sf_dir).withColumn("is_elite", F.when(F.col("id") % 9 != 0, F.col("is_elite")))
    return profile.elite_only(p).select("id", "is_elite")


def bio_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bios set to what members' documents say: some too long, some blank."""
    p = t.profiles(spark, sf_dir).select("id", F.lit("old").alias("bio"))
    said = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "   ").otherwise(F.concat(F.lit("  "), "text")).alias("bio"))
    return profile.set_bio(p, said)


def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of names: a day's cooldown for elite members, fourteen for others."""
    elite = t.profiles(spark, sf_dir).select(F.col("id").alias("user_id"), "is_elite")
    events = _events(spark, sf_dir).where("event_type = 'signup'").join(elite, "user_id", "left")
    return sequential.decide(events, 1, 14 * 86_400_000_000, inclusive=True, elite_us=86_400_000_000)


def ai_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions in three days; elite members may always ask."""
    elite = t.profiles(spark, sf_dir).select(F.col("id").alias("user_id"), "is_elite")
    return sequential.decide(_events(spark, sf_dir).where("event_type in ('click', 'view')").join(elite, "user_id", "left"), 2, 3 * 86_400_000_000)


def sign_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user of the events who has no profile yet gets one, and a free subscription; what is new of both."""
    known = t.profiles(spark, sf_dir).where("xp > 0").select("id", F.lit("known").alias("role"))
    users = _events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct()
    paid = known.select(F.col("id").alias("user_id"), F.lit("elite").alias("tier"), F.lit("active").alias("status"))
    profiles, subscriptions = mutations.sign_up(known, paid, users)
    return profiles.select("id", "role").join(subscriptions.withColumnRenamed("user_id", "id"), "id")


def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue, server and local values of a key, later ones winning."""
    base = t.profiles(spark, sf_dir).select("id", F.lit("default").alias("v"))
    server = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.lit("server").alias("v")).distinct()
    local = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.lit("local").alias("v")).distinct()
    return mutations.overlay(base, server, local, key="id")


def matching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality with a value and with null, and two lists, one of them a table."""
    posts = t.posts(spark, sf_dir).withColumn("topic", F.when(F.col("topic") != "5-LOW", F.col("topic")))
    low = reads.match(posts, {"status": "O", "topic": None})
    of_few = reads.is_in(reads.is_in(posts, "user_id", t.profiles(spark, sf_dir).where("xp > 5000").select("id")), "topic", ["1-URGENT", None, "", "1-URGENT"])
    return low.unionByName(of_few).select("id", "user_id", "topic")


def unique_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles for all members, of whom many share a base, beside those in use."""
    name = F.when(F.col("id") % 3 == 0, "Sara  Ali").when(F.col("id") % 3 == 1, "علي حسن").otherwise(F.col("full_name"))
    taken = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("sara_ali_"), F.col("s_suppkey")).alias("handle"))
    return handles.assign(t.profiles(spark, sf_dir).select("id", name.alias("name")), taken)


def phone_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click is an attempt: most with nine digits, some with more or fewer, some to clear the phone."""
    phone = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("05-"), F.col("event_id") * 7919 % 12_000_000))
    return sequential.phone_changes(_events(spark, sf_dir).where("event_type = 'click'").select("user_id", "event_id", "ts", phone.alias("phone")))


def policy_write_not_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows that their writer may write: of anybody else."""
    posts = t.posts(spark, sf_dir).select(F.col("id").alias("post_id"), F.col("user_id").alias("followee_id"))
    acts = t.reactions(spark, sf_dir).select("post_id", F.col("user_id").alias("follower_id"))
    return policy.insertable(acts.join(posts, "post_id"), "follows", 4).groupBy("follower_id", "followee_id").agg(F.count("*").alias("n"))


def policy_write_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a user may write: their own, into conversations that they take part in."""
    elsewhere = _messages(spark, sf_dir).withColumn("conversation_id", F.when(F.col("id") % 2 == 0, F.col("conversation_id")).otherwise(F.col("id") % 100))
    return policy.insertable(elsewhere, "messages", 14, _participants(spark, sf_dir)).select("id", "conversation_id", "sender_id")


def policy_write_creator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.posts(spark, sf_dir).select("id", F.col("user_id").alias("created_by"))
    return policy.insertable(rows, "conversations", 7)


def policy_write_anyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anybody who is signed in links tags; nobody else does."""
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("post_id"), F.col("event_type").alias("tag"))
    return policy.insertable(rows, "post_hashtags", 3).unionByName(policy.insertable(rows, "post_hashtags", None))


def signed_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with their signature, some of them forged."""
    body = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id"))
    rows = _events(spark, sf_dir).select("event_id", body.alias("raw"), F.when(F.col("event_id") % 3 != 0, subscriptions.hmac_sha256(body, b"key")).when(F.col("event_id") % 2 == 0, "00").alias("signature"))
    return rows.select("event_id", subscriptions.hmac_sha256(F.col("raw"), b"key").alias("hmac"), subscriptions.signature_valid("raw", "signature", "key").alias("valid"))


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.select_known(t.profiles(spark, sf_dir), ["id", "username", "bio", "show_elite_badge", "role"], {"bio": "", "role": "student"})


def reviews_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 1500).alias("user_id"), (1 + 4 * F.col("quality")).cast("int").alias("rating"))
    return profile.latest_reviews(reviews, t.profiles(spark, sf_dir), 60).select("id", "rating", "username")


def unread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.unread_messages(_participants(spark, sf_dir), _messages(spark, sf_dir))


def unread_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.unread_totals(_participants(spark, sf_dir), _messages(spark, sf_dir))


def unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.unread_notifications(_notifications(spark, sf_dir))


def notifications_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.list_notifications(_notifications(spark, sf_dir), 5, "like").unionByName(inbox.list_notifications(_notifications(spark, sf_dir), 6))


def notification_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.with_links(_notifications(spark, sf_dir), t.profiles(spark, sf_dir).where("xp > 0")).select("id", "text", "icon", "link")


def notifications_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inbox.fan_out(t.reactions(spark, sf_dir), t.posts(spark, sf_dir)).unionByName(inbox.follow_notifications(_follows(spark, sf_dir)), allowMissingColumns=True)
    return made.groupBy("user_id", "actor_id", "type").agg(F.count("*").alias("n"))


def inbox_other_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.other_party(_participants(spark, sf_dir), 9)


def inbox_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _messages(spark, sf_dir).groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("last_message_at"))
    every = _participants(spark, sf_dir).select(F.col("conversation_id").alias("id")).distinct().join(last, "id", "left").withColumn("is_request", F.col("id") % 4 == 1)
    return inbox.conversations_of(every, _participants(spark, sf_dir), 12).unionByName(inbox.conversations_of(every, _participants(spark, sf_dir), 11, requests=True)).select("id", "last_message_at", "is_request")


def thread_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.thread(_messages(spark, sf_dir), 3)


def streaks_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.streaks(_events(spark, sf_dir))


def streak_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.weekly(sequential.streaks(_events(spark, sf_dir)))


def rate_window_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two in three days, so that there are refusals."""
    return sequential.decide(_events(spark, sf_dir).where("event_type in ('click', 'view')"), 2, 3 * 86_400_000_000)


def cooldown_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.decide(_events(spark, sf_dir).where("event_type = 'signup'"), 1, 14 * 86_400_000_000, inclusive=True)


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.reactions(spark, sf_dir).select(F.col("post_id").alias("key"), F.col("seq"), F.when(F.col("kind") == "like", 1).when(F.col("kind") == "dislike", -1).otherwise(0).alias("delta"))


def counters_floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.floored_counters(_moves(spark, sf_dir))


def cooldown_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last"))
    left = timeexpr.remaining_seconds(F.col("last"), 14 * 86400, F.to_timestamp_ntz(F.lit(AS_OF)))
    return last.select("user_id", left.alias("seconds"), timeexpr.remaining_label(left).alias("label"), timeexpr.clock(left * 1000 - 1).alias("clock"))


def relative_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_timestamp_ntz(F.lit(AS_OF))
    labels = (timeexpr.relative_label(F.col("ts"), F.to_timestamp_ntz(F.lit(at))).alias(name) for name, at in LABELS_AS_OF.items())
    return _events(spark, sf_dir).select("event_id", *labels, timeexpr.active_label(F.col("ts"), as_of).alias("active"))


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", F.concat(F.lit("s"), F.col("event_id") % 40).alias("session_id"), F.when(F.col("event_type") == "error", "revoke").otherwise("beat").alias("kind"), "ts")


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.active_sessions(subscriptions.sessions(_beats(spark, sf_dir))).select("user_id", "session_id", "last_active_at")


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type in ('purchase', 'error', 'signup')")
    return e.select(
        (F.col("event_id") % 3000).cast("string").alias("event_id"), F.col("event_id").alias("received"), F.when(F.col("user_id") % 20 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "signup", "subscription_created").otherwise("subscription_updated").alias("event_name"), F.when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "error", "expired").otherwise("").alias("status"), F.col("ts").alias("period_end"),
    )


def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.state(_payments(spark, sf_dir))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"meta":{"event_name":"'), F.col("event_type"), F.lit('","custom_data":{"user_id":"'), F.col("user_id"), F.lit('"}},"data":{"id":"'), F.col("event_id"), F.lit('","attributes":{"ends_at":"x"},"props":'), F.col("props"), F.lit("}}"))
    rows = t.events(spark, sf_dir).select("event_id", raw.alias("raw"))
    parsed = subscriptions.parse_webhook(F.col("raw"))
    return rows.select(F.col("event_id").alias("row_id"), *(c.alias(n) for n, c in parsed.items()), F.get_json_object("raw", "$.data.props.k").cast("long").alias("k"))


def policy_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.visible(_notifications(spark, sf_dir), "notifications", 8).select("id", "type")


def policy_party_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _follows(spark, sf_dir).select(F.col("follower_id").alias("referrer_id"), F.col("followee_id").alias("referred_id"))
    return policy.visible(rows, "referrals", 10).where(policy.may_insert("referrals", 10) | (F.col("referrer_id") == 10))


def policy_membership_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.visible(_messages(spark, sf_dir), "messages", 14, _participants(spark, sf_dir))
    hidden = policy.visible(_messages(spark, sf_dir), "reports", 14)
    return rows.unionByName(hidden).select("id", "conversation_id", "sender_id")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_PARTS = """e as (select event_id, ts, user_id, event_type, value from events),
rd as (select user_id, max(ts) filter (event_type = 'signup') as last_read_at from e group by user_id),
part as (select user_id, last_read_at, unnest([user_id % 10, user_id % 7 + 100]) as conversation_id from rd),
msg as (select event_id as id, user_id % 10 as conversation_id, user_id as sender_id, ts as created_at from e where event_type = 'click'),
um as (select p.user_id, p.conversation_id, count(*) filter (m.created_at > coalesce(p.last_read_at, timestamp '1970-01-01') and m.sender_id <> p.user_id) as unread
       from part p left join msg m on m.conversation_id = p.conversation_id group by all)"""
_NOTE = """n as (select event_id as id, user_id, event_id % 97 as actor_id,
 case event_type when 'signup' then 'follow' when 'error' then 'request_accepted' when 'click' then 'message' when 'view' then 'like' else 'comment' end as type, value > 50 as read, ts as created_at from events)"""
_FOLLOWS = "f as (select l_suppkey as follower_id, o_custkey as followee_id, min(o_orderdate) as created_at from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R' and l_suppkey <> o_custkey group by 1, 2)"
_REFS = "refs as (select user_id, count(*) as n from events where event_type = 'signup' and value > 60 group by user_id)"
_SET = "st as (select c_custkey as user_id, c_custkey % 2 = 0 as amr, case when c_custkey % 4 = 0 then c_custkey % 8 = 0 end as likes, c_custkey % 9 = 0 as reposts from customer where c_custkey % 3 = 0)"
_STREAK = """d as (select distinct user_id, (ts + interval 3 hours)::date as day from events),
r as (select *, sum(case when lag_day is null or day - lag_day <> 1 then 1 else 0 end) over (partition by user_id order by day) as run from (select *, lag(day) over (partition by user_id order by day) as lag_day from d)),
s as (select user_id, day, row_number() over (partition by user_id, run order by day) - 1 as streak from r),
k as (select user_id, max_by(streak, day)::bigint as current_streak, max(streak)::bigint as longest_streak, max(day) as last_day from s group by user_id)"""


def _decisions(where: str, limit: int, window: str, op: str) -> str:
    return f"""
with recursive e as (select user_id, event_id, ts, coalesce(c_mktsegment = 'BUILDING', false) as elite, row_number() over (partition by user_id order by ts, event_id) as i from events left join customer on c_custkey = user_id where {where}),
a(user_id, i, ts) as (select user_id, i, ts from e where i = 1
  union all select user_id, i, ts from (select e.user_id, e.i, e.ts, row_number() over (partition by e.user_id order by e.i) as rn from a join e on e.user_id = a.user_id and e.i > a.i and e.ts - a.ts {op} {window}) where rn = 1)
select user_id, event_id, ts, place <= {limit} as allowed from (
  select e.user_id, e.event_id, e.ts, row_number() over (partition by e.user_id, anchor order by e.i) as place
  from (select e.*, (select max(a.i) from a where a.user_id = e.user_id and a.i <= e.i) as anchor from e) e)"""


def _label(as_of: str) -> str:
    """The label of ts as SQL."""
    s = f"greatest(0, floor(date_diff('microsecond', ts, timestamp '{as_of}') / 1000000.0)::bigint)"
    said = lambda n, one, two, few: f"'قبل ' || case when {n} = 1 then '{one}' when {n} = 2 then '{two}' when {n} between 3 and 10 then {n} || ' {few}' else {n} || ' {one}' end"
    m, h, d, w, mo = f"({s} // 60)", f"({s} // 3600)", f"({s} // 86400)", f"({s} // 86400 // 7)", f"({s} // 86400 // 30)"
    return f"""case when {s} < 45 then 'قبل لحظات' when {m} < 60 then {said(m, "دقيقة", "دقيقتين", "دقائق")} when {h} < 24 then {said(h, "ساعة", "ساعتين", "ساعات")} when {d} < 7 then {said(d, "يوم", "يومين", "أيام")}
 when {w} < 5 then {said(w, "أسبوع", "أسبوعين", "أسابيع")} when {mo} < 12 then {said(mo, "شهر", "شهرين", "أشهر")}
 else day(ts) || ' ' || list_extract(['يناير', 'فبراير', 'مارس', 'أبريل', 'مايو', 'يونيو', 'يوليو', 'أغسطس', 'سبتمبر', 'أكتوبر', 'نوفمبر', 'ديسمبر'], month(ts)) || ' ' || year(ts) end"""


def _hmac(raw: str, key: bytes) -> str:
    """HMAC-SHA256 as SQL, by its definition."""
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({raw}))))"


ORACLE_SQL = {
    "unique_handles": r"""with b as (select c_custkey as id, case c_custkey % 3 when 0 then 'sara_ali' when 1 then 'علي_حسن' else substr(regexp_replace(lower(c_name), '[^a-z0-9_]', '', 'g'), 1, 16) end as base from customer)
select id, base || '_' || (row_number() over (partition by base order by id) + case when base = 'sara_ali' then (select max(s_suppkey) from supplier) else 0 end) as handle from b""",
    "phone_changes": f"""with a as (select user_id, event_id, case when event_id % 11 <> 0 then '05' || (event_id * 7919 % 12000000) else '' end as digits from events where event_type = 'click'),
v as (select event_id, allowed from ({_decisions("event_type = 'click' and (event_id % 11 = 0 or length('05' || (event_id * 7919 % 12000000)) = 9)", 1, "interval 24 hours", ">=")}))
select user_id, event_id, case when v.event_id is null then 'invalid_phone' when allowed then 'changed' else 'phone_cooldown' end as status, case when allowed and digits <> '' then '+966' || digits end as phone from a left join v using (event_id)""",
    "policy_write_not_self": "select l_suppkey as follower_id, o_custkey as followee_id, count(*) as n from lineitem join orders on o_orderkey = l_orderkey where l_suppkey = 4 and o_custkey <> 4 group by all",
    "policy_write_member": f"with {_PARTS}, m as (select id, case when id % 2 = 0 then conversation_id else id % 100 end as conversation_id, sender_id from msg) select * from m where sender_id = 14 and conversation_id in (select conversation_id from part where user_id = 14)",
    "policy_write_creator": "select o_orderkey as id, o_custkey as created_by from orders where o_custkey = 7",
    "policy_write_anyone": "select event_id as post_id, event_type as tag from events",
    "profile_stats": f"""
with {_FOLLOWS}, p as (select o_custkey as id, count(*) as posts, sum(l)::bigint as likes, sum(c)::bigint as reposts from
 (select o_orderkey, o_custkey, count(*) filter (l_returnflag = 'R') as l, count(*) filter (l_returnflag = 'N' and l_linenumber % 2 = 0) as c from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2) group by 1)
select c_custkey as id, coalesce(a.followers, 0) as followers, coalesce(b.following, 0) as following, coalesce(p.posts, 0) as posts, coalesce(p.likes, 0) as likes, coalesce(p.reposts, 0) as reposts
from customer left join (select followee_id, count(*) as followers from f group by 1) a on a.followee_id = c_custkey
left join (select follower_id, count(*) as following from f group by 1) b on b.follower_id = c_custkey left join p on p.id = c_custkey""",
    "leaderboard_view": "select c_custkey as id, c_name as username, c_acctbal as xp, c_mktsegment = 'BUILDING' as is_elite, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer where c_acctbal > 0",
    "leaderboard_topn": """select id, username, xp, row_number() over (order by xp desc nulls first, id) as ordinal from
 (select c_custkey as id, c_name as username, case when c_custkey % 700 <> 0 then c_acctbal end as xp from customer) order by xp desc nulls first, id limit 10""",
    "level_progress": """select id, w // 1000 + 1 as level, w % 1000 as within, floor(w % 1000 / 10.0 + 0.5)::bigint as percent from
 (select c_custkey as id, floor(greatest(c_acctbal, 0))::bigint as w from customer)""",
    "achievement_unlocks": """select c_custkey as id, badge, c_acctbal >= need as unlocked from customer, (values ('first_test', 0), ('week_streak', 50), ('diligent', 100), ('genius', 300), ('elite', 500), ('champion', 1000)) as b(badge, need)""",
    "referral_progress": f"with {_REFS} select user_id, n, greatest(0, 5 - n) as missing, least(100, floor(n / 5.0 * 100 + 0.5)::bigint) as percent, n >= 5 as reward from refs",
    "entitlement_flags": f"""with {_REFS}, tr as (select distinct user_id from events where event_type = 'purchase' and value > 80)
select c_custkey as id, c_mktsegment = 'BUILDING' or coalesce(n, 0) >= 5 as premium, c_mktsegment = 'BUILDING' or coalesce(n, 0) >= 5 or tr.user_id is null as may_play
from customer left join refs on refs.user_id = c_custkey left join tr on tr.user_id = c_custkey""",
    "identity_masking": """select c_custkey as id, case when c_custkey % 7 = 0 then 'مجهول' when c_custkey % 4 = 0 or c_custkey % 11 = 0 then 'مستخدم' else c_name end as name, case when c_custkey % 7 <> 0 then '/a/' || c_custkey end as avatar,
 c_mktsegment = 'BUILDING' and (c_custkey % 13 = 0 or c_custkey % 5 <> 0) as badge_feed, c_mktsegment = 'BUILDING' and (c_custkey % 13 = 0 or c_custkey % 5 <> 0) and c_custkey % 7 <> 0 as badge_profile from customer""",
    "settings_defaults": f"""with {_SET} select c_custkey as id, case when user_id is null then true else amr end as allow_message_requests, case when user_id is null then true else likes end as show_likes_on_profile,
 case when user_id is null then true else reposts end as show_reposts_on_profile, true as notif_sound from customer left join st on user_id = c_custkey""",
    "tab_visibility": f"with {_SET} select c_custkey as id, c_custkey = 21 or coalesce(likes, true) as likes_tab, c_custkey = 21 or coalesce(reposts, true) as reposts_tab from customer left join st on user_id = c_custkey",
    "preference_defaults": "select c_custkey as user_id, c_custkey % 3 <> 0 as sound, case when c_custkey % 4 = 1 then 'en' else 'ar' end as language, c_custkey % 5 <> 0 as ai_suggestions from customer",
    "role_gate": "select c_custkey as id, 'admin' as role, c_mktsegment = 'BUILDING' as is_elite from customer where c_custkey % 10 = 0",
    "elite_gate": "select c_custkey as id, true as is_elite from customer where c_mktsegment = 'BUILDING' and c_custkey % 9 <> 0",
    "bio_updates": """with n as (select doc_id, case when lang = 'de' then '' else trim('  ' || text, ' ') end as b from documents)
select c_custkey as id, case when doc_id is null or length(b) > 300 then 'old' else nullif(b, '') end as bio from customer left join n on doc_id = c_custkey""",
    "name_changes": _decisions("event_type = 'signup'", 1, "case when elite then interval 1 day else interval 14 days end", ">="),
    "ai_usage": _decisions("event_type in ('click', 'view')", 2, "case when elite then interval '-1000 days' else interval 3 days end", ">"),
    "sign_ups": """with k as (select c_custkey as id from customer where c_acctbal > 0), u as (select distinct user_id as id from events)
select id, 'known' as role, 'elite' as tier, 'active' as status from k union all select id, 'student', 'free', 'inactive' from u where id not in (select id from k)""",
    "settings_overlay": """select coalesce(c_custkey, user_id) as id, case when l then 'local' when user_id is not null then 'server' else 'default' end as v
from customer full join (select user_id, bool_or(event_type = 'purchase') as l from events group by 1) on user_id = c_custkey""",
    "matching_rows": """select o_orderkey as id, o_custkey as user_id, null as topic from orders where o_orderstatus = 'O' and o_orderpriority = '5-LOW'
union all select o_orderkey, o_custkey, o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_custkey in (select c_custkey from customer where c_acctbal > 5000)""",
    "signed_webhooks": f"select event_id, {_hmac("event_type || ':' || event_id", b'key')} as hmac, event_id % 3 <> 0 as valid from events",
    "missing_columns": "select c_custkey as id, c_name as username, '' as bio, c_custkey % 5 <> 0 as show_elite_badge, 'student' as role from customer",
    "reviews_latest": "select l.doc_id as id, (1 + 4 * l.quality)::int as rating, c_name as username from (select * from labels order by doc_id desc limit 60) l left join customer on c_custkey = l.doc_id % 1500",
    "unread_messages": f"with {_PARTS} select * from um",
    "unread_totals": f"with {_PARTS} select user_id, sum(unread)::bigint as unread from um group by user_id",
    "unread_notifications": "select user_id, count(*) filter (not value > 50) as unread from events group by user_id",
    "notifications_by_type": f"with {_NOTE} (select * from n where user_id = 5 and type = 'like' order by created_at desc, id desc limit 60) union all (select * from n where user_id = 6 order by created_at desc, id desc limit 60)",
    "notification_links": f"""with {_NOTE} select id, text, icon, case when type = 'follow' and c_name is not null then '/u/' || c_name when type in ('message', 'request_accepted') then '/chat' else '/community' end as link
from n join (values ('follow', 'بدأ بمتابعتك', 'UserPlus'), ('request_accepted', 'قبل طلب رسالتك', 'CheckCheck'), ('message', 'أرسل لك رسالة', 'MessageCircle'), ('like', 'أعجب بمنشورك', 'Heart'), ('comment', 'علّق على منشورك', 'MessageCircle')) as m(type, text, icon) using (type)
left join customer on c_custkey = actor_id and c_acctbal > 0""",
    "notifications_fanout": f"""with {_FOLLOWS}, a as (select o_custkey as user_id, l_suppkey as actor_id, case when l_returnflag = 'R' then 'like' when l_linenumber % 2 = 0 then 'repost' else 'comment' end as type from lineitem join orders on o_orderkey = l_orderkey
 where l_returnflag in ('R', 'N') and o_custkey <> l_suppkey union all select followee_id, follower_id, 'follow' from f) select user_id, actor_id, type, count(*) as n from a group by all""",
    "inbox_other_party": f"with {_PARTS} select conversation_id, max(user_id) as other_id from part where user_id <> 9 and conversation_id in (select conversation_id from part where user_id = 9) group by 1",
    "inbox_conversations": f"""with {_PARTS}, c as (select p.id, max(m.created_at) as last_message_at, p.id % 4 = 1 as is_request from (select distinct conversation_id as id from part) p left join msg m on m.conversation_id = p.id group by 1)
select c.* from c where (not is_request and id in (select conversation_id from part where user_id = 12)) or (is_request and id in (select conversation_id from part where user_id = 11))""",
    "thread_first": f"with {_PARTS} select * from msg where conversation_id = 3 order by created_at, id limit 200",
    "streaks_daily": f"with {_STREAK} select * from k",
    "streak_goals": f"with {_STREAK} select user_id, least(100, floor(least(current_streak, 7) / 7.0 * 100 + 0.5)::bigint) as week_percent, floor(least(1.0, current_streak / 30.0) * 100 + 0.5)::bigint as goal_percent from k",
    "rate_window_decisions": _decisions("event_type in ('click', 'view')", 2, "interval 3 days", ">"),
    "cooldown_decisions": _decisions("event_type = 'signup'", 1, "interval 14 days", ">="),
    "counters_floored": """select key, (sum(d) - least(0, min(s)))::bigint as value from (select *, sum(d) over (partition by key order by seq) as s from
 (select l_orderkey as key, l_linenumber as seq, case l_returnflag when 'R' then 1 when 'A' then -1 else 0 end as d from lineitem)) group by key""",
    "cooldown_remaining": f"""with l as (select user_id, max(ts) filter (event_type = 'signup') as last from events group by 1),
r as (select user_id, coalesce(greatest(0, 1209600 - floor(date_diff('microsecond', last, timestamp '{AS_OF}') / 1000000.0)::bigint), 0) as seconds from l)
select user_id, seconds, (seconds // 86400) || 'd ' || (seconds % 86400 // 3600) || 'h ' || (seconds % 3600 // 60) || 'm ' || (seconds % 60) || 's' as label,
 lpad((seconds // 3600)::varchar, greatest(2, length((seconds // 3600)::varchar))::int, '0') || ':' || lpad((seconds % 3600 // 60)::varchar, 2, '0') || ':' || lpad((seconds % 60)::varchar, 2, '0') as clock from r""",
    "relative_time_label": f"""with b as (select event_id, ts, floor(date_diff('microsecond', ts, timestamp '{AS_OF}') / 60000000.0)::bigint as m from events)
select event_id, {", ".join(f"{_label(at)} as {name}" for name, at in LABELS_AS_OF.items())},
 case when m < 2 then 'Active now' when m < 60 then m || 'm ago' when m // 60 < 24 then (m // 60) || 'h ago' when m // 1440 < 30 then (m // 1440) || 'd ago' else strftime(ts, '%Y-%m-%d') end as active from b""",
    "active_sessions": """select user_id, 's' || (event_id % 40) as session_id, max(ts) filter (event_type <> 'error') as last_active_at from events group by 1, 2
having count(*) filter (event_type = 'error') = 0""",
    "subscription_state": """with w as (select (event_id % 3000)::varchar as event_id, event_id as received, case when user_id % 20 <> 0 then user_id end as user_id, event_type, ts from events where event_type in ('purchase', 'error', 'signup')),
o as (select * from (select *, row_number() over (partition by event_id order by received) as n from w) where n = 1 and user_id is not null),
l as (select user_id, arg_max(event_type, received) as event_type, arg_max(ts, received) as period_end from o group by 1)
select user_id, case when event_type <> 'error' then 'elite' else 'free' end as tier, case when event_type <> 'error' then 'active' else 'inactive' end as status, period_end from l""",
    "json_paths": """select event_id as row_id, event_type as event_name, event_id::varchar as event_id, user_id::varchar as user_id, event_id::varchar as subscription_id, '' as status, 'x' as period_end,
 json_extract_string(props, '$.k')::bigint as k from events""",
    "policy_own_rows": f"with {_NOTE} select id, type from n where user_id = 8",
    "policy_party_or": f"with {_FOLLOWS} select follower_id as referrer_id, followee_id as referred_id from f where follower_id = 10 or followee_id = 10",
    "policy_membership_exists": f"with {_PARTS} select id, conversation_id, sender_id from msg where conversation_id in (select conversation_id from part where user_id = 14)",
}
