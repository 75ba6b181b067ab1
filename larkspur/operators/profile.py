"""Profiles: statistics, leaderboards, levels, settings and entitlement."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text, timeexpr
from larkspur.operators.joins import join_by_size

REFERRALS_NEEDED = 5
BIO_LENGTH = 300
#: Experience needed for each badge, in order.
BADGES = (("first_test", 0), ("week_streak", 50), ("diligent", 100), ("genius", 300), ("elite", 500), ("champion", 1000))
SETTINGS_DEFAULTS = {
    "allow_message_requests": True, "hide_message_requests": False, "allow_messages": True, "notif_sound": True,
    "show_likes_on_profile": True, "show_reposts_on_profile": True, "notify_followers": True, "notify_mentions": True,
}


def select_known(df: DataFrame, wanted: list[str], defaults: dict | None = None) -> DataFrame:
    """The wanted columns; those that an older table lacks come as their default."""
    return df.select(*(F.col(c) if c in df.columns else F.lit((defaults or {}).get(c)).alias(c) for c in wanted))


def statistics(profiles: DataFrame, posts: DataFrame, follows: DataFrame) -> DataFrame:
    """Followers, following, posts and sums of reactions of each profile, zero where there are none."""
    followers = follows.groupBy(F.col("followee_id").alias("id")).agg(F.count("*").alias("followers"))
    following = follows.groupBy(F.col("follower_id").alias("id")).agg(F.count("*").alias("following"))
    written = posts.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("posts"), F.sum(F.coalesce("likes_count", F.lit(0))).alias("likes"), F.sum(F.coalesce("reposts_count", F.lit(0))).alias("reposts"))
    made = profiles.select("id").join(followers, "id", "left").join(following, "id", "left").join(written, "id", "left")
    return made.fillna(0, ["followers", "following", "posts", "likes", "reposts"])


def leaderboard_view(profiles: DataFrame, buckets: int = 64) -> DataFrame:
    """Everybody with experience, ranked; ties by id."""
    return number_rows(profiles.where(F.col("xp") > 0), "rank", "xp", "id", buckets)


def number_rows(rows: DataFrame, name: str, by: str, tie: str, buckets: int) -> DataFrame:
    """Numbers from 1 by a numeric column, highest first, then by ``tie``, without gathering all rows in one task.

    Approximate quantiles cut the values into buckets, and the ties of a value
    that fills several of them by quantiles of ``tie``; rows are numbered within
    theirs, and the sizes of the buckets above (at most ``buckets`` rows) are added.
    """
    bounds = Counter(rows.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.01))
    below = [F.col(by) < F.lit(v) for v, times in bounds.items() if times == 1]
    for v, times in bounds.items():
        if times > 1:
            same = rows.where(F.col(by) == F.lit(v))
            below += [(F.col(by) < F.lit(v)) | ((F.col(by) == F.lit(v)) & (F.col(tie) > F.lit(cut))) for cut in same.approxQuantile(tie, [i / times for i in range(1, times)], 0.01)]
    bucket = sum((c.cast("int") for c in below), F.lit(0))
    placed = rows.withColumn("_bucket", bucket)
    placed = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc(by), tie)))
    sizes = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_bucket").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_before")


def leaderboard_top(profiles: DataFrame, k: int = 10) -> DataFrame:
    """The first k with their ordinal; missing experience sorts first, as the platform's database has it."""
    top = profiles.orderBy(F.col("xp").desc_nulls_first(), "id").limit(k)
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("xp").desc_nulls_first(), "id")).cast("long"))


def levels(profiles: DataFrame) -> DataFrame:
    """Level, points within it, and progress to the next as a percentage."""
    whole = F.floor(F.greatest(F.coalesce("xp", F.lit(0.0)), F.lit(0.0))).cast("long")
    return profiles.select("id", (F.floor(whole / 1000) + 1).cast("long").alias("level"), (whole % 1000).alias("within"), timeexpr.half_up(whole % 1000 / 10).alias("percent"))


def achievements(profiles: DataFrame) -> DataFrame:
    """profile, badge, unlocked: each profile against the fixed list of badges."""
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("badge"), F.lit(need).alias("need")) for name, need in BADGES))).alias("rule")
    return profiles.select("id", "xp", rules).select("id", "rule.badge", (F.coalesce("xp", F.lit(0.0)) >= F.col("rule.need")).alias("unlocked"))


def referral_progress(counts: DataFrame, needed: int = REFERRALS_NEEDED) -> DataFrame:
    """For user_id, n: how many are missing, percent, reward."""
    n = F.col("n")
    return counts.select("user_id", "n", F.greatest(F.lit(0), needed - n).cast("long").alias("missing"), F.least(F.lit(100), timeexpr.half_up(n / needed * 100)).cast("long").alias("percent"), (n >= needed).alias("reward"))


def entitlement(profiles: DataFrame, referrals: DataFrame, trials: DataFrame, needed: int = REFERRALS_NEEDED) -> DataFrame:
    """premium: elite or enough referrals; may_play: premium or the free trial unused."""
    made = profiles.select("id", "is_elite").join(referrals.withColumnRenamed("user_id", "id"), "id", "left").join(trials.withColumn("tried", F.lit(True)), "id", "left")
    premium = F.coalesce("is_elite", F.lit(False)) | (F.coalesce("n", F.lit(0)) >= needed)
    return made.select("id", premium.alias("premium"), (premium | F.col("tried").isNull()).alias("may_play"))


def settings(profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """Each profile's settings: the stored row, null values too, or the defaults where there is no row."""
    found = stored.withColumn("_stored", F.lit(True))
    made = profiles.select("id").join(found.withColumnRenamed("user_id", "id"), "id", "left")
    return made.select("id", *(F.when(F.col("_stored").isNull(), F.lit(d)).otherwise(F.col(c)).alias(c) if c in stored.columns else F.lit(d).alias(c) for c, d in SETTINGS_DEFAULTS.items()))


def preferences(stored: DataFrame) -> DataFrame:
    """Preference values with defaults for each: sound and suggestions when null, language when null or empty."""
    return stored.select(
        "user_id", F.coalesce("sound", F.lit(True)).alias("sound"), F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("ar")).alias("language"), F.coalesce("ai_suggestions", F.lit(True)).alias("ai_suggestions")
    )


def visible_tabs(profiles: DataFrame, stored: DataFrame, viewer: int) -> DataFrame:
    """Whether the viewer sees the likes and reposts of each profile: hidden only if switched off, and never from oneself."""
    joined = profiles.select("id").join(stored.withColumnRenamed("user_id", "id"), "id", "left")
    seen = lambda c: (F.col("id") == viewer) | ~F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    return joined.select("id", seen("show_likes_on_profile").alias("likes_tab"), seen("show_reposts_on_profile").alias("reposts_tab"))


def with_role(profiles: DataFrame, role: str = "admin") -> DataFrame:
    """Profiles that pass a role gate; being elite doesn't help."""
    return profiles.where(F.col("role") == role)


def elite_only(profiles: DataFrame) -> DataFrame:
    """Profiles that pass the elite gate; no role helps."""
    return profiles.where(F.coalesce("is_elite", F.lit(False)))


def set_bio(profiles: DataFrame, changes: DataFrame, longest: int = BIO_LENGTH) -> DataFrame:
    """id, bio after changes (id, bio): trimmed, blank as null; one that is too long changes nothing."""
    new = changes.select("id", text.bio(F.col("bio")).alias("_bio"), F.lit(True).alias("_set")).where(F.coalesce(F.length("_bio"), F.lit(0)) <= longest)
    return profiles.select("id", "bio").join(new, "id", "left").select("id", F.when(F.col("_set"), F.col("_bio")).otherwise(F.col("bio")).alias("bio"))


def latest_reviews(reviews: DataFrame, profiles: DataFrame, k: int = 60) -> DataFrame:
    """The newest k reviews with the handle of their author."""
    top = reviews.orderBy(F.desc("id")).limit(k)
    return join_by_size(top, profiles.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
