"""Feed operators: newest posts, their authors, reactions, children and tags.

The limit is applied before any join, so that at most ``k`` rows of the post
table meet another table, whatever the size of the corpus; children are
aggregated before they are joined, so a post never fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import identity, text


#: Kinds of reactions that have a counter and a flag.
KINDS = ("like", "dislike", "repost", "comment")


def newest(posts: DataFrame, k: int) -> DataFrame:
    """Top k by time, newest first; the id breaks ties."""
    return posts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k)


def with_authors(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attach what viewers may see of each author; unknown authors stay null."""
    shown = identity.badge(F.col("is_elite"), F.col("show_elite_badge"))
    who = profiles.select(
        F.col("id").alias("user_id"),
        identity.display_name(F.col("full_name"), F.col("anonymous_community")).alias("author"),
        shown.alias("badge_feed"),
        (shown & ~F.coalesce("anonymous_community", F.lit(False))).alias("badge_profile"),
    )
    joined = posts.join(who, "user_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("badge_feed", "badge_profile")})


def latest_with_authors(posts: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    top = newest(posts, k).select(F.col("id").alias("post_id"), "user_id", "created_at")
    return with_authors(top, profiles).select("post_id", "user_id", "created_at", "author", "badge_feed", "badge_profile")


def my_reactions(posts: DataFrame, reactions: DataFrame, viewer: int, k: int) -> DataFrame:
    """The newest posts with flags for the viewer's own reactions."""
    top = newest(posts, k).select(F.col("id").alias("post_id"), "created_at")
    mine = reactions.where(F.col("user_id") == viewer).groupBy("post_id").agg(*(F.max(F.col("kind") == kind).alias(f"has_{kind}") for kind in KINDS))
    return top.join(mine, "post_id", "left").select("post_id", "created_at", *(F.coalesce(f"has_{kind}", F.lit(False)).alias(f"has_{kind}") for kind in KINDS))


def with_children(posts: DataFrame, reactions: DataFrame, k: int) -> DataFrame:
    """The newest posts with ordered lists of the ids of their likes and comments; empty lists where there are none."""
    top = newest(posts, k).select(F.col("id").alias("post_id"), "created_at")
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("seq"))))
    children = reactions.join(top.select("post_id"), "post_id", "left_semi").groupBy("post_id").agg(listed("like").alias("likes"), listed("comment").alias("comments"))
    none = F.array().cast("array<int>")
    return top.join(children, "post_id", "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("likes", "comments")})


def reaction_counts(posts: DataFrame, reactions: DataFrame) -> DataFrame:
    """Counters of each post, recounted; zero where nobody reacted."""
    counts = reactions.groupBy("post_id").agg(*(F.count(F.when(F.col("kind") == kind, 1)).alias(f"{kind}s_count") for kind in KINDS))
    names = [f"{kind}s_count" for kind in KINDS]
    return posts.select(F.col("id").alias("post_id")).join(counts, "post_id", "left").fillna(0, names)


def in_reaction_order(posts: DataFrame, reactions: DataFrame, user_id: int, kind: str, k: int) -> DataFrame:
    """Posts that a user reacted to, in the order of the reactions; missing posts drop out."""
    mine = reactions.where((F.col("user_id") == user_id) & (F.col("kind") == kind)).groupBy("post_id").agg(F.max("created_at").alias("reacted_at"))
    first = mine.orderBy(F.desc("reacted_at"), F.desc("post_id")).limit(k)
    return first.join(posts.select(F.col("id").alias("post_id"), F.col("user_id").alias("author_id")), "post_id")


def tag_links(bodies: DataFrame) -> DataFrame:
    """post_id, tag: one row for each distinct tag of each post."""
    return bodies.select("post_id", F.explode(text.tags(F.col("content"))).alias("tag"))


def tag_counts(bodies: DataFrame) -> DataFrame:
    return tag_links(bodies).groupBy("tag").agg(F.count("*").alias("post_count"))


def tag_page(posts: DataFrame, links: DataFrame, tag: str, k: int) -> DataFrame:
    """Posts of a tag through the links (post_id, tag), newest first, with the tag's post_count; of the links the k lowest ids count."""
    every = links.where(F.col("tag") == tag.lower())
    first = every.orderBy("post_id").limit(k).join(every.groupBy("tag").agg(F.count("*").alias("post_count")), "tag").select("post_id", "post_count")
    return posts.join(first, posts["id"] == first["post_id"]).select("post_id", "user_id", "created_at", "post_count").orderBy(F.desc("created_at"), F.desc("post_id"))


def tag_page_by_pattern(posts: DataFrame, bodies: DataFrame, tag: str, k: int) -> DataFrame:
    """Where no links exist: a case-insensitive pattern, in which the tag's own _ and % stay wildcards; newest first."""
    found = bodies.where(F.col("content").ilike(f"%#{tag}%")).select(F.col("post_id").alias("id"))
    return newest(posts.join(found, "id"), k).select(F.col("id").alias("post_id"), "created_at")


def prepend(shown: DataFrame, inserted: DataFrame) -> DataFrame:
    """New rows before the shown ones; a row that is shown already isn't added again."""
    new = inserted.dropDuplicates(["id"]).join(shown.select("id"), "id", "left_anti")
    return new.withColumn("is_new", F.lit(True)).unionByName(shown.withColumn("is_new", F.lit(False)))
