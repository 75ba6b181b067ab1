"""Feed reads: newest posts, reactions, children, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import feed
from larkspur.sources import tables as t


def feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.latest_with_authors(t.posts(spark, sf_dir), t.profiles(spark, sf_dir), 40)


def feed_with_my_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.my_reactions(t.posts(spark, sf_dir), t.reactions(spark, sf_dir), 7, 400)


def posts_embed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = feed.with_children(t.posts(spark, sf_dir), t.reactions(spark, sf_dir), 200)
    return made.select("post_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("likes", "comments")))


def reaction_counts_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.reaction_counts(t.posts(spark, sf_dir), t.reactions(spark, sf_dir))


def profile_reposts_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.in_reaction_order(t.posts(spark, sf_dir), t.reactions(spark, sf_dir), 3, "repost", 30)


def hashtag_page_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's posts with their authors, through the links of the bodies that hold it (a body's id is a post's)."""
    holding = t.bodies(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("#src1")))
    page = feed.tag_page(t.posts(spark, sf_dir), feed.tag_links(holding), "Src1", 50)
    return page.join(t.profiles(spark, sf_dir).select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def hashtag_page_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.tag_page_by_pattern(t.posts(spark, sf_dir), t.bodies(spark, sf_dir), "src_", 50)


def hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.tag_counts(t.bodies(spark, sf_dir))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = t.bodies(spark, sf_dir)
    return bodies.select("post_id", F.array_join(F.array_sort(text.tags(F.col("content"))), ",").alias("tags"), F.array_join(F.array_sort(text.mentions(F.col("content"))), ",").alias("handles"))


def feed_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled orders are shown; all others, and some that are shown, come in, twice."""
    posts = t.posts(spark, sf_dir)
    shown, inserted = (posts.where(c).select("id", "user_id", "created_at") for c in ("status = 'F'", "status <> 'F' or topic = '1-URGENT'"))
    return feed.prepend(shown, inserted.unionByName(inserted))


QUERIES = {f.__name__: f for f in (feed_latest, feed_with_my_reactions, posts_embed_children, reaction_counts_reconcile, profile_reposts_ordered, hashtag_page_indexed, hashtag_page_ilike, hashtag_counts, entity_extract, feed_prepend)}

_BODIES = "bodies as (select doc_id as post_id, '#' || source || ' #Lang_' || lang || ' @User' || (doc_id % 9) || ' ' || coalesce(text, '') as content from documents)"
_SPACE = r"[\s\x0b\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_LINKS = rf"links as (select distinct post_id, lower(unnest(regexp_extract_all(content, '(?:^|{_SPACE})#([0-9A-Za-z_\x{{0600}}-\x{{06FF}}]{{2,50}})', 1))) as tag from bodies)"
_COMMENT, _REPOST = "(l_returnflag = 'N' and l_linenumber % 2 = 1)", "(l_returnflag = 'N' and l_linenumber % 2 = 0)"
_TOP = "(select o_orderkey as post_id, o_custkey as user_id, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey desc limit {})"

ORACLE_SQL = {
    "feed_latest": f"""
select p.post_id, p.user_id, p.created_at,
       case when c.c_custkey % 7 = 0 then 'مجهول' else c.c_name end as author,
       coalesce(c.c_mktsegment = 'BUILDING' and c.c_custkey % 5 <> 0, false) as badge_feed,
       coalesce(c.c_mktsegment = 'BUILDING' and c.c_custkey % 5 <> 0 and c.c_custkey % 7 <> 0, false) as badge_profile
from {_TOP.format(40)} p left join customer c on c.c_custkey = p.user_id""",
    "feed_with_my_reactions": f"""
select p.post_id, p.created_at, count(*) filter (l_returnflag = 'R') > 0 as has_like, count(*) filter (l_returnflag = 'A') > 0 as has_dislike,
       count(*) filter ({_REPOST}) > 0 as has_repost, count(*) filter ({_COMMENT}) > 0 as has_comment
from {_TOP.format(400)} p left join lineitem on l_orderkey = p.post_id and l_suppkey = 7 group by all""",
    "posts_embed_children": f"""
select p.post_id, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber) filter (l_returnflag = 'R'), '') as likes,
       coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber) filter ({_COMMENT}), '') as comments
from {_TOP.format(200)} p left join lineitem on l_orderkey = p.post_id group by p.post_id""",
    "reaction_counts_reconcile": f"""
select o_orderkey as post_id, count(*) filter (l_returnflag = 'R') as likes_count, count(*) filter (l_returnflag = 'A') as dislikes_count,
       count(*) filter ({_REPOST}) as reposts_count, count(*) filter ({_COMMENT}) as comments_count
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
    "profile_reposts_ordered": f"""
with m as (select l_orderkey as post_id, max(l_shipdate) as reacted_at from lineitem where l_suppkey = 3 and {_REPOST} group by l_orderkey
           order by reacted_at desc, post_id desc limit 30)
select m.post_id, m.reacted_at, o_custkey as author_id from m join orders on o_orderkey = m.post_id""",
    "hashtag_page_indexed": f"with {_BODIES}, {_LINKS}, l as (select post_id from links where tag = 'src1' order by post_id limit 50) select o_orderkey as post_id, o_custkey as user_id, o_orderdate as created_at, (select count(*) from links where tag = 'src1') as post_count, c_name as username from orders left join customer on c_custkey = o_custkey where o_orderkey in (select post_id from l)",
    "hashtag_page_ilike": f"with {_BODIES} select post_id, o_orderdate as created_at from bodies join orders on o_orderkey = post_id where content ilike '%#src_%' order by o_orderdate desc, post_id desc limit 50",
    "hashtag_counts": f"with {_BODIES}, {_LINKS} select tag, count(*) as post_count from links group by tag",
    "entity_extract": rf"""
with {_BODIES}, {_LINKS}, m as (select distinct post_id, lower(unnest(regexp_extract_all(content, '(?:^|{_SPACE})@([0-9A-Za-z_]{{2,30}})', 1))) as handle from bodies),
a as (select post_id, string_agg(tag, ',' order by tag) as tags from links group by post_id), b as (select post_id, string_agg(handle, ',' order by handle) as handles from m group by post_id)
select post_id, coalesce(tags, '') as tags, coalesce(handles, '') as handles from bodies left join a using (post_id) left join b using (post_id)""",
    "feed_prepend": """
select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at, o_orderstatus <> 'F' as is_new from orders""",
}
