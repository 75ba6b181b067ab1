"""Readers: the driver's Parquet tables, seen as the community's own tables.

Each function returns a lazy DataFrame with the domain's column names, so that
column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table scan by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members: one row each, with privacy flags."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("full_name"),
        F.col("c_acctbal").alias("xp"),
        F.col("c_nationkey").alias("nation_id"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_elite"),
        (F.col("c_custkey") % 7 == 0).alias("anonymous_community"),
        (F.col("c_custkey") % 5 != 0).alias("show_elite_badge"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community posts."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("topic"),
        F.col("o_totalprice").alias("weight"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes, dislikes, reposts and comments on posts, by kind."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_returnflag") == "R", "like").when(F.col("l_returnflag") == "A", "dislike").when(F.col("l_linenumber") % 2 == 0, "repost").otherwise("comment").alias("kind"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey").alias("part_id"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member activity, in event time."""
    return table(spark, sf_dir, "events")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of tutoring chats; turn is the order within a session."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("message_type"), F.col("text").alias("content")
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post bodies whose hash tags are made from source and language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"),
        F.concat(F.lit("#"), F.col("source"), F.lit(" #Lang_"), F.col("lang"), F.lit(" @User"), (F.col("doc_id") % 9).cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"),
    )
