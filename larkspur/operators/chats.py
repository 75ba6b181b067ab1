"""Tutoring chats: sessions from flat messages, titles, search, history for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text

DEFAULT_TITLE = "محادثة جديدة"
TITLE_LENGTH = 38


def role_of(message_type: Column) -> Column:
    """Whatever isn't from the assistant counts as the user's."""
    return F.when(message_type == "assistant", "assistant").otherwise("user")


def sessions(messages: DataFrame) -> DataFrame:
    """session_id, messages in order (order, role, content), created: the first one's place; rows without a session are left out."""
    one = F.struct(F.col("turn").alias("order"), role_of(F.col("message_type")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    known = messages.where(F.coalesce(F.col("session_id").cast("string"), F.lit("")) != "")
    return known.groupBy("session_id").agg(F.sort_array(F.collect_list(one)).alias("messages"), F.min("turn").alias("created"))


def titles(messages: DataFrame, n: int = TITLE_LENGTH) -> DataFrame:
    """session_id, title: the first user message, shortened."""
    first = messages.groupBy("session_id").agg(F.min_by("content", F.when(role_of(F.col("message_type")) == "user", F.col("turn"))).alias("content"), F.count(F.when(role_of(F.col("message_type")) == "user", 1)).alias("n"))
    return first.select("session_id", F.when(F.col("n") == 0, DEFAULT_TITLE).otherwise(text.shorten(text.collapse(F.coalesce("content", F.lit(""))), n)).alias("title"))


def search(messages: DataFrame, query: str) -> DataFrame:
    """Sessions whose title or any message holds the query, whatever the case; all for an empty query."""
    needle = query.strip().lower()
    hits = messages.groupBy("session_id").agg(F.max(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(needle))).alias("in_text"))
    found = titles(messages).join(hits, "session_id")
    return found.where(F.contains(F.lower("title"), F.lit(needle)) | F.col("in_text")).select("session_id", "title")


def model_history(sessions: DataFrame) -> DataFrame:
    """session_id, history: all but the last message, from the first user message on."""
    before = F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))
    told = F.filter(before, lambda m: m["role"].isin("user", "assistant"))
    first = F.array_position(F.transform(told, lambda m: m["role"]), "user")
    kept = F.when(first > 0, F.slice(told, first.cast("int"), F.size(told))).otherwise(F.slice(told, 1, 0))
    return sessions.select("session_id", F.transform(kept, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["content"].alias("content"))).alias("history"))
