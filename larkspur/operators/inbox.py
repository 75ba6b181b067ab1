"""Direct messages and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import blocks

EPOCH = "1970-01-01 00:00:00"
#: Types of notifications that lead to the chat; each type's text and icon (other types are shown as likes).
MESSAGE_TYPES = ("message", "message_request", "request_accepted")
TYPE_TEXTS = {
    "like": ("أعجب بمنشورك", "Heart"),
    "follow": ("بدأ بمتابعتك", "UserPlus"),
    "mention": ("أشار إليك", "AtSign"),
    "repost": ("أعاد نشر منشورك", "Repeat2"),
    "comment": ("علّق على منشورك", "MessageCircle"),
    "message_request": ("أرسل لك طلب رسالة", "MailQuestion"),
    "request_accepted": ("قبل طلب رسالتك", "CheckCheck"),
    "message": ("أرسل لك رسالة", "MessageCircle"),
}
CHAT_PAGE, COMMUNITY_PAGE, PROFILE_PAGE = "/chat", "/community", "/u/"
#: Kinds of reactions that make a notification, and its type; dislikes make none.
NOTIFYING = {"like": "like", "repost": "repost", "comment": "comment"}


def unread_messages(participants: DataFrame, messages: DataFrame, ranges: int = blocks.RANGES) -> DataFrame:
    """user_id, conversation_id, unread: messages of others after the last reading; conversations without any count 0.

    All messages after a mark, less the reader's own, both counted in blocks of
    time, so a busy conversation is spread over tasks and no message meets a
    participant in a join.
    """
    marks = participants.groupBy("conversation_id", "user_id").agg(F.min(_micros(F.coalesce("last_read_at", F.to_timestamp_ntz(F.lit(EPOCH))))).alias("at"))
    sent = messages.groupBy("conversation_id", F.col("sender_id").alias("user_id"), _micros(F.col("created_at")).alias("at")).agg(F.count("*").alias("n"))
    bounds = blocks.cuts(messages.select(_micros(F.col("created_at")).alias("at")), "at", ranges)
    every = blocks.count_later(marks, sent.drop("user_id"), ["conversation_id"], "at", "n", "every", bounds)
    counted = blocks.count_later(every, sent, ["conversation_id", "user_id"], "at", "n", "own", bounds)
    return counted.select("user_id", "conversation_id", (F.col("every") - F.col("own")).alias("unread"))


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def unread_totals(participants: DataFrame, messages: DataFrame) -> DataFrame:
    return unread_messages(participants, messages).groupBy("user_id").agg(F.sum("unread").alias("unread"))


def unread_notifications(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count(F.when(~F.col("read"), 1)).alias("unread"))


def list_notifications(notifications: DataFrame, user_id: int, kind: str = "all", k: int = 60) -> DataFrame:
    """The newest k of one user, of one type unless all are asked for."""
    own = notifications.where(F.col("user_id") == user_id)
    own = own if kind == "all" else own.where(F.col("type") == kind)
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def fan_out(reactions: DataFrame, posts: DataFrame) -> DataFrame:
    """Notifications to post owners of what others did to their posts."""
    kinds = F.create_map(*(F.lit(x) for pair in NOTIFYING.items() for x in pair))
    acts = reactions.where(F.col("kind").isin(*NOTIFYING)).select("post_id", F.col("user_id").alias("actor_id"), F.element_at(kinds, F.col("kind")).alias("type"), "created_at")
    owners = posts.select(F.col("id").alias("post_id"), F.col("user_id").alias("owner_id"))
    return acts.join(owners, "post_id").where("owner_id <> actor_id").select(F.col("owner_id").alias("user_id"), "actor_id", "type", "post_id", "created_at")


def follow_notifications(follows: DataFrame) -> DataFrame:
    return follows.select(F.col("followee_id").alias("user_id"), F.col("follower_id").alias("actor_id"), F.lit("follow").alias("type"), "created_at")


def with_links(notifications: DataFrame, actors: DataFrame) -> DataFrame:
    """The text, icon and target of each notification; actors: id, username."""
    texts = F.create_map(*(x for k, (a, b) in TYPE_TEXTS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("text"), F.lit(b).alias("icon")))))
    shown = F.coalesce(F.try_element_at(texts, F.col("type")), texts["like"])
    handle = F.nullif(F.col("_username"), F.lit(""))
    link = F.when((F.col("type") == "follow") & handle.isNotNull(), F.concat(F.lit(PROFILE_PAGE), handle)).when(F.col("type").isin(*MESSAGE_TYPES), CHAT_PAGE).otherwise(COMMUNITY_PAGE)
    named = notifications.join(actors.select(F.col("id").alias("actor_id"), F.col("username").alias("_username")), "actor_id", "left")
    return named.withColumns({"text": shown["text"], "icon": shown["icon"], "link": link}).drop("_username")


def other_party(participants: DataFrame, viewer: int) -> DataFrame:
    """conversation_id, other_id: of each conversation of the viewer the other participant (the largest id, should there be several)."""
    mine = participants.where(F.col("user_id") == viewer).select("conversation_id")
    others = participants.where(F.col("user_id") != viewer).join(mine, "conversation_id", "left_semi")
    return others.groupBy("conversation_id").agg(F.max("user_id").alias("other_id"))


def conversations_of(conversations: DataFrame, participants: DataFrame, viewer: int, requests: bool = False) -> DataFrame:
    """The viewer's conversations (or requests), last message first, those without any at the end."""
    mine = participants.where(F.col("user_id") == viewer).select(F.col("conversation_id").alias("id"))
    return conversations.where(F.col("is_request") == requests).join(mine, "id", "left_semi").orderBy(F.col("last_message_at").desc_nulls_last(), "id")


def thread(messages: DataFrame, conversation_id: int, k: int = 200) -> DataFrame:
    """The first k messages of a conversation, oldest first."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("created_at", "id").limit(k)
