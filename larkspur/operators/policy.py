"""Row visibility: which rows of a table a viewer may see or write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of the read policy of each table, with the columns that it compares with the viewer.
READ_POLICIES = {
    **{name: ("all",) for name in ("profiles", "community_posts", "post_likes", "post_dislikes", "post_reposts", "post_comments", "reviews", "follows", "user_social_settings", "hashtags", "post_hashtags", "mentions", "achievements")},
    **{name: ("own", "user_id") for name in ("payments", "chat_history", "streaks", "user_preferences", "subscriptions", "user_sessions", "notifications", "message_deletes")},
    "blocks": ("own", "blocker_id"),
    "referrals": ("either", "referrer_id", "referred_id"),
    "message_requests": ("either", "requester_id", "recipient_id"),
    "conversations": ("member", "id"), "conversation_participants": ("member", "conversation_id"), "messages": ("member", "conversation_id"),
    "payment_events": ("none",), "reports": ("none",),
}


def visible(df: DataFrame, table: str, viewer: int, participants: DataFrame | None = None) -> DataFrame:
    """The rows of ``table`` that the viewer may read; an unknown table shows nothing."""
    form, *columns = READ_POLICIES.get(table, ("none",))
    if form == "all":
        return df
    if form in ("own", "either"):
        allowed = F.lit(False)
        for c in columns:
            allowed = allowed | (F.col(c) == viewer)
        return df.where(allowed)
    if form == "member" and participants is not None:
        mine = participants.where(F.col("user_id") == viewer).select(F.col("conversation_id").alias(columns[0])).distinct()
        return df.join(mine, columns[0], "left_semi")
    return df.where(F.lit(False))


#: The column of a new row that must be its writer (user_id elsewhere); columns of which two must differ; tables that any signed-in user writes; tables whose writer must take part in the row's conversation.
WRITERS = {
    "follows": "follower_id", "messages": "sender_id", "notifications": "actor_id", "mentions": "actor_id", "reports": "reporter_id", "blocks": "blocker_id",
    "referrals": "referred_id", "message_requests": "requester_id", "conversations": "created_by",
}
UNLIKE = {"referrals": ("referrer_id", "referred_id"), "follows": ("follower_id", "followee_id"), "message_requests": ("requester_id", "recipient_id")}
ANYONE = ("conversation_participants", "hashtags", "post_hashtags")
MEMBERS = ("messages",)


def may_insert(table: str, viewer: int | None) -> Column:
    """Whether the viewer (None: not signed in) may write a row, as far as the row itself tells; ``insertable`` also asks for the writer's part in a conversation."""
    if viewer is None:
        return F.lit(False)
    if table in ANYONE:
        return F.lit(True)
    own = F.col(WRITERS.get(table, "user_id")) == viewer
    if table in UNLIKE:
        own = own & (F.col(UNLIKE[table][0]) != F.col(UNLIKE[table][1]))
    return F.coalesce(own, F.lit(False))


def insertable(rows: DataFrame, table: str, viewer: int | None, participants: DataFrame | None = None) -> DataFrame:
    """The rows that the viewer may write into ``table``; without participants nothing goes into a conversation."""
    allowed = rows.where(may_insert(table, viewer))
    if table not in MEMBERS:
        return allowed
    if participants is None or viewer is None:
        return allowed.where(F.lit(False))
    return allowed.join(participants.where(F.col("user_id") == viewer).select("conversation_id").distinct(), "conversation_id", "left_semi")


def owns_folder(path: Column, viewer: str) -> Column:
    """Stored objects belong to the user whose id is the first folder."""
    return F.try_element_at(F.split(path, "/"), F.lit(1)) == viewer
