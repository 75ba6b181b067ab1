"""Payment events, subscriptions and sessions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and event names that start or end a subscription.
ACTIVE_STATUS, ACTIVE_EVENTS = ("active", "on_trial", "paid"), ("subscription_created", "subscription_payment_success", "order_created")
ENDED_STATUS, ENDED_EVENTS = ("expired", "cancelled", "unpaid"), ("subscription_expired", "subscription_cancelled")


def parse_webhook(raw: Column) -> dict[str, Column]:
    """The fields of a payment event's JSON; missing paths are null."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(raw, p) for p in paths))
    return {
        "event_name": at("$.meta.event_name"), "event_id": at("$.meta.webhook_id", "$.data.id"), "user_id": at("$.meta.custom_data.user_id", "$.data.attributes.custom_data.user_id"),
        "subscription_id": at("$.data.id"), "status": F.coalesce(at("$.data.attributes.status"), F.lit("")), "period_end": at("$.data.attributes.renews_at", "$.data.attributes.ends_at"),
    }


def is_elite(event_name: Column, status: Column) -> Column:
    """Active and not ended, by status or by event."""
    active = F.coalesce(status.isin(*ACTIVE_STATUS), F.lit(False)) | F.coalesce(event_name.isin(*ACTIVE_EVENTS), F.lit(False))
    ended = F.coalesce(status.isin(*ENDED_STATUS), F.lit(False)) | F.coalesce(event_name.isin(*ENDED_EVENTS), F.lit(False))
    return active & ~ended


def state(events: DataFrame) -> DataFrame:
    """user_id, tier, status, period_end: after all events in order of ``received``; the first event of an id counts, users must be known."""
    first = Window.partitionBy("event_id").orderBy("received")
    once = events.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) & F.col("user_id").isNotNull())
    last = once.groupBy("user_id").agg(F.max_by(F.struct("event_name", "status", "period_end"), F.struct("received", "event_id")).alias("e"))
    return tiers(last.select("user_id", "e.*"))


def tiers(last: DataFrame) -> DataFrame:
    """user_id, tier, status, period_end by the last event (event_name, status, period_end) of each user."""
    elite = is_elite(F.col("event_name"), F.col("status"))
    return last.select("user_id", F.when(elite, "elite").otherwise("free").alias("tier"), F.when(elite, "active").otherwise("inactive").alias("status"), "period_end")


def sessions(beats: DataFrame) -> DataFrame:
    """user_id, session_id, last_active_at, revoked_at from heartbeats and revocations; a heartbeat after a revocation doesn't lift it."""
    return beats.groupBy("user_id", "session_id").agg(F.max(F.when(F.col("kind") == "beat", F.col("ts"))).alias("last_active_at"), F.min(F.when(F.col("kind") == "revoke", F.col("ts"))).alias("revoked_at"))


def active_sessions(found: DataFrame) -> DataFrame:
    return found.where(F.col("revoked_at").isNull() & F.col("last_active_at").isNotNull())


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """The HMAC-SHA256 of a text in hex, by two plain hashes over the padded key."""
    block = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def signature_valid(raw: str, signature: str, secret: str) -> Column:
    """Whether a signature column is the HMAC-SHA256 of the raw column."""
    return F.coalesce(hmac_sha256(F.col(raw), secret.encode()) == F.col(signature), F.lit(False))
