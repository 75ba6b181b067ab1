"""Rules in which a row depends on what was decided before it.

Streaks and floored counters need windows only.  Rate windows and cooldowns
depend on earlier decisions, so they fold the ordered events of one user; the
fold streams over sorted rows and keeps one user's open window, never all events
of a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text, timeexpr


def streaks(events: DataFrame) -> DataFrame:
    """user_id, current_streak, longest_streak, last_day: days in a row (Riyadh's calendar), the first of a run counting 0."""
    days = events.select("user_id", timeexpr.riyadh_day(F.col("ts")).alias("day")).distinct()
    by_user = Window.partitionBy("user_id").orderBy("day")
    broken = F.coalesce(F.datediff("day", F.lag("day").over(by_user)) != 1, F.lit(True)).cast("int")
    runs = days.withColumn("run", F.sum(broken).over(by_user))
    streak = runs.withColumn("streak", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("day")) - 1)
    return streak.groupBy("user_id").agg(F.max_by("streak", "day").cast("long").alias("current_streak"), F.max("streak").cast("long").alias("longest_streak"), F.max("day").alias("last_day"))


def weekly(streak: DataFrame) -> DataFrame:
    """Percent of a week, and of the thirty-day goal, that the current streak makes."""
    s = F.col("current_streak")
    return streak.select("user_id", F.least(F.lit(100), timeexpr.half_up(F.least(s, F.lit(7)) / 7 * 100)).cast("long").alias("week_percent"), timeexpr.half_up(F.least(F.lit(1.0), s / 30) * 100).alias("goal_percent"))


def decide(events: DataFrame, limit: int, window_us: int, inclusive: bool = False, elite_us: int | None = None) -> DataFrame:
    """user_id, event_id, ts, allowed: at most ``limit`` allowed in a window that opens with an allowed event.

    If events have a column is_elite, elite users' windows are elite_us long, or
    all their events are allowed (None).

    A new window opens when more than window_us (or, inclusive, at least that
    much) has passed since the open one began; denied events change nothing.
    A cooldown is limit 1, inclusive.
    """
    elite = F.coalesce("is_elite", F.lit(False)) if "is_elite" in events.columns else F.lit(False)
    length = F.when(elite, F.lit(elite_us).cast("long")).otherwise(F.lit(window_us))
    kept = events.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), length.alias("length"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = object(), None, 0
        for batch in batches:
            allowed = []
            for user, us, length in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if length is None:
                    allowed.append(True)
                    continue
                if user != last:
                    last, start, n = user, None, 0
                if start is None or (us - start >= length if inclusive else us - start > length):
                    start, n, ok = us, 1, True
                else:
                    ok = n < limit
                    n += ok
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed, pa.bool_())], names=["user_id", "event_id", "ts", "allowed"])

    ordered = kept.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id", "ts")
    return ordered.mapInArrow(run, f"user_id {types['user_id']}, event_id {types['event_id']}, ts {types['ts']}, allowed boolean")


def phone_changes(attempts: DataFrame, cooldown_us: int = 24 * 3_600_000_000) -> DataFrame:
    """user_id, event_id, status, phone of each attempt (user_id, event_id, ts, phone) to set a phone, or to clear it by one without digits.

    Numbers of other than nine digits are invalid and start no cooldown; a change
    is allowed once the cooldown since the last one is over.
    """
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", "")
    checked = attempts.withColumn("_valid", (digits == "") | text.phone_valid(F.col("phone")))
    verdicts = decide(checked.where("_valid"), 1, cooldown_us, inclusive=True).select("user_id", "event_id", F.when(F.col("allowed"), "changed").otherwise("phone_cooldown").alias("status"))
    made = verdicts.join(attempts.select("event_id", text.phone(F.col("phone")).alias("_new")), "event_id").select("user_id", "event_id", "status", F.when(F.col("status") == "changed", F.col("_new")).alias("phone"))
    return made.unionByName(checked.where("not _valid").select("user_id", "event_id", F.lit("invalid_phone").alias("status"), F.lit(None).cast("string").alias("phone")))


def floored_counters(deltas: DataFrame) -> DataFrame:
    """key, value: a counter moved by deltas in order that never goes below 0.

    The end of such a walk is its sum plus the depth of its deepest point below
    zero, which windows find without a fold.
    """
    sums = deltas.withColumn("sum", F.sum("delta").over(Window.partitionBy("key").orderBy("seq")))
    return sums.groupBy("key").agg((F.sum("delta") - F.least(F.lit(0), F.min("sum"))).cast("long").alias("value"))
