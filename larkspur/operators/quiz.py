"""Quizzes: drawing questions and scoring answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import timeexpr

XP_PER_ANSWER = 10


def draw(questions: DataFrame, k: int, seed: int) -> DataFrame:
    """k questions (all, if there are fewer) in an order drawn by seed, with shuffled options and the answer's new place."""
    by = lambda *parts: F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    picked = questions.orderBy(by("id"), "id").limit(k)
    tagged = F.transform("options", lambda o, i: F.struct(by("id", i).alias("by"), i.alias("was"), o.alias("option")))
    mixed = picked.withColumn("mixed", F.sort_array(tagged))
    return mixed.select(
        "id", F.transform("mixed", lambda m: m["option"]).alias("options"), (F.array_position(F.transform("mixed", lambda m: m["was"]), F.col("answer_index")) - 1).cast("int").alias("answer_index")
    )


def grade(answers: DataFrame) -> DataFrame:
    """Each answer (attempt, question, choice, answer) as correct, or as timed out when there is no choice."""
    return answers.withColumns({"correct": F.coalesce(F.col("choice") == F.col("answer"), F.lit(False)), "timed_out": F.col("choice").isNull()})


def score(graded: DataFrame) -> DataFrame:
    """attempt, correct, total, xp, percent."""
    one = graded.groupBy("attempt").agg(F.count(F.when(F.col("correct"), 1)).alias("correct"), F.count("*").alias("total"))
    return one.select("attempt", "correct", "total", (F.col("correct") * XP_PER_ANSWER).alias("xp"), timeexpr.half_up(F.col("correct") / F.col("total") * 100).alias("percent"))
