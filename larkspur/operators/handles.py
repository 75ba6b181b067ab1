"""Unique internal handles made from names that needn't be unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import blocks

#: A base, an underscore and a number without leading zeros; longer numbers are out of reach, so they never clash.
NUMBERED = r"^(.*)_([1-9][0-9]{0,14})$"


def assign(members: DataFrame, taken: DataFrame, ranges: int = blocks.RANGES) -> DataFrame:
    """id, handle of each member (id numeric, name): the name's base and a number.

    A base's numbers go on from the highest one in use (``taken``: handle), in the
    order of ids, so reruns agree.  A handle gives back its base and number (the
    last underscore parts them), so no two are equal.  A base that a third of all
    members share is numbered in ranges of ids.  Null and blank names have the
    base ``user``; an id that occurs twice has two handles.
    """
    based = members.select("id", text.handle_base(F.col("name")).alias("base"))
    used = taken.where(F.col("handle").rlike(NUMBERED)).groupBy(F.regexp_extract("handle", NUMBERED, 1).alias("base")).agg(F.max(F.regexp_extract("handle", NUMBERED, 2).cast("long")).alias("_used"))
    numbered = blocks.numbered(based, ["base"], "id", "_n", ranges).join(used, "base", "left")
    return numbered.select("id", F.concat_ws("_", "base", (F.col("_n") + F.coalesce("_used", F.lit(0))).cast("string")).alias("handle"))
