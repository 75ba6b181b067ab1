"""Mixing sources to target weights.

The words of all documents are shared out to the sources by weight (5, 2, 1,
repeating in code-point order of the source, null last).  A target stops at
``cap`` times its source's own words; the excess goes to the other sources by
weight until no target is above its cap.  A source's repetition rate is its
target over its words; each document is taken floor(rate) times, and once more
if a hash of its id falls below the fraction, so reruns agree and the
expectation is the target.

Nulls and edges: a null text has size 0, texts of any length count whole, a null source is a source of its own
(the last), a null doc_id hashes as a fixed string, repeated rows count as
often as they occur and get equal copies, an empty table gives no rows.  Only
doc_id, source and text are read; other columns pass through ``expand`` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import WORD, join_small

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs plus ``size``: the words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target.  The windows run over one row per source."""
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    before, from_here = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_code_point))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + F.when(F.col("place") % len(weights) == 0, len(weights)).otherwise(0)))
        .withColumn("level", F.lit(cap) * F.col("source_size") / F.col("weight"))
    )
    # With the sources in order of the level at which they fill up, each one's level if all before it are full:
    filled = sources.withColumns(
        {
            "share": (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(from_here),
        }
    ).withColumn("full", F.col("share") >= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct("level", "place", "share"))).over(everything)["share"]
    return filled.withColumn("final", level).select(
        "source", "source_size", F.when(F.col("full"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target")
    )


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of docs (doc_id, source and others) plus source_size, target and copies."""
    sources = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    joined = join_small(docs, sources, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    return joined.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Rows of ``sized`` plus source_size, target, copies and taken (copies times size)."""
    return with_copies(sized, source_targets(sized, weights, cap), seed).withColumn("taken", F.col("copies") * F.col("size"))


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


ORACLE_SQL = """
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, row_number() over (order by source nulls last) as place from s0),
s2 as (select *, case place % 3 when 1 then 5 when 2 then 2 else 1 end as weight from s1),
s3 as (select *, (3 * source_size)::double / weight as level from s2),
s4 as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by level, place rows between unbounded preceding and 1 preceding), 0))::double
             / sum(weight) over (order by level, place rows between current row and unbounded following) as share from s3),
s5 as (select *, (select arg_min(share, place_order) from (select share, row_number() over (order by level, place) as place_order from s4 where share < level)) as final from s4),
s6 as (select source, source_size, case when share >= level then (3 * source_size)::double else weight * final end as target from s5),
r as (select d.doc_id, d.size, s6.source_size, s6.target,
             case when s6.source_size > 0 then s6.target / s6.source_size else 0.0 end as rate,
             ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint::double / 281474976710656.0 as draw
      from sized d join s6 on d.source is not distinct from s6.source)
select doc_id, size, source_size, target,
       ((floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken
from r
"""
