"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct shingles of four lower-cased words; documents
link if 100 times the intersection is at least ``percent`` times the union.  A
signature has COORDINATES numbers, each the least value of the set under its own
hash; two sets agree on a coordinate with a probability equal to their similarity.

Plan at scale:

1. One pass makes sets and signatures; equal sets are one class, so a group of
   copies, however large, is one row from then on.
2. The inverted join: classes are posted under coordinate-value pairs.  Two
   classes are a candidate if they collide on at least MATCHES coordinates (32 of
   64: a link of similarity 0.8 has fewer with a probability of 1e-8), so both
   have one of their collisions among any COORDINATES - MATCHES + 1 coordinates,
   taken in one order for all classes: the prefix.  The order is by how often a
   pair occurs (counted in a sketch of fixed size; any order is right), so pairs
   that half the corpus has are posted by those classes only that have nothing rarer.
3. Lists are merged within buckets by counting collisions, coordinate after
   coordinate; whatever can't reach MATCHES any more, or already hangs together, is
   skipped.  Candidates are confirmed on the whole sets, and the components of
   the links are found on Spark: see ``confirm`` and ``components``.

Shingles are compared by 64-bit hashes of theirs, sets in classes by 128 bits.

Nulls and edges: a null or wordless text has the empty set, links with nothing
and is its own component; fewer than four words are one shingle; texts of any
length are read whole; a null doc_id is kept, and never the smallest id of a
group that has another (its component is null if it has none); repeated rows and
ids are copies or different texts like any others; an empty table gives no rows;
columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import confirm
from larkspur.llm.shared import join_hot, join_wide, materialise

SHINGLE = 4
PERCENT = 80
COORDINATES, MATCHES = 64, 32
PREFIX = COORDINATES - MATCHES + 1
#: Cells of the sketch in which coordinate-value pairs are counted.
SKETCH = 1 << 18
#: Shingles hashed, and signatures compared, at once.
AT_ONCE, COMPARED = 4096, 1 << 22

_seeds = confirm.mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _seeds[:COORDINATES] | np.uint64(1), _seeds[COORDINATES:]


def signature(shingles: np.ndarray) -> bytes:
    """The least 32-bit value of each coordinate's hash over the shingles: all low halves, then all high ones.

    Values are posted whole, and compared by their low halves, which count a false
    collision once in 65,536 times and never miss one.
    """
    least = np.full(COORDINATES, ~np.uint64(0))
    for at in range(0, len(shingles), AT_ONCE):
        np.minimum(least, (shingles[at : at + AT_ONCE, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    values = (least >> np.uint64(32)).astype("<u4")
    return np.concatenate([values.astype("<u2"), (values >> 16).astype("<u2")]).tobytes()


def values_of(sigs: list[bytes]) -> np.ndarray:
    """The values of signatures, a row each."""
    halves = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, 2, COORDINATES).astype(np.uint32)
    return halves[:, 0] | halves[:, 1] << np.uint32(16)


def postings(sigs: np.ndarray) -> np.ndarray:
    """A number for each coordinate-value pair of each signature."""
    return confirm.mixed(sigs.astype(np.uint64) | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=1)


def merged(sigs: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of unlike labels that collide on MATCHES coordinates or more.

    Rows lie by label, so a row meets only what comes after its own group.  Once so
    many coordinates are counted that most pairs can't reach the threshold, the
    rest is counted for the others alone.
    """
    order = np.argsort(labels, kind="stable")
    sigs, labels = sigs[order], labels[order]
    n, columns = len(sigs), np.ascontiguousarray(sigs.T)
    ends = np.searchsorted(labels, labels, "right")
    first = MATCHES + (COORDINATES - MATCHES) // 2
    at = 0
    while at < n and (begin := int(ends[at])) < n:
        rows = min(n, at + max(1, COMPARED // (n - begin)))
        count = np.zeros((rows - at, n - begin), np.uint8)
        for c in columns[:first]:
            count += c[at:rows, None] == c[None, begin:]
        i, j = np.nonzero(count >= MATCHES - (COORDINATES - first))
        so_far = count[i, j]
        i, j = i + at, j + begin
        unlike = (labels[i] != labels[j]) & (i < j)
        i, j, so_far = i[unlike], j[unlike], so_far[unlike]
        enough = so_far + (sigs[i, first:] == sigs[j, first:]).sum(axis=1) >= MATCHES
        yield order[i[enough]], order[j[enough]]
        at = rows


SEARCH = confirm.Search("<u2", COORDINATES, MATCHES, collisions, merged, PERCENT)


def frequencies(classes: DataFrame) -> np.ndarray:
    """How many classes have the coordinate-value pairs of each cell of the sketch: one number a cell and task, added up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                sigs = values_of(batch.column(0).slice(at, 2048).to_pylist())
                np.add.at(total, (postings(sigs) % np.uint64(SKETCH)).astype(np.int64).ravel(), 1)
        some = np.flatnonzero(total > 1)  # what one task has once is left out: any order is right
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    counted = classes.select("sig").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most SKETCH rows
    total = np.zeros(SKETCH, np.int64)
    total[counted["cell"].to_numpy(int)] = counted["n"].to_numpy()
    return total


def with_prefix(classes: DataFrame) -> DataFrame:
    """classes plus buckets: the PREFIX rarest coordinate-value pairs of each."""
    order = classes.sparkSession.sparkContext.broadcast(np.minimum(frequencies(classes), (1 << 31) - 1).astype(np.int32))  # 4 bytes a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column(batch.schema.get_field_index("sig"))
            posted = postings(values_of(sig.to_pylist()))
            often = order.value[(posted % np.uint64(SKETCH)).astype(np.int64)]
            chosen = np.take_along_axis(posted, np.lexsort((posted, often), axis=1)[:, :PREFIX], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chosen.size + 1, PREFIX, dtype=np.int32)), pa.array(chosen.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{fields}, buckets array<long>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group), kept (doc_id is component_id)."""
    texts = confirm.with_text_key(docs.select("doc_id", "text"))
    rows = materialise(confirm.coded(texts, shingle, signature), "signatures")
    of_class, hot = confirm.groups(rows, texts.select("th", "text"), shingle, with_prefix, SEARCH)
    smallest = of_class.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    by_class = join_wide(of_class, smallest, "root").select("code", "component_id")
    narrow = rows.select("doc_id", "code", F.col("size").alias("n_shingles"))
    linked = join_hot(narrow.where("code is not null"), by_class, "code", hot, "code").select("doc_id", "n_shingles", "component_id")
    alone = narrow.where("code is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
              else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from w),
classes as (select min(r) as c, list_sort(s) as s, min(doc_id) as smallest from sets group by list_sort(s)),
posted as (select c, len(s) as n, unnest(s) as shingle from classes),
pairs as (select a.c as a, b.c as b, count(*) as both from posted a join posted b on a.shingle = b.shingle and a.c < b.c and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach as (select c as start, c as at from classes union select reach.start, edges.b from reach join edges on reach.at = edges.a),
low as (select start, min(smallest) as component_id from reach join classes on reach.at = classes.c group by start)
select doc_id, len(sets.s)::bigint as n_shingles, case when len(sets.s) = 0 then doc_id else component_id end as component_id,
       doc_id is not distinct from (case when len(sets.s) = 0 then doc_id else component_id end) as kept
from sets join classes on list_sort(sets.s) = classes.s join low on low.start = classes.c
"""
