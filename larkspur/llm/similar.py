"""Near-dedup of whole texts at a similarity, with SimHash candidates.

Documents link if the Jaccard similarity of their sets of five lower-cased words
is 0.8 or more, by the whole sets.  Candidates come from SimHash fingerprints of
five 64-bit words: at a similarity of 0.8 two of them differ in a share of
arccos(2 * 0.8 / 1.8) / pi = 0.152 of their bits, 48.5 of 320 on average with a
standard error of 6.4 (9.7 and 2.9 of the first word's 64).

A class (equal sets) is posted in one bucket for each of MASKS masks of KEY_BITS
bits drawn from all 320.  A pair agrees on a mask with a probability of
0.848^KEY_BITS, and MASKS is what finds a pair of similarity 0.8 with a
probability of RECALL, more similar ones more surely.  Nothing of this depends on the
size of the table.  Within a bucket the Gray-order index of ``simhash`` finds
what differs in at most FIRST_BITS of the first word and ALL_BITS of all and does not
hang together yet; ``confirm`` has the rounds, the whole sets and the groups.

Nulls and edges: null, blank and wordless texts are copies of each other; fewer
than five words are one shingle; texts of any length are read whole; a null
doc_id is never the kept id of a group that has another; ids may repeat or be null in
several groups, each of which keeps one row; an empty table gives no rows; all
columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import confirm
from larkspur.llm.shared import HOT_SHARE, aside, back, discard, join_hot, materialise, places
from larkspur.llm.simhash import BITS, TOGETHER, GrayIndex

SHINGLE, PERCENT = 5, 80
WORDS = 5
FIRST_BITS, ALL_BITS = 20, 72
#: Bits of a key, and the share of pairs just at the similarity that shall share one.
KEY_BITS, RECALL = 16, 0.95
AT_ONCE = 4096
#: Parts of the masks that are posted one after another, so that the disk holds the postings of one part.
SLICES = 4

_AGREE = 1 - math.acos(2 * PERCENT / (100 + PERCENT)) / math.pi
MASKS = math.ceil(math.log(1 - RECALL) / math.log(1 - _AGREE**KEY_BITS))
_rng = np.random.default_rng(2026)
#: The bits of each mask.
PLACES = np.array([np.sort(_rng.choice(BITS * WORDS, KEY_BITS, replace=False)) for _ in range(MASKS)])


def fingerprint(shingles: np.ndarray) -> bytes:
    """WORDS words: a bit is set if over half of the shingles' hashes have it set; further hashes are made by mixing."""
    ones = np.zeros(BITS * WORDS, np.int64)
    for at in range(0, len(shingles), AT_ONCE):
        h = shingles[at : at + AT_ONCE]
        bits = np.column_stack([h, *(confirm.mixed(h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << BITS) - 1)) for i in range(1, WORDS))])
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def keys(words: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
    """A number for each mask (or every ``parts``-th from ``part`` on) and its bits of each fingerprint (a row of words)."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    masks = np.arange(MASKS, dtype=np.uint64)[part::parts]
    found = np.zeros((len(words), len(masks)), np.uint64)
    for b in range(KEY_BITS):
        found |= bits[:, PLACES[part::parts, b]].astype(np.uint64) << np.uint64(b)
    return confirm.mixed(found | (masks + np.uint64(1) << np.uint64(32)))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits on which fingerprints agree, row by row."""
    return BITS * WORDS - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def search(words: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the candidates of unlike labels of a bucket, by the Gray-order index."""
    index = GrayIndex(words[:, 0].copy())
    labels = labels[index.order].astype(np.int64)
    for start in range(0, len(words), TOGETHER):
        i, j = index.search(np.arange(start, min(len(words), start + TOGETHER)), labels, FIRST_BITS)
        i, j = index.order[i], index.order[j]
        near = alike(words[i], words[j]) >= BITS * WORDS - ALL_BITS
        yield i[near], j[near]


SEARCH = confirm.Search("<u8", WORDS, BITS * WORDS - ALL_BITS, alike, search, PERCENT, rare=False, slices=SLICES)


def with_keys(classes: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """classes plus buckets, those of every ``parts``-th mask from ``part`` on."""
    masks = len(range(part, MASKS, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column(batch.schema.get_field_index("sig"))
            found = keys(np.frombuffer(b"".join(sig.to_pylist()), "<u8").reshape(-1, WORDS), part, parts).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, masks, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{fields}, buckets array<long>")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group one row, of the smallest doc_id.

    Only digests and fingerprints are written; the rows that stay are found by id and
    the text's digest, so each text is shuffled once, and those that many rows share not at all.
    """
    columns = docs.columns
    made = confirm.coded(confirm.with_text_key(docs.select("doc_id", "text")), SHINGLE, fingerprint)
    rows = materialise(made.withColumn("code", F.coalesce("code", F.lit(b""))), "coded")
    of_class, _ = confirm.groups(rows, confirm.with_text_key(docs.select("text")), SHINGLE, with_keys, SEARCH)
    first = F.min(F.struct("first.unknown", "first.doc_id", "first.th")).alias("first")
    kept = confirm.step(of_class.groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th")), "kept")
    hot = confirm.step(rows.groupBy("th").count().where(F.col("count") > HOT_SHARE * rows.count()), "hot-texts")
    repeated = not rows.groupBy("th", "doc_id").count().where("count > 1").isEmpty()
    discard(rows, of_class)
    id_at = places(columns)[columns.index("doc_id")]
    keyed = confirm.with_text_key(aside(docs, "text")).drop("text")
    stay = join_hot(keyed, kept, "th", hot, (F.col("th") == F.col("kept_th")) & F.col(id_at).eqNullSafe(F.col("kept_id")), "left_semi")
    return back(stay.dropDuplicates(["th", id_at]) if repeated else stay, columns)
