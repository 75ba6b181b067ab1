"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set if over half of the 64-bit hashes of the
document's word shingles (repeats included) have it set.  A ``Rule`` says what
links: CONTRACT takes 3-word shingles and at most 3 of 64 bits.  The linked groups
are the connected components.  ``similar`` has the near-dedup by a similarity of
whole texts.

Plan at scale:

1. One pass makes the fingerprints; equal ones become one class, so a group of
   exact copies, however large, is one row from then on.
2. Two fingerprints within ``max_bits`` bits agree on at least one of
   ``max_bits`` + 1 blocks of bits (of very many classes on two of ``max_bits`` +
   2), so each class is dealt to one bucket per choice of blocks.  Of the chosen blocks' bits only as
   many make the key as leave about ``bucket`` classes to a bucket (fewer bits
   never part a pair).  A bucket above ``max_bucket`` is dealt again by the bits
   that are still free, ROUNDS times at most (fingerprints that are alike in most
   bits stay together); nothing is dropped, a bucket may be of any size and
   takes about 100 bytes a class.
3. Within every bucket the fingerprints are sorted by Gray rank and the bits
   that neighbours share are factored into upper nodes (mask and pattern).  A
   search adds up differences on the way down and drops a whole group once
   they exceed the limit, or once the group already hangs together with the
   searching fingerprint.  Only the links that join two groups leave the bucket
   (at most one per class), never all pairs.
4. Components of these links by repeated contraction on Spark.

Nulls and edges: a null or blank text has fingerprint 0 and links like any
other; texts of fewer words than a shingle are one shingle; texts of any length
are hashed whole, a bounded number of shingles at a time; a null doc_id is kept
and never the smallest id of a group that has another; repeated rows are
copies of each other; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import connected
from larkspur.llm.shared import HOT_SHARE, discard, join_hot, join_wide, map_texts, materialise, runs, starts_of

BITS = 64
SEED = 42
#: Classes a bucket may hold before it is dealt again.
MAX_BUCKET, ROUNDS = 20_000, 2
#: Classes above which two blocks must agree, not one.
MANY = 1 << 26
#: Children of a node of the index, and searches that go down it together.
FANOUT = 8
TOGETHER = 128
#: How often at most the labels of a bucket's groups are brought up to date.
REFRESHED = 64
#: Hashes of shingles held at once.
HASHES = 1 << 15


@dataclass(frozen=True)
class Rule:
    """shingle: words of a shingle; max_bits: bits that may differ; bucket: classes aimed at, and max_bucket: classes above which a bucket is dealt again."""

    shingle: int = 3
    max_bits: int = 3
    bucket: int = 1024
    max_bucket: int = MAX_BUCKET


CONTRACT = Rule()


def code(text: str, rule: Rule = CONTRACT) -> bytes:
    """The fingerprint of one text, most significant byte first."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - rule.shingle + 1
    parts = [words[i : n + i] for i in range(rule.shingle)] if n > 0 else [[w] for w in words]
    shingles = zip(*parts, strict=True)
    ones, total = np.zeros(BITS, np.int64), 0
    while len(h := np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in islice(shingles, HASHES)), np.uint64)):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return np.packbits(2 * ones > total).tobytes()


def fingerprint(text: str, rule: Rule = CONTRACT) -> int:
    """The fingerprint of one text as a number."""
    return int.from_bytes(code(text, rule), "big")


def codes(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, code (the fingerprint) and fp (the same as a signed long)."""

    def rows(_: list, texts: list[str]) -> dict:
        made = [code(t, rule) for t in texts]
        return {"code": pa.array(made, pa.binary()), "fp": np.frombuffer(b"".join(made), ">i8").astype(np.int64)}

    return map_texts(docs, "code binary, fp long", rows)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray code."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node holds the bits on which all below it agree.

    ``masks[0]``, ``patterns[0]`` are the fingerprints themselves; node i of a
    level covers nodes FANOUT * i and following of the level below.  A node's
    own mask leaves out what its parent's has.  ``visited`` counts the nodes that
    searches came to, ``dropped`` those of them whose group they left out.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.visited = self.dropped = 0
        shared, patterns = [np.full(len(fps), ~np.uint64(0))], [self.fps]
        while len(patterns[-1]) > FANOUT:
            mask, pattern = shared[-1], patterns[-1]
            at = np.arange(0, len(pattern), FANOUT)
            first = np.repeat(pattern[at], FANOUT)[: len(pattern)]
            shared.append(np.bitwise_and.reduceat(mask & ~(pattern ^ first), at))
            patterns.append(pattern[at] & shared[-1])
        self.masks = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(shared, shared[1:], strict=False)] + [shared[-1]]
        self.patterns = patterns

    def groups(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all members of a node have, or -1."""
        levels = [labels]
        while len(levels) < len(self.patterns):
            at = np.arange(0, len(levels[-1]), FANOUT)
            low, high = np.minimum.reduceat(levels[-1], at), np.maximum.reduceat(levels[-1], at)
            levels.append(np.where(low == high, low, -1))
        return levels

    def search(self, block: np.ndarray, labels: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, found), the second behind the first, within max_bits that do not yet have the same label; block: places of the queries."""
        same = self.groups(labels)
        top = len(self.patterns[-1])
        query, node = np.repeat(block, top), np.tile(np.arange(top), len(block))
        spent = np.zeros(len(query), np.uint8)
        for level in range(len(self.patterns) - 1, -1, -1):
            spent = spent + np.bitwise_count((self.fps[query] ^ self.patterns[level][node]) & self.masks[level][node])
            keep = (spent <= max_bits) & (same[level][node] != labels[query]) & ((node + 1) * FANOUT**level > query + 1)
            self.visited += len(keep)
            self.dropped += int((~keep).sum()) if level else 0
            query, node, spent = query[keep], node[keep], spent[keep]
            if level:
                below = len(self.patterns[level - 1])
                query, spent = np.repeat(query, FANOUT), np.repeat(spent, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < below
                query, node, spent = query[inside], node[inside], spent[inside]
        return query, node


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def bucket_links(fps: np.ndarray, rule: Rule = CONTRACT) -> tuple[list[tuple[int, int]], GrayIndex]:
    """(member, root), as places, for each fingerprint of a bucket that links, as one star for each linked group."""
    n = len(fps)
    parent = list(range(n))
    index = GrayIndex(fps)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = _root(parent, x), _root(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    beside = np.flatnonzero(np.bitwise_count(index.fps[1:] ^ index.fps[:-1]) <= rule.max_bits)
    union(beside, beside + 1)
    for i, start in enumerate(range(0, n, TOGETHER)):
        if i % (1 + n // TOGETHER // REFRESHED) == 0:
            labels = np.array(parent)
            while (labels != (further := labels[labels])).any():
                labels = further
        union(*index.search(np.arange(start, min(n, start + TOGETHER)), labels, rule.max_bits))
    return [(int(index.order[i]), int(index.order[r])) for i in range(n) if (r := _root(parent, i)) != i], index


def _bits_of(mask: int) -> list[int]:
    return [i for i in range(BITS) if mask >> i & 1]


def block_masks(sure: int, blocks: int, width: int = BITS) -> list[int]:
    """Masks, of at most ``width`` bits, of which two fingerprints within ``sure`` bits agree on at least one."""
    parts = sure + blocks
    edges = [BITS * i // parts for i in range(parts + 1)]
    chosen = combinations([list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)], blocks)
    spread = ([bit for bits in zip(*(x[: min(map(len, of))] for x in of), strict=True) for bit in bits] for of in chosen)
    return sorted({sum(1 << i for i in bits[:width]) for bits in spread})


def split_mask(free: int, parts: int) -> list[int]:
    """The free bits as so many masks of like width."""
    bits = _bits_of(free)
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _key(mask: str) -> Column:
    return F.col(mask).bitwiseAND(F.col("fp")).alias("key")


def dealt(classes: DataFrame, rule: Rule = CONTRACT, many: bool | None = None) -> DataFrame:
    """Classes (code, fp) by bucket: mask, key (the masked bits), fp, code; buckets above max_bucket are dealt again by their free bits."""
    n = classes.count()
    masks = block_masks(rule.max_bits, 1 + (n > MANY if many is None else many), max(0, (n // rule.bucket).bit_length()))
    literal = lambda m: F.lit(_signed(m)).cast("long")
    rows = classes.select("code", "fp", F.explode(F.array(*map(literal, masks))).alias("mask")).select("mask", _key("mask"), "fp", "code")
    whole = (1 << BITS) - 1
    for _ in range(ROUNDS):
        hot = rows.groupBy("mask", "key").count().where((F.col("count") > rule.max_bucket) & (F.col("mask") != -1)).select("mask", "key")
        hot = materialise(hot, "hot-buckets")
        masks = sorted({r["mask"] & whole for r in hot.select("mask").distinct().collect()})  # the first masks, times ``max_bits`` + 1 a round
        if not masks:
            break
        finer = F.create_map(*(x for m in masks for x in (literal(m), F.array(*(literal(m | part) for part in split_mask(~m & whole, rule.max_bits + 1))))))
        again = rows.join(hot, ["mask", "key"], "left_semi").select("code", "fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        rows = rows.join(hot, ["mask", "key"], "left_anti").unionByName(again.select("mask", _key("mask"), "fp", "code"))
        rows = materialise(rows, "dealt")
    return rows


def links(classes: DataFrame, rule: Rule = CONTRACT, many: bool | None = None, visits=None) -> DataFrame:
    """a, b: codes of classes (code, fp) that hang together by the rule's links, at most one a class and bucket.

    ``visits``, two accumulators, count the nodes of indexes that searches came to and left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, 2):
            mask, key = (whole.column(i).to_numpy() for i in range(2))
            starts, coded = starts_of(mask, key), whole.column(2).combine_chunks()
            fps = np.frombuffer(b"".join(coded.to_pylist()), ">u8").astype(np.uint64)
            a, b = [], []
            for i in np.flatnonzero(np.diff(starts) > 1):
                found, index = bucket_links(fps[starts[i] : starts[i + 1]], rule)
                a += [starts[i] + x for x, _ in found]
                b += [starts[i] + y for _, y in found]
                for counter, n in zip(visits or (), (index.visited, index.dropped), strict=False):
                    counter.add(n)
            yield pa.RecordBatch.from_arrays([coded.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    buckets = dealt(classes, rule, many).select("mask", "key", "code")
    return buckets.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a binary, b binary")


def groups(coded: DataFrame, rule: Rule = CONTRACT, visits=None) -> tuple[DataFrame, DataFrame]:
    """Two tables: code, fp, n, smallest (doc_id), root (a code that names the group) of each class, and the hot ones among them; coded: doc_id, code, fp."""
    classes = materialise(coded.groupBy("code", "fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")), "classes")
    found = materialise(links(classes.select("code", "fp"), rule, visits=visits), "links")
    roots = connected(found)
    made = materialise(join_wide(classes, roots, classes["code"] == roots["node"], "left").select("code", "fp", "n", "smallest", F.coalesce("root", "code").alias("root")), "class-roots")
    discard(classes, found, roots)
    total = made.agg(F.sum("n")).first()[0] or 0
    return made, made.where(F.col("n") > HOT_SHARE * total)


def near_duplicates(docs: DataFrame, rule: Rule = CONTRACT, visits=None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the group)."""
    coded = materialise(codes(docs, rule), "fingerprints")
    of_class, hot = groups(coded, rule, visits)
    smallest = of_class.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_class = join_wide(of_class, smallest, "root").select("code", "component_id")
    joined = join_hot(coded, by_class, "code", hot, "code")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

