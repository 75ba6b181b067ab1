"""Links between classes of equal shingle sets: candidates from lists, confirmed on the whole sets.

A class is a distinct set of shingles: code (its digest), size (of the set), sig
(a signature, binary) and the ``buckets`` in which it is posted.  A ``Search``
says when two signatures make a candidate; a candidate is a link if ``percent``
times the union of the sets is at most a hundred times their intersection.  What
is wanted are the linked groups, so a pair need not be looked at once both ends
hang together:

1. Where most buckets hold one class and so no pair (``rare``), those go before any
   signature is shuffled.  Else counting them costs more than it saves: classes go
   straight to their buckets, a slice of the buckets after another, and only those of
   over MAX_LIST classes are counted.
2. First every bucket proposes for each class the most alike one.  These pairs
   meet the whole sets; a class that many others are paired with is dealt over as many
   tasks as its pairs need.  Components of the links that are found give labels.
3. Then all candidates of unlike labels that are left are looked at, but never
   written down: each bucket hands on a spanning star of each group of its candidates, at
   most one row a class.  The components of these stars bring each class's whole set to
   one place, once, where intersections are counted by merging the lists of its
   shingles.  Only links that join two groups leave it.

A bucket of over MAX_LIST classes is cut into parts: first each part is searched by
itself, beside one class that all parts have; then every two parts meet, in tasks of
their own, unless the whole bucket is one group by then.  Components of over
MAX_SETS classes are cut in the same way.  So no task holds more than two parts, and no
pair is lost.

Each step is written to the shared folder (``step``), and its shuffles go soon
after: the disk holds the postings of a step or two, not of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.chunks import Table
from larkspur.llm.components import connected
from larkspur.llm.shared import HOT_SHARE, discard, drop_shuffles, join_small, join_wide, map_texts, materialise, runs, starts_of

#: Classes of a bucket that are searched together in a task.
MAX_LIST = 20_000
#: Classes of a component whose whole sets meet in a task.
MAX_SETS = 3000
#: Runs of at most so many classes are compared without a search; classes that are searched together at first.
SMALL, WINDOW = 24, 1024
#: Pairs that each class proposes in a bucket at first.
PICKS = 1
#: Pairs of a class that one task confirms.
EACH = 256
#: Classes up to which their list is broadcast to find their texts.
WANTED_ROWS = 100_000


@dataclass(frozen=True)
class Search:
    """words: numbers of ``kind`` at the start of a signature that are compared; strength(a, b): how alike the rows of two matrices are, row by row; least: from where on they are a candidate.

    pairs(sigs, labels): places (i, j) of all candidates of unlike labels of a longer list, in pieces.
    rare: most buckets hold one class.  If not, the buckets are searched in so many ``slices``, and ``posted`` of ``groups`` takes a slice and their number.
    """

    kind: str
    words: int
    least: int
    strength: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]
    percent: int = 80
    rare: bool = True
    slices: int = 1


def step(df: DataFrame, name: str) -> DataFrame:
    """df written and read back; its shuffles go."""
    made = materialise(df, name)
    drop_shuffles(df.sparkSession)
    return made


class _Hashes(Table):
    """The 64-bit hash of a word, made when a task first asks for the word."""

    def __missing__(self, word: bytes) -> bytes:
        return self.add(word, xxhash.xxh64_digest(word)[::-1])


_hashes = _Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each number spread over all of it, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of so many lower-cased (A-Z) words, as sorted 64-bit hashes; of fewer words the whole sequence."""
    _hashes.trim()
    found = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.frombuffer(b"".join(map(_hashes.__getitem__, found)), "<u8")
    size = min(words, len(h))
    made = np.full(max(len(h) - size + 1, 0) if size else 0, size, np.uint64)
    for i in range(size):
        made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(made)])
    return np.unique(made)


def with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus th, a digest of the whole text by which it is found again."""
    return docs.withColumn("th", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))


def coded(docs: DataFrame, words: int, signature: Callable[[np.ndarray], bytes], keys: tuple[str, ...] = ("doc_id", "th")) -> DataFrame:
    """The keys, code (null without words), size and sig of each text."""

    def rows(_: list, texts: list[str]) -> dict:
        sets = [shingle_set(t, words) for t in texts]
        return {
            "code": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "size": np.array([len(s) for s in sets], np.int64),
            "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
        }

    return map_texts(docs, "code binary, size long, sig binary", rows, keys)


def classes_of(rows: DataFrame) -> DataFrame:
    """code, size, sig, first (doc_id and th of the smallest doc_id, null last), n of each class of ``rows`` (doc_id, th, code, size, sig)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")).alias("first")
    return rows.where("code is not null").groupBy("code").agg(F.min("size").alias("size"), F.min("sig").alias("sig"), first, F.count("*").alias("n"))


def sharing(classes: DataFrame, search: Search) -> DataFrame:
    """code, size, sig (the part that is compared), first, lists (bucket, n, hub: its least class) of the classes that share a bucket; classes: code, size, sig, first, buckets.

    Postings hold a 64-bit hash of the code; should two classes have the same one, each is
    also posted in the other's buckets, which costs a comparison and loses nothing.
    """
    own = F.xxhash64("code")
    posted = classes.select(own.alias("id"), F.explode(F.array_distinct("buckets")).alias("bucket"))
    lists = posted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    of_class = join_wide(posted, lists, "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "n", "hub")).alias("lists"))  # at most as many as a class has buckets
    compared = F.substring("sig", 1, search.words * np.dtype(search.kind).itemsize)
    return step(join_wide(classes.select("code", "size", compared.alias("sig"), "first", own.alias("id")), of_class, "id"), "members")


def sets_of(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """code and its whole set; docs: th and text.  Of equal texts a task hands on one."""
    wanted = members.select("code", F.col("first.th").alias("th"))
    texts = join_small(docs, wanted, "th", rows=WANTED_ROWS).groupBy("code").agg(F.any_value("text").alias("text"))

    def rows(_: list, texts: list[str]) -> dict:
        return {"shingles": pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())}

    return map_texts(texts, "shingles binary", rows, ("code",))


def crowded(posted: DataFrame, classes: int) -> DataFrame:
    """bucket, n, hub (its least class) of the buckets of over MAX_LIST classes; posted: id, bucket.

    Buckets are counted by cells first, of a few dozen classes' postings each, so
    that tasks hand on a number a cell, and one by one only in cells that are large enough.
    """
    posted = posted.withColumn("cell", F.pmod("bucket", F.lit(1 << max(12, (classes // 50).bit_length()))))
    cells = step(posted.groupBy("cell").count().where(F.col("count") > MAX_LIST).select("cell"), "crowded-cells")
    some = join_small(posted, cells, "cell", "left_semi", WANTED_ROWS)
    made = step(some.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where(F.col("n") > MAX_LIST), "crowded")
    discard(cells)
    return made


class Postings:
    """Of some classes (code, size, sig, label and what else they came with), each with each of its buckets: bucket, n and hub too; n counts where it is over MAX_LIST."""

    def __init__(self, classes: DataFrame, posted: Callable[..., DataFrame], search: Search):
        self.posted, self.search, self.crowd = posted, search, None
        if search.rare:
            self.members = sharing(posted(classes), search)
            return
        self.members = classes
        found = crowded(posted(classes.select("code", "sig")).select(F.xxhash64("code").alias("id"), F.explode("buckets").alias("bucket")), classes.count())
        if not found.isEmpty():
            self.crowd = found

    def of(self, members: DataFrame, part: int) -> DataFrame:
        """The postings in a slice of the buckets."""
        own = ("code", "size", "sig", "label")
        if self.search.rare:
            return members.select(*own, F.explode("lists").alias("l")).select(*own, "l.*")
        each = self.posted(members.select(*own), part, self.search.slices).select(*own, F.explode("buckets").alias("bucket"))
        if self.crowd is None:
            return each.withColumn("n", F.lit(0)).withColumn("hub", F.lit(0))
        return join_small(each, self.crowd, "bucket", "left", WANTED_ROWS).withColumn("n", F.coalesce("n", F.lit(0)))

    def many(self, each: DataFrame) -> DataFrame | None:
        """Those in buckets of over MAX_LIST classes, if there can be any."""
        return each.where(F.col("n") > MAX_LIST) if self.search.rare or self.crowd is not None else None


def _cells(members: DataFrame, postings: Postings, part: int, every: bool) -> DataFrame:
    """bucket, i, j, part, code, size, sig, label: the members of each bucket of a slice, a large one's by parts from 1 on, else 0."""
    columns = ("bucket", "i", "j", "part", "code", "size", "sig", "label")
    each = postings.of(members, part)
    whole = each.where(F.col("n") <= MAX_LIST).select("bucket", *(F.lit(0).alias(c) for c in ("i", "j", "part")), "code", "size", "sig", "label")
    many = postings.many(each)
    if many is None:
        return whole
    if every:  # a bucket that is one group by now has nothing left, and would meet itself part by part
        mixed_lists = many.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        many = join_wide(many, mixed_lists, "bucket", "left_semi")
    many = many.withColumn("parts", F.ceil(F.col("n") / MAX_LIST).cast("int"))
    many = many.withColumn("part", F.pmod(F.xxhash64("code"), "parts").cast("int") + 1)
    others = F.sequence(F.lit(1), F.col("parts"))
    if every:
        met = F.transform(others, lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    else:
        met = F.transform(F.when(F.xxhash64("code") == F.col("hub"), others).otherwise(F.array("part")), lambda k: F.struct(k.alias("i"), k.alias("j")))
    return whole.unionByName(many.withColumn("cell", F.explode(met)).select("bucket", "cell.i", "cell.j", *columns[3:]))


def _small_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in runs of at most SMALL."""
    sizes = np.diff(starts)
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[:-1], sizes, strict=True) if 1 < n <= SMALL] or [np.zeros(0, np.int64)])
    end = np.repeat(starts[1:], sizes)
    found = [(at[k], at[k] + d) for d in range(1, SMALL) if (k := at + d < end[at]).any()] if len(at) else []
    return tuple(np.concatenate([p[i] for p in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _best(i: np.ndarray, j: np.ndarray, strength: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, the ``picks`` strongest of each end; equal ones go to the lower places."""
    own, other, s = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(strength.astype(np.int64), 2)
    order = np.lexsort((other, -s, own))
    own, other = own[order], other[order]
    begin = starts_of(own)
    keep = np.arange(len(own)) - np.repeat(begin[:-1], np.diff(begin)) < picks
    return own[keep], other[keep]


def _hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put the groups of i and j together, pair by pair; parent[x] is the least place of x's group."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (further := parent[parent])).any():
            parent[:] = further


def proposed(cells: DataFrame, search: Search, picks: int | None) -> DataFrame:
    """a, b (a < b), each once: of each cell the ``picks`` most alike candidates of unlike labels of each class; or, with None, stars that span its candidates.

    With picks, a member of a cell that isn't searched as a whole, or isn't its whole bucket, also comes as a pair with itself.
    """
    percent = search.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, 3):
            keys = [whole.column(i).to_numpy() for i in range(3)]
            part, size = whole.column(3).to_numpy(), whole.column(5).to_numpy()
            codes = whole.column(4).combine_chunks()
            sigs = np.frombuffer(b"".join(whole.column(6).to_pylist()), search.kind).reshape(len(codes), search.words)
            labels = whole.column(7).combine_chunks().dictionary_encode().indices.to_numpy()
            starts, cross = starts_of(*keys), keys[1] != keys[2]
            parent = np.arange(len(codes))

            def able(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Pairs of unlike groups, of sizes that can reach the limit, and of a cell of two parts one of each."""
                low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
                keep = (labels[i] != labels[j]) & (100 * low >= percent * high) & (~cross[i] | (part[i] != part[j]))
                return i[keep], j[keep]

            def emit(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                a, b = codes.take(pa.array(i)).to_pylist(), codes.take(pa.array(j)).to_pylist()
                made = list({(min(p), max(p)) for p in zip(a, b, strict=True)})
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in made], pa.binary()) for k in (0, 1)], names=["a", "b"])

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                i, j = able(*_small_pairs(starts))
                keep = search.strength(sigs[i], sigs[j]) >= search.least
                yield i[keep], j[keep]
                for at, end in zip(starts[:-1], starts[1:], strict=True):
                    if end - at <= SMALL or (labels[at:end] == labels[at]).all():
                        continue
                    order = at + np.lexsort(sigs[at:end].T[: 4 if picks else 0][::-1]) if picks else np.arange(at, end)  # alike ones side by side
                    step = WINDOW if picks else end - at
                    for begin in range(0, end - at, step):
                        among = order[begin : begin + step]
                        for i, j in search.pairs(sigs[among], labels[among]):
                            yield able(among[i], among[j])

            for i, j in found():
                if picks is None:
                    _hook(parent, i, j)
                else:
                    yield from emit(*_best(i, j, search.strength(sigs[i], sigs[j]), picks))
            if picks is not None:
                again = np.flatnonzero((np.repeat(np.diff(starts), np.diff(starts)) > WINDOW) | (keys[1] > 0))
                yield from emit(again, again)
            member = np.flatnonzero(parent != np.arange(len(parent)))
            yield from emit(parent[member], member)

    ordered = cells.select("bucket", "i", "j", "part", "code", "size", "sig", "label").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "code")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough; sets: code, shingles."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / EACH).cast("int").alias("parts"))
    second = join_wide(pairs, parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("code"))
    first = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("code"))
    rows = join_wide(second.unionByName(first), sets, "code").select("a", "part", "side", "code", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for a, side, code, shingles in zip(*(piece.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                    other = np.frombuffer(shingles, np.uint64)
                    if side == 0:
                        of, own = a, other
                    elif of == a:
                        both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            found.append((a, code))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(run, "a binary, b binary")


def joining(codes: list[bytes], sets: list[bytes], labels: np.ndarray, apart: np.ndarray | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join unlike groups of the classes, by counting each one's intersections over the lists of its shingles; apart: parts of which a pair has one each."""
    sizes = np.array([len(x) // 8 for x in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    shingle = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    posted, at = member[order], np.append(0, np.cumsum(np.bincount(shingle)))
    own = np.append(0, np.cumsum(sizes))
    group = np.unique(labels, return_inverse=True)[1]
    found = []
    for i in range(len(sets)):
        mine = shingle[own[i] : own[i + 1]]
        mine = mine[at[mine + 1] - at[mine] > 1]
        n = at[mine + 1] - at[mine]
        lists = np.repeat(at[mine] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(posted[lists], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & (group != group[i]))
        for j in (near if apart is None else near[apart[near] != apart[i]]).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((codes[i], codes[j]))
    return found


def confirmed_groups(stars: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of unlike labels that links join within the components of stars (a, b of codes); members: code, label; sets: code, shingles."""
    roots = connected(stars)
    codes = join_wide(stars.select(F.col("a").alias("code")).union(stars.select("b")).distinct(), members.select("code", "label"), "code")
    placed = join_wide(codes, roots, codes["code"] == roots["node"], "left").select("code", "label", F.xxhash64(F.coalesce("root", "code")).alias("component"))
    parts = placed.groupBy("component").agg(F.ceil(F.count("*") / MAX_SETS).cast("int").alias("parts"))
    cut = join_wide(placed, parts, "component").withColumn("part", F.pmod(F.xxhash64("code"), "parts").cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    rows = join_wide(cut, sets, "code").withColumn("cell", F.explode(met)).select("component", "cell.i", "cell.j", "part", "code", "label", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, 3):
            keys = [whole.column(k).to_numpy() for k in range(3)]
            part, labels = whole.column(3).to_numpy(), whole.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
            starts = starts_of(*keys)
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                names, shingles = (whole.column(k).slice(at, end - at).to_pylist() for k in (5, 6))
                made = joining(names, shingles, labels[at:end], part[at:end] if keys[1][at] != keys[2][at] else None, percent)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in made], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "code").mapInArrow(run, "a binary, b binary")


def searched(members: DataFrame, postings: Postings, picks: int | None, name: str) -> DataFrame:
    """``proposed`` of all buckets: a slice is written, and its shuffle gone, before the next one's postings are made."""
    search = postings.search
    found = [step(proposed(_cells(members, postings, part, picks is None), search, picks), name) for part in range(search.slices)]
    if len(found) == 1:
        return found[0]
    made = step(reduce(DataFrame.union, found).distinct(), name)
    discard(*found)
    return made


def linked(postings: Postings, texts: DataFrame, words: int) -> DataFrame:
    """node, root of every class that hangs together with another one but the roots (see ``components.connected``); texts: th and text."""
    members, search = postings.members, postings.search
    pairs = searched(members.withColumn("label", F.col("code")), postings, PICKS, "proposed-pairs")
    # A class without a candidate has none later, unless one of its buckets was searched in windows or parts.
    again = step(pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct(), "paired")
    written, pairs = pairs, pairs.where("a <> b")
    paired = pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct()
    first = step(confirmed(pairs, sets_of(join_wide(members, paired, "code", "left_semi"), texts, words), search.percent), "links")
    roots = connected(first)
    left = join_wide(members, again, "code", "left_semi")
    left = step(join_wide(left, roots, left["code"] == roots["node"], "left").withColumn("label", F.coalesce("root", "code")).drop("node", "root"), "members-left")
    stars = searched(left, postings, None, "stars")
    made = roots
    if not stars.isEmpty():
        ends = stars.select(F.col("a").alias("code")).union(stars.select("b")).distinct()
        more = step(confirmed_groups(stars, left, sets_of(join_wide(left, ends, "code", "left_semi"), texts, words), search.percent), "links")
        if not more.isEmpty():  # they join labels, so the first components need no second look
            later = connected(more)
            onward = later.select(F.col("node").alias("root"), F.col("root").alias("final"))
            made = step(join_wide(roots, onward, "root", "left").select("node", F.coalesce("final", "root").alias("root")).unionByName(later), "roots")
            discard(roots, later)
        discard(more)
    discard(members, left, written, again, first, stars)
    return made


def groups(rows: DataFrame, texts: DataFrame, words: int, posted: Callable[..., DataFrame], search: Search) -> tuple[DataFrame, DataFrame]:
    """Two tables: code, n, first and root (a code that names the group) of each class of rows (doc_id, th, code, size, sig), and the hot ones among them.

    texts: th and text, to find whole sets by; posted adds ``buckets`` to classes.  A class of size 0 is a group of its own.
    """
    classes = step(classes_of(rows), "classes")
    postings = Postings(classes.where("size > 0").select("code", "size", "sig", "first"), posted, search)
    roots = linked(postings, texts, words)
    joined = join_wide(classes, roots, classes["code"] == roots["node"], "left").select("code", "n", "first", F.coalesce("root", "code").alias("root"))
    made = step(joined, "class-roots")
    discard(roots, classes, *([] if postings.crowd is None else [postings.crowd]))
    total = made.agg(F.sum("n")).first()[0] or 0
    return made, made.where(F.col("n") > HOT_SHARE * total)
