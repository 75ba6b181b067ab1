"""Approximate nearest neighbours by balanced posting lists.

Fit (driver, bounded): at most SAMPLE_VALUES numbers of vectors, by hash of
their id, give the centroids by spherical k-means; clusters above twice the
mean size are split.  A graph links each centroid with its nearest ones.

Index (Spark): equal vectors become one class first, so that a vector that
fills a third of the table is one entry.  Each class goes to its nearest list
and, when it lies near a boundary (another centroid within 1 + BOUNDARY times
that distance), to up to REPLICAS lists.  Every valid row is indexed.

Search (Spark): a flood over the in-memory centroid graph, from fixed entries,
finds the centroids within ``ratio`` times the distance of the RANK-th nearest
one (the nearest one's own distance says little: it may be next to nothing);
only their lists, however many, are scored.  ``ratio`` is calibrated: for at
most PROBES sampled vectors the true neighbours are found by brute force over
all classes in blocks, and ratio is the least with which a share RECALL of them
is in a list that the search selects.

Shuffle: lists that lie together form shards of at most SHARD_ENTRIES entries
(a longer list is dealt to several shards by hash), so a query's vector moves
once for each shard in which it has a list, not once for each list.  A task
holds the entries of one shard and streams the queries past them; equal
queries are one.

Scores: lists are scored in double precision, everything down to the k-th best
score less a rounding margin is kept and scored again exactly on the original
vectors, and only then ties are settled.  Vectors are scaled by a power of two
first, which changes no cosine and loses none to tiny or huge components.

Nulls and edges: a vector that is null, zero, holds null or non-finite
components, has another length than most, or has no id takes no part; a
repeated id with the same vector counts once, one with several vectors asks
with the least of them (by bytes) and is found by the nearest; ties go to the
smaller vec_id; fewer candidates than k give fewer rows; an empty table gives
none.  Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import hash_sample, join_small, join_wide, materialise, starts_of

SAMPLE_VALUES = 1 << 23
LIST_SIZE = 10
NEIGHBOURS, ENTRIES, ROUNDS = 16, 32, 6
REPLICAS, BOUNDARY = 2, 0.15
RANK, WIDTH = 8, 32
PROBES, RECALL = 512, 0.94
SHARD_ENTRIES = 1 << 15
#: Queries scored together, pairs scored exactly at once, and rows a task holds before it keeps the best only.
BLOCK, PAIRS, HELD = 1024, 1 << 17, 500_000
#: Distances to centroids that are held at once while the index is fitted and calibrated: the driver's memory doesn't grow with the centroids.
VALUES = 1 << 21
#: Above the rounding of a dot product of unit vectors.
MARGIN = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that brings its largest component to about 1."""
    x = x.astype(np.float64)
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    half = -power // 2
    return np.ldexp(np.ldexp(x, half), -power - half)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Centroids:
    """Unit centroids and the graph over them."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, k: int, seed: int = 11) -> Centroids:
        rng = np.random.default_rng(seed)
        x = np.concatenate([unit(sample[i : i + 4096]).astype(np.float32) for i in range(0, len(sample), 4096)])
        points = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(ROUNDS):
            points = _means(x, _nearest(x, points), points)
        nearest = _nearest(x, points)
        sizes = np.bincount(nearest, minlength=len(points))
        more = []
        for c in np.flatnonzero(sizes > 2 * max(1, len(x) // k)):  # balance: large clusters get centroids by their share
            own = x[nearest == c]
            parts = min(len(own), int(np.ceil(sizes[c] / max(1, len(x) // k))))
            seeds = own[rng.choice(len(own), parts, replace=False)].copy()
            for _ in range(ROUNDS):
                seeds = _means(own, _nearest(own, seeds), seeds)
            points[c] = seeds[0]
            more.append(seeds[1:])
        points = np.unique(np.concatenate([points, *more]), axis=0)
        step = _rows_of(points)
        links = np.concatenate([_top(points[i : i + step], points, NEIGHBOURS + 1) for i in range(0, len(points), step)])
        anywhere = rng.integers(0, len(points), (len(points), 2))
        own = np.arange(len(points))[:, None]
        anywhere = np.where((anywhere[:, :, None] == links[:, None, :]).any(2), own, anywhere)
        anywhere[:, 1:] = np.where(anywhere[:, 1:] == anywhere[:, :1], own, anywhere[:, 1:])
        entries = rng.choice(len(points), min(ENTRIES, len(points)), replace=False)
        return Centroids(points, np.concatenate([links, anywhere], axis=1), entries)

    def nearest(self, x: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of the ``width`` nearest centroids that a search along the graph finds for each row."""
        m, x = len(x), x.astype(np.float32)
        seen = np.zeros((m, len(self.points)), bool)
        seen[:, self.entries] = True
        place = np.tile(self.entries, (m, 1))
        dist = 1 - x @ self.points[self.entries].T
        opened = np.zeros(dist.shape, bool)
        while True:
            best = np.where(opened, np.inf, dist).argmin(axis=1)
            rows = np.flatnonzero(~opened[np.arange(m), best] & np.isfinite(dist[np.arange(m), best]))
            if not len(rows):
                return dist, place
            opened[rows, best[rows]] = True
            new = self.links[place[rows, best[rows]]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            found = np.where(fresh, 1 - np.einsum("rd,rjd->rj", x[rows], self.points[new]), np.inf).astype(np.float32)
            if dist.shape[1] < width:
                room = min(width - dist.shape[1], new.shape[1])
                dist, place, opened = (np.pad(a, ((0, 0), (0, room)), constant_values=v) for a, v in ((dist, np.inf), (place, 0), (opened, False)))
            every, which = np.concatenate([dist[rows], found], axis=1), np.concatenate([place[rows], new], axis=1)
            kept = np.argpartition(every, dist.shape[1] - 1, axis=1)[:, : dist.shape[1]]
            was = np.concatenate([opened[rows], np.zeros(found.shape, bool)], axis=1)
            dist[rows], place[rows], opened[rows] = (np.take_along_axis(a, kept, axis=1) for a in (every, which, was))

    def near(self, x: np.ndarray, ratio: float, rank: int = RANK) -> np.ndarray:
        """Distance (1 - cosine) of each row of unit vectors to each centroid the flood reached, else inf.

        The flood goes on from centroids within ratio times the rank-th least distance so far.
        """
        m, k = len(x), len(self.points)
        x = x.astype(np.float32)
        dist, opened = np.full((m, k), np.inf, np.float32), np.zeros((m, k), bool)
        dist[:, self.entries] = 1 - x @ self.points[self.entries].T
        while True:
            rows, nodes = np.nonzero((dist <= base(dist, rank) * max(ratio, 1.02)) & ~opened)
            if not len(rows):
                return dist
            opened[rows, nodes] = True
            reached = np.zeros((m, k), bool)
            reached[rows[:, None], self.links[nodes]] = True
            r, c = np.nonzero(reached & np.isinf(dist))
            for at in range(0, len(r), 1 << 16):
                part = slice(at, at + (1 << 16))
                dist[r[part], c[part]] = 1 - np.einsum("ij,ij->i", x[r[part]], self.points[c[part]])


def _rows_of(points: np.ndarray) -> int:
    """Rows that meet all points at once."""
    return max(1, VALUES // max(1, len(points)))


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + n] @ points.T, axis=1) for n in [_rows_of(points)] for i in range(0, len(x), n)])


def _top(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(points))
    return np.argpartition(-(x @ points.T), k - 1, axis=1)[:, :k].copy()  # a view would keep a number for each pair of points


def _means(x: np.ndarray, nearest: np.ndarray, points: np.ndarray) -> np.ndarray:
    order = np.argsort(nearest, kind="stable")
    starts = starts_of(nearest[order])
    made = points.copy()
    sums = np.add.reduceat(x[order], starts[:-1], axis=0)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    found = nearest[order][starts[:-1]]
    made[found] = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), points[found])
    return made


def base(dist: np.ndarray, rank: int) -> np.ndarray:
    """The rank-th least distance of each row, or the last there is."""
    least = np.partition(dist, min(rank, dist.shape[1]) - 1, axis=1)[:, : min(rank, dist.shape[1])]
    return np.maximum(np.where(np.isinf(least), 0, least).max(axis=1, keepdims=True), 1e-6)


def selected(dist: np.ndarray, ratio: float, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists within ratio times the rank-th least distance."""
    return np.nonzero(dist <= base(dist, rank) * ratio)


def assign(index: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each entry: the nearest list, and boundary replicas."""
    dist, place = index.nearest(x)
    n = min(REPLICAS, dist.shape[1])
    first = np.argpartition(dist, n - 1, axis=1)[:, :n]
    rows, at = selected(np.take_along_axis(dist, first, axis=1), 1 + BOUNDARY, 1)
    return rows, place[rows, first[rows, at]]


def shards_of(points: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """first, parts: the shards of each list.

    Lists are halved, along the direction in which their centroids differ most,
    until a group has at most ``limit`` entries; a longer list has several shards.
    """
    first, parts = np.zeros(len(sizes), np.int32), np.maximum(1, -(-sizes // limit)).astype(np.int32)
    todo, n = [np.flatnonzero(parts == 1)], 0
    for c in np.flatnonzero(parts > 1):
        first[c], n = n, n + parts[c]
    while todo:
        group = todo.pop()
        if sizes[group].sum() <= limit:
            first[group], n = n, n + 1
            continue
        own = points[group] - points[group].mean(0)
        along = np.ones(own.shape[1]) @ own.T @ own
        for _ in range(4):
            along = along @ own.T @ own / max(np.linalg.norm(along), 1e-12)
        order = group[np.argsort(own @ along, kind="stable")]
        cut = int(np.searchsorted(np.cumsum(sizes[order]), sizes[order].sum() / 2))
        cut = min(max(1, cut), len(order) - 1)
        todo += [order[:cut], order[cut:]]
    return first, parts


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Packed vectors as rows."""
    packed = b"".join(column.to_pylist())
    return np.frombuffer(packed, dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)


def valid(batch: pa.RecordBatch, dtype: str) -> Iterator[tuple[int, bytes]]:
    """vec_id and packed vector of the rows that take part (all of one length)."""
    for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if vec_id is not None and x is not None and None not in x:
            v = np.array(x, dtype) + 0.0
            if np.isfinite(v).all() and v.any():
                yield vec_id, v.tobytes()


def classes(vectors: DataFrame, keep: int, dtype: str) -> DataFrame:
    """vec (packed), ids: the ``keep`` smallest ids of each distinct valid vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["vec", "ids"])
            found.clear()
            return made

        for batch in batches:
            for vec_id, v in valid(batch, dtype):
                ids = found.setdefault(v, [])
                if vec_id not in ids and (len(ids) < keep or vec_id < ids[-1]):
                    ids.append(vec_id)
                    ids.sort()
                    del ids[keep:]
            if len(found) > 100_000:
                yield flush()
        yield flush()

    partial = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec binary, ids array<long>")
    return partial.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Of each query the ``keep`` best distinct found, ties to the smaller."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    query, found, score = query[new], found[new], score[new]
    starts = starts_of(query)
    rank = np.arange(len(query)) - np.repeat(starts[:-1], np.diff(starts))
    return query[rank < keep], found[rank < keep], score[rank < keep]


class Scorer:
    """Scores queries against the entries of a shard, list by list; ``pairs`` counts the pairs that were scored."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, keep: int):
        self.ids, self.keep, self.pairs = ids, keep, 0
        self.vectors = scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.units = self.vectors / self.norms[:, None]
        starts = starts_of(lists)
        self.lists, self.starts = lists[starts[:-1]], starts
        #: Replicas in several lists are one item; items are numbered as their ids are ordered.
        _, self.entry, self.item = np.unique(ids, return_index=True, return_inverse=True)
        if (vectors != vectors[self.entry[self.item]]).any():  # an id with several vectors is several items
            places: dict[tuple[int, bytes], int] = {}
            for key, i in sorted(((int(x), v.tobytes()), i) for i, (x, v) in enumerate(zip(ids, vectors, strict=True))):
                self.item[i] = places.setdefault(key, len(places))
            _, self.entry = np.unique(self.item, return_index=True)

    def best(self, q_ids: np.ndarray, queries: np.ndarray, asked: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(query, found, cosine) of the best of each query among the lists that it asks for."""
        q = scaled(queries)
        qn = np.sqrt((q * q).sum(1))
        qu = q / qn[:, None]
        rows = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
        wanted = np.concatenate([*asked, np.zeros(0, self.lists.dtype)])
        at = np.searchsorted(self.lists, wanted)
        there = self.lists[np.minimum(at, len(self.lists) - 1)] == wanted
        rows, at = rows[there], at[there]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        least = np.full(len(asked), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        starts = starts_of(at)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            members = slice(self.starts[at[a]], self.starts[at[a] + 1])
            for first in range(members.start, members.stop, 4096):
                part = slice(first, min(members.stop, first + 4096))
                own = rows[a:b]
                found = qu[own] @ self.units[part].T
                self.pairs += found.size
                bound = least[own]
                if found.shape[1] > 4 * self.keep:
                    bound = np.maximum(bound, np.partition(found, -self.keep, axis=1)[:, -self.keep] - MARGIN)
                i, j = np.nonzero(found >= bound[:, None])
                held.append((own[i], j + part.start, found[i, j]))
                n += len(i)
                if n > PAIRS:
                    held = [self._settled(held, q, qn, least)]
                    n = len(held[0][0])
        r, e, exact = self._settled(held, q, qn, least)
        return q_ids[r], self.ids[e], exact

    def _settled(self, held: list[tuple[np.ndarray, ...]], q: np.ndarray, qn: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best of each row of what is held, by exact scores; raises ``least`` to what can still matter."""
        r, e, approx = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, int),) * 3
        if len(r):
            order = np.lexsort((self.item[e], r))
            order = order[starts_of(r[order], self.item[e[order]])[:-1]]  # a replica in another list counts once
            order = order[np.lexsort((-approx[order], r[order]))]
            r, e, approx = r[order], e[order], approx[order]
            starts = starts_of(r)
            kth = approx[np.minimum(starts[:-1] + self.keep, starts[1:]) - 1] - MARGIN
            near = approx >= np.repeat(kth, np.diff(starts))
            r, e = r[near], e[near]
        exact = np.concatenate([np.zeros(0), *((q[r[i : i + PAIRS]] * self.vectors[e[i : i + PAIRS]]).sum(1) / (qn[r[i : i + PAIRS]] * self.norms[e[i : i + PAIRS]]) for i in range(0, len(r), PAIRS))])
        r, item, exact = _best(r, self.item[e], exact, self.keep)
        starts = starts_of(r)
        full = np.diff(starts) == self.keep
        if full.any():
            least[r[starts[:-1][full]]] = exact[starts[1:][full] - 1] - MARGIN
        return r, self.entry[item], exact


def _kept(parts: Iterator[tuple[np.ndarray, ...]], keep: int) -> Iterator[pa.RecordBatch]:
    """The best of each query in this task, as few rows as may be."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            made = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), keep)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], names=["query", "found", "score"])

    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > HELD:
            yield from flush()
            n = 0
    yield from flush()


def brute(items: DataFrame, queries: list[tuple[int, bytes]], keep: int, dtype: str) -> DataFrame:
    """query, found, score of a few given queries against all items, in blocks."""
    q_ids, q = np.array([i for i, _ in queries], np.int64), _matrix(pa.array([x for _, x in queries], pa.binary()), dtype)
    all_of_it = [np.zeros(1, np.int32)] * len(q_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept((Scorer(b.column(0).to_numpy(), _matrix(b.column(1), dtype), np.zeros(b.num_rows, np.int32), keep).best(q_ids, q, all_of_it) for b in batches if b.num_rows), keep)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return items.select("item", "vec").mapInArrow(run, "query long, found long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def calibrate(items: DataFrame, index: Centroids, keep: int, dtype: str, recall: float = RECALL) -> float:
    """The least ratio with which a share ``recall`` of the true neighbours of sampled items are in selected lists."""
    probes = [(r["item"], bytes(r["vec"])) for r in hash_sample(items, PROBES, "item", 5).select("item", "vec").collect()]
    near = brute(items, probes, keep, dtype).where("query <> found").select("query", "found")
    pairs = join_small(items.select(F.col("item").alias("found"), "vec"), near, "found").collect()  # at most PROBES * keep rows
    if not pairs:
        return 1.0
    place = {i: n for n, (i, _) in enumerate(probes)}
    q = unit(_matrix(pa.array([x for _, x in probes], pa.binary()), dtype))
    v = unit(_matrix(pa.array([bytes(r["vec"]) for r in pairs], pa.binary()), dtype))
    needed, step = np.full(len(pairs), np.inf), _rows_of(index.points)
    asks = np.array([place[r["query"]] for r in pairs])
    for at in range(0, len(pairs), step):
        rows, lists = assign(index, v[at : at + step])
        to_query = 1 - q[asks[at : at + step]].astype(np.float32) @ index.points.T
        to_query /= base(to_query, RANK)
        np.minimum.at(needed, rows + at, to_query[rows, lists])
    return float(max(1.0, np.quantile(needed, recall)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, list_size: int = LIST_SIZE, shard_entries: int = SHARD_ENTRIES, recall: float = RECALL, pairs=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` for which is_query holds.

    ``pairs``, an accumulator, counts the pairs that are scored for the queries.
    """
    spark, keep = vectors.sparkSession, k + 1
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = "<f4" if element == "float" else "<f8"
    sized = vectors.where("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sized is None:
        return empty
    usable = vectors.where(F.size("embedding") == sized["n"])
    items = materialise(classes(usable, keep, dtype).withColumn("item", F.col("ids")[0]), "vector-classes")
    n = items.count()
    if n == 0:
        return empty
    sample = _matrix(hash_sample(items, max(1, SAMPLE_VALUES // sized["n"]), "item").select("vec").toArrow().column("vec"), dtype)
    index = Centroids.fit(sample, max(1, min(n // list_size, len(sample) // 4)))
    ratio = calibrate(items, index, keep, dtype, recall)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, lists = assign(index, unit(_matrix(part.column(1), dtype)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], names=["list", "id", "vec"])

    postings = materialise(items.select("item", "vec").mapInArrow(post, "list int, id long, vec binary"), "postings")
    sizes = np.zeros(len(index.points), np.int64)
    for r in postings.groupBy("list").count().collect():  # at most a row for each centroid
        sizes[r["list"]] = r["count"]
    first, parts = shards_of(index.points, sizes, shard_entries)
    deal = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes)], "list int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    entries = join_small(postings, deal, "list").select(shard.alias("shard"), F.lit(0).alias("kind"), "list", "id", "vec", F.lit(None).cast("binary").alias("lists"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, lists = selected(index.near(unit(_matrix(part.column(1), dtype)), ratio), ratio)
                times = parts[lists]
                rows, lists = np.repeat(rows, times), np.repeat(lists, times)
                to = first[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lists, to, rows))
                rows, lists, to = rows[order], lists[order].astype(np.int32), to[order]
                starts = starts_of(rows, to)
                packed = pa.array([lists[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
                own = pa.array(rows[starts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(to[starts[:-1]].astype(np.int32)), part.column(0).take(own), part.column(1).take(own), packed], names=["shard", "id", "vec", "lists"])

    asked = materialise(_queries(usable, is_query, dtype), "queries")
    distinct = asked.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    routed = distinct.mapInArrow(route, "shard int, id long, vec binary, lists binary").select("shard", F.lit(1).alias("kind"), F.lit(0).alias("list"), "id", "vec", "lists")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            """A shard's entries come first, then the queries that ask for some of its lists."""
            at_shard, waiting, scorer = None, [], None
            for batch in batches:
                shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                starts = starts_of(shard, kind)
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    if shard[a] != at_shard:
                        at_shard, waiting, scorer = shard[a], [], None
                    if kind[a] == 0:
                        waiting.append(batch.slice(a, b - a))
                        continue
                    if scorer is None and waiting:
                        whole = pa.Table.from_batches(waiting)
                        scorer, waiting = Scorer(whole.column(3).to_numpy(), _matrix(whole.column(4), dtype), whole.column(2).to_numpy(), keep), []
                    for first_row in range(a, b, BLOCK) if scorer else ():
                        part = batch.slice(first_row, min(BLOCK, b - first_row))
                        before = scorer.pairs
                        yield scorer.best(part.column(3).to_numpy(), _matrix(part.column(4), dtype), [np.frombuffer(x, np.int32) for x in part.column(5).to_pylist()])
                        if pairs is not None:
                            pairs.add(scorer.pairs - before)

        yield from _kept(found(), keep)

    together = entries.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind", "list")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    hits = together.mapInArrow(match, "query long, found long, score double").distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
    members = join_wide(hits, items.select(F.col("item").alias("found"), "ids"), "found").select("query", F.explode("ids").alias("vec_id"), "score")
    representative = join_wide(asked, distinct.select(F.col("id").alias("query"), "vec"), "vec").select(F.col("id").alias("query_id"), "query")
    scores = join_wide(members, representative, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _queries(usable: DataFrame, is_query: Column, dtype: str) -> DataFrame:
    """id, vec of the valid queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(valid(batch, dtype))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), pa.array([v for _, v in made], pa.binary())], names=["id", "vec"])

    asked = usable.where(is_query & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    return asked.mapInArrow(run, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))
