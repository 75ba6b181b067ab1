"""Keyed tables that streams keep: hash buckets of Parquet files, committed batch by batch.

A row lies in the bucket of its keys' hash.  A micro-batch reads and writes only the
buckets that its keys fall to, as files of a new generation (its epoch), and then
commits by one small file that says which generations each bucket consists of.
A reader sees the last commit.  A batch that is run again after its commit
changes nothing; one that failed before it starts from the same state.  A
generation that neither of the last two commits names is deleted.

``merge`` replaces the touched buckets by what ``apply`` makes of them.  ``append``
only adds rows, with a Bloom filter for each bucket and generation, so ``unseen``
reads just the buckets that may hold an id of the batch, and keeps ids for good.

One store belongs to one stream and its checkpoint, since epochs order its commits.
Null keys fall into a bucket like any others.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkspur.operators import mutations

#: Bits for each key and bits that it sets in a Bloom filter: about one in a hundred ids is a false alarm.
BLOOM_BITS, BLOOM_HASHES = 10, 5
#: Rows of a bucket that one task writes: a larger bucket is dealt to several tasks, which leave a file each.
BUCKET_ROWS = 250_000
#: Generations of a bucket that appends may leave before they are put together.
MAX_GENERATIONS = 16


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share; a temporary one only in a local session that names none."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        known = spark.sparkContext.getCheckpointDir()
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bloom(hashes: np.ndarray, size: int) -> np.ndarray:
    """The places of each key in a filter of so many bits."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return ((low[:, None] + high[:, None] * np.arange(1, BLOOM_HASHES + 1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class Store:
    """path: its folder; schema: DDL of the rows; keys: columns of the key."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 32

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _place(self, spark: SparkSession, name: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def _names(self, spark: SparkSession, name: str) -> list[str]:
        files, place = self._place(spark, name)
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def commits(self, spark: SparkSession) -> list[int]:
        return sorted(int(n) for n in self._names(spark, "commits") if n.isdigit())

    def held(self, spark: SparkSession, epoch: int | None = None) -> dict[int, list[int]]:
        """The generations of each bucket at a commit, the last one unless told."""
        known = self.commits(spark)
        if not known:
            return {}
        text = spark.read.text(f"{self.path}/commits/{known[-1] if epoch is None else epoch}", wholetext=True).first()[0]
        return {int(b): g for b, g in json.loads(text).items()}

    def _commit(self, spark: SparkSession, epoch: int, held: dict[int, list[int]]) -> None:
        files, draft = self._place(spark, f"commits/{epoch}.draft")
        out = files.create(draft, True)
        out.writeBytes(json.dumps(held))
        out.close()
        files.rename(draft, self._place(spark, f"commits/{epoch}")[1])
        known = self.commits(spark)
        named = {g for e in known[-2:] for of in self.held(spark, e).values() for g in of}
        for kind in ("data", "blooms"):
            for name in self._names(spark, kind):
                if int(name.split("=")[1]) not in named | {epoch}:
                    files.delete(self._place(spark, f"{kind}/{name}")[1], True)
        for e in known[:-2]:
            files.delete(self._place(spark, f"commits/{e}")[1], False)

    def read(self, spark: SparkSession, buckets: list[int] | None = None, held: dict[int, list[int]] | None = None) -> DataFrame:
        """The rows of the last commit, of some buckets if asked for."""
        held = self.held(spark) if held is None else held
        paths = [f"{self.path}/data/epoch={g}/_bucket={b}" for b in sorted(held) if buckets is None or b in buckets for g in held[b]]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, epoch: int, n: int, buckets: int) -> list[int]:
        """Write rows, at most n in so many buckets, as a generation; returns the buckets that have some."""
        spark, path = rows.sparkSession, f"data/epoch={epoch}"
        parts = max(1, -(-n // (max(1, buckets) * BUCKET_ROWS)))
        placed = rows.withColumn("_bucket", self.bucket())
        part = F.pmod(F.xxhash64(*self.keys, F.lit(2)), F.lit(parts))
        dealt = placed.repartition("_bucket") if parts == 1 else placed.repartition(max(1, buckets) * parts, "_bucket", part)
        dealt.write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/{path}")
        return [int(n.split("=")[1]) for n in self._names(spark, path) if n.startswith("_bucket=")]

    def _touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``

    def merge(self, batch: DataFrame, epoch: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the buckets of the batch's keys by apply(their rows, batch)."""
        spark, known = batch.sparkSession, self.commits(batch.sparkSession)
        if known and epoch <= known[-1]:
            return
        held, touched = self.held(spark), self._touched(batch)
        fields = spark.createDataFrame([], self.schema).columns
        state = self.read(spark, touched, held)
        made = self._write(apply(state, batch).select(*fields), epoch, state.count() + batch.count(), len(touched))
        self._commit(spark, epoch, {b: g for b, g in held.items() if b not in touched} | {b: [epoch] for b in made})

    def append(self, rows: DataFrame, epoch: int) -> None:
        """Add rows, and filters of their keys; a bucket of many generations is written anew."""
        spark, known = rows.sparkSession, self.commits(rows.sparkSession)
        if known and epoch <= known[-1]:
            return
        held = self.held(spark)
        touched = self._touched(rows)
        many = [b for b in touched if len(held.get(b, ())) >= MAX_GENERATIONS]
        whole = rows.unionByName(self.read(spark, many, held)) if many else rows
        made = self._write(whole, epoch, whole.count(), len(touched))
        self._filters(spark.read.schema(self.schema).parquet(*(f"{self.path}/data/epoch={epoch}/_bucket={b}" for b in made)) if made else rows.limit(0), epoch)
        self._commit(spark, epoch, held | {b: [*(held.get(b, []) if b not in many else []), epoch] for b in made})

    def _filters(self, rows: DataFrame, epoch: int) -> None:
        def build(key: tuple, table: pa.Table) -> pa.Table:
            hashes = table.column("h").to_numpy().view(np.uint64)
            size = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
            bits = np.zeros(size, bool)
            bits[_bloom(hashes, size)] = True
            return pa.table({"_bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        keyed = rows.select(self.bucket().alias("_bucket"), F.xxhash64(*self.keys, F.lit(1)).alias("h"))
        keyed.groupBy("_bucket").applyInArrow(build, "_bucket int, bits binary").write.mode("overwrite").parquet(f"{self.path}/blooms/epoch={epoch}")

    def _suspects(self, batch: DataFrame, held: dict[int, list[int]]) -> list[int]:
        """Buckets in which some key of the batch may be, by the filters; each bucket's keys meet its filters in one task."""
        spark = batch.sparkSession
        gens = sorted({g for of in held.values() for g in of})
        if not gens:
            return []
        blooms = spark.read.schema("_bucket int, bits binary").parquet(*(f"{self.path}/blooms/epoch={g}" for g in gens))

        def meet(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
            hashes = keys.column("h").to_numpy().view(np.uint64)
            hit = any(np.unpackbits(np.frombuffer(bits, np.uint8))[_bloom(hashes, 8 * len(bits))].all(axis=1).any() for bits in filters.column("bits").to_pylist()) if len(hashes) else False
            return pa.table({"_bucket": pa.array([key[0].as_py()] if hit else [], pa.int32())})

        keyed = batch.select(self.bucket().alias("_bucket"), F.xxhash64(*self.keys, F.lit(1)).alias("h"))
        return [r[0] for r in keyed.groupBy("_bucket").cogroup(blooms.groupBy("_bucket")).applyInArrow(meet, "_bucket int").collect()]  # at most ``buckets``

    def unseen(self, batch: DataFrame, epoch: int) -> tuple[DataFrame, int]:
        """The rows of the batch whose keys no earlier epoch appended, and how many buckets had to be read; the schema needs a column epoch."""
        held = self.held(batch.sparkSession)
        suspects = self._suspects(batch, held)
        before = self.read(batch.sparkSession, suspects, held).where(F.col("epoch") < epoch).select(*self.keys)
        return batch.join(before, list(self.keys), "left_anti"), len(suspects)

    def follow(self, stream: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
        """Merge every micro-batch of a stream."""
        return for_each(stream, lambda batch, epoch: self.merge(batch, epoch, apply), checkpoint, mode, trigger)


def for_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Call write(batch, epoch) on every micro-batch that has rows, computed once; what exists by then, unless a trigger says otherwise."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                write(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_wins(keys: list[str], order: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """An ``apply`` that keeps the row of each key that comes first in ``order``, of state and batch together."""
    return lambda state, batch: mutations.latest(state.unionByName(batch.select(*state.columns)), keys, order)
