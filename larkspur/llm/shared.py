"""Small helpers of this subpackage: shared folders, size-checked and hot-key joins, run-wise tasks."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts that a task holds as Python objects at once.
ROWS_AT_ONCE = 512

#: Rows up to which the smaller side of a join is broadcast.
BROADCAST_ROWS = 10_000

#: A key with more than this share of all rows is hot.
HOT_SHARE = 0.001

_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in a local session that sets none, as in tests."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _tables[made] = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in made:
        if (path := _tables.pop(df, None)) is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is done: its cleaner takes what the driver's JVM has collected, which else waits until the heap is full."""
    spark._jvm.System.gc()


def join_hot(rows: DataFrame, right: DataFrame, key: str, hot: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join, but rows whose ``key`` is one of ``hot`` meet a broadcast of right's rows of these keys and are not shuffled.

    hot: a few values of ``key`` (at most 1 / HOT_SHARE) that hold a large share of rows each; right has one row or few a key.
    """
    few = F.broadcast(hot.select(F.col(key).alias("_hot")).distinct())
    of_hot, of_rest = (rows.join(few, F.col(key) == F.col("_hot"), kind) for kind in ("left_semi", "left_anti"))
    hot_right = right.join(few, F.col(key if key in right.columns else f"kept_{key}") == F.col("_hot"), "left_semi")
    return of_hot.join(F.broadcast(hot_right), on, how).unionByName(join_wide(of_rest, right, on, how))


def join_small(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with right broadcast if it is counted to have at most ``rows`` rows, else by sorted shuffles."""
    return left.join(F.broadcast(right), on, how) if right.limit(rows + 1).count() <= rows else join_wide(left, right, on, how)


def join_wide(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join two tables that grow by sorted shuffles: neither side is broadcast, however small Spark takes what an explode or a map makes of it to be."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def hash_sample(df: DataFrame, n: int, key: str | tuple[str, ...] = "doc_id", seed: int = 0) -> DataFrame:
    """At most n rows, those of the least hashes of ``key`` (one column or several).

    Rows that agree in the whole key have one place and count once, by the number
    of distinct keys, so a key that many rows share can neither fill the sample nor
    leave it empty.  Most rows fall to a bound on the hash before the sort, so what the
    tasks hand over for the last choice is about 1.2 n rows in all, however many
    tasks there are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    span = 1 << 30
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(span))
    total = df.agg(F.approx_count_distinct(F.xxhash64(*keys), 0.02)).first()[0]
    if total > 2 * n:
        df = df.where(place < int(span * min(1.0, (1.3 * n + 100) / total)))
    return df.dropDuplicates(keys).orderBy(place, *keys).limit(n)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def places(columns: list[str]) -> tuple[str, ...]:
    """The names under which ``aside`` puts columns."""
    return tuple(f"_{i}" for i in range(len(columns)))


def aside(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and every column of docs under its place, so that no name of docs clashes with an operator's own."""
    return docs.select(*named, *(docs[f"`{c}`"].alias(place) for c, place in zip(docs.columns, places(docs.columns), strict=True)))


def back(made: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns that were put aside, under their names, some of them changed."""
    return made.select(*((changed or {}).get(c, F.col(place)).alias(c) for c, place in zip(columns, places(columns), strict=True)))


def map_texts(df: DataFrame, schema: str, rows_of: Callable[[list, list[str]], dict[str, list | np.ndarray | pa.Array]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Call rows_of(key columns, texts) on each Arrow batch; it returns the columns after the keys, as long as the batch."""
    kept = [f for f in df.schema.fields if f.name in keys]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = [part.column(i) for i in range(len(kept))]
                made = rows_of(columns, part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*columns, *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], names=[*(f.name for f in kept), *made])

    return df.select(*(f.name for f in kept), text_of().alias("text")).mapInArrow(run, out)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in the first ``keys`` columns, of batches that are sorted by them.

    Memory holds one Arrow batch, and the longest run.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _last_run(batch, keys)
        if ends == 0 and (not waiting or _same(waiting[-1], batch, keys)):
            waiting.append(batch)
            continue
        if waiting and not _same(waiting[-1], batch, keys):
            yield pa.Table.from_batches(waiting)
            waiting = []
        if ends:
            yield pa.Table.from_batches([*waiting, batch.slice(0, ends)])
            waiting = []
        waiting.append(batch.slice(ends))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _key(batch: pa.RecordBatch, row: int, keys: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in range(keys))


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    return _key(a, a.num_rows - 1, keys) == _key(b, 0, keys)


def _last_run(batch: pa.RecordBatch, keys: int) -> int:
    """Where the last run of equal keys starts."""
    at = 0
    for i in range(keys):
        x = batch.column(i).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(x != x[-1])
        at = max(at, int(other[-1]) + 1 if len(other) else 0)
    return at


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal values, and the number of rows at the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    if n:
        change[0] = True
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), n)
