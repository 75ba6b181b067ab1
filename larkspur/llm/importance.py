"""Quality classifier by importance resampling.

Two generative models over hashed n-grams: the target's, from texts labelled
quality 1, and the raw one, from all documents.  A document's log weight is
TEMPER times the mean over its n-grams of log target share over raw share (the
mean, so that long texts don't outweigh all others); with Gumbel noise from a
hash of its doc_id added, the top k documents are a sample without replacement
in proportion to the weights.

N-grams: tokens (runs of letters and digits, runs of other characters), pairs
of neighbouring tokens, and whether a token equals one of the two before it,
each hashed to one of BUCKETS.

k is the size of the target in the corpus: the sum over all documents of the
probability, given the log weight, that a document is of quality 1.  That
probability is a logistic curve over log weights, fitted on labelled texts that
the target model has not seen: of at most FIT_ROWS labelled rows of each class
by hash of doc_id (one document an id; their ids are broadcast), one half gives
the target model and the other the curve; the raw model counts every document.
The k-th largest key is found by counting, not by gathering; ties with it are
all taken.

Nulls and edges: a null or blank text has no n-grams and log weight 0; texts of
any length count whole; a null doc_id hashes like a fixed string and is never
labelled; repeated rows get equal keys; without labels of both classes
everything is taken; an empty table gives no rows.  Only doc_id and text are
read; other columns, whatever their names, pass through ``take``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.chunks import Table, packed
from larkspur.llm.shared import aside, back, discard, hash_sample, join_small, map_texts, materialise, places

BUCKETS = 1 << 16
FIT_ROWS = 10_000
SMOOTHING = 20.0
TEMPER = 10.0
SEED = "sample-1"
_TOKEN = re.compile(r"[^\W_]+|[\W_]+")


class Hashes(Table):
    """The packed hashes of a word's tokens, found when a task first asks for the word."""

    def __missing__(self, word: str) -> bytes:
        return self.add(word, packed([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in _TOKEN.findall(word)]))


_hashes = Hashes()


def grams(texts: list[str]) -> list[np.ndarray]:
    """The bucket of each n-gram of each text."""
    found = []
    for text in texts:
        _hashes.trim()
        h = np.frombuffer(b"".join(map(_hashes.__getitem__, text.split())), "<u4").astype(np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        again = [np.uint64(d) + np.uint64(2) * (h[d:] == h[:-d]).astype(np.uint64) for d in (1, 2)]
        single = (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)
        found.append(np.concatenate([single % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS), *again]).astype(np.int64))
    return found


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of docs: partial sums by task, BUCKETS numbers at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in grams([t or "" for t in batch.column(0).slice(at, 256).to_pylist()]):
                    total += np.bincount(x, minlength=BUCKETS) if len(x) > BUCKETS else 0
                    if len(x) <= BUCKETS:
                        np.add.at(total, x, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[counted["bucket"].to_numpy(int)] = counted["n"].to_numpy()
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target share over raw share of each bucket, the raw counts scaled to the target's size and SMOOTHING added to both."""
    return np.log((target + SMOOTHING) / (raw * (target.sum() / max(raw.sum(), 1)) + SMOOTHING))


def weigh(docs: DataFrame, ratio: np.ndarray, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and log_weight."""

    def rows(_: list, texts: list[str]) -> dict:
        return {"log_weight": np.array([TEMPER * float(ratio[x].mean()) if len(x) else 0.0 for x in grams(texts)])}

    return map_texts(docs, "log_weight double", rows, keys)


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, good, text of at most fit_rows labelled ids of each class, one document each (of the least hash of its text)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good"))
    known = materialise(known, "quality-labels")
    chosen = [hash_sample(known.where(F.col("good") == c), fit_rows) for c in (1, 0)]
    found = join_small(docs.select("doc_id", "text"), materialise(chosen[0].union(chosen[1]), "quality-sample"), "doc_id", rows=2 * fit_rows)
    return found.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def logistic(good: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of the probability of good over the weight, by Newton's steps; the ridge keeps separable classes finite."""
    middle, width = weight.mean(), max(weight.std(), 1e-9)
    x = np.column_stack([np.ones(len(weight)), (weight - middle) / width])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (good - p) / len(x) - ridge * beta)
        beta += np.clip(move, -5, 5)
    return float(beta[0] - beta[1] * middle / width), float(beta[1] / width)


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value, by counts over ever narrower ranges."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return float("inf")
    left = k
    while low < high:
        width = (high - low) / bins
        inside = values.where(F.col(column).between(low, high))
        place = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        if len(rows) == 1 and (rows[0]["lo"], rows[0]["hi"]) == (low, high):
            return low
        for r in rows:
            if left <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            left -= r["n"]
        else:
            return low
    return low


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, tuple[float, float]] | None:
    """The log ratio of each bucket and the curve of quality 1 over log weights; None without labels of both classes."""
    known = materialise(labelled(docs, labels, fit_rows), "quality-texts")
    if known.select("good").distinct().count() < 2:
        return None
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    ratio = log_ratio(bucket_counts(known.where("good = 1").where(half == 0)), bucket_counts(docs))
    fitted = weigh(known.where(half == 1), ratio, ("good",)).toPandas()  # two numbers for each of at most 2 * fit_rows rows
    discard(known)
    if fitted["good"].nunique() < 2:
        return None
    return ratio, logistic(fitted["good"].to_numpy(float), fitted["log_weight"].to_numpy(float))


def sample_key(seed: str = SEED) -> Column:
    """log_weight with Gumbel noise from a hash of doc_id."""
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.col("log_weight") - F.log(-F.log(uniform))


def target_size(weighed: DataFrame, curve: tuple[float, float]) -> int:
    """How many documents of quality 1 there are: the sum of their probabilities."""
    logit = F.lit(curve[0]) + F.lit(curve[1]) * F.col("log_weight")
    return round(weighed.agg(F.sum(1 / (1 + F.exp(-logit)))).first()[0] or 0)


def resample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: str = SEED, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of every document; k: how many to take, if not the size of the target."""
    fitted = fit(docs, labels, fit_rows)
    if fitted is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("sample_key"), F.lit(True).alias("kept"))
    keyed = materialise(weigh(docs, fitted[0]).withColumn("sample_key", sample_key(seed)), "sample-keys")
    least = kth_largest(keyed, "sample_key", target_size(keyed, fitted[1]) if k is None else k)
    return keyed.withColumn("kept", F.col("sample_key") >= F.lit(least))


def take(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: str = SEED, k: int | None = None) -> DataFrame:
    """The documents that are taken, with all their columns: each is weighed again as it is read, so no text is shuffled, and none written beside its weight."""
    fitted = fit(docs, labels, fit_rows)
    if fitted is None:
        return docs
    weighed = lambda df, *keys: weigh(df, fitted[0], keys).withColumn("sample_key", sample_key(seed))
    keyed = materialise(weighed(docs.select("doc_id", "text"), "doc_id"), "sample-keys")
    least = kth_largest(keyed, "sample_key", target_size(keyed, fitted[1]) if k is None else k)
    discard(keyed)
    every = weighed(aside(docs, "doc_id", "text"), "doc_id", *places(docs.columns))
    return back(every.where(F.col("sample_key") >= F.lit(least)), docs.columns)
