"""Operators 11 and 12 against plain Python and numpy's eigenvectors, and at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import queries, target_resampling, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text):
    w = plain_words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aB1 \t-é漢😀", max_size=40), max_size=12), st.integers(0, 3))
def test_automaton_equals_regex_and_zlib(texts, skip):
    column = pa.array(["xx yy"] * skip + texts, pa.string()).slice(skip)
    row, found, n_words = target_resampling.features(column)
    assert n_words.tolist() == [len(plain_words(t)) for t in texts]
    assert sorted(zip(row.tolist(), found.tolist(), strict=True)) == sorted((i, bucket(f)) for i, t in enumerate(texts) for f in plain_features(t))


def test_long_words_and_longer_runs():
    texts = ["a" * 100_000 + " b", "é" * 70_000, "x y z x y z"]
    row, found, _ = target_resampling.features(pa.array(texts, pa.large_string()), runs=3)
    want = []
    for i, t in enumerate(texts):
        w = plain_words(t)
        want += [(i, bucket(" ".join(w[j : j + r]))) for r in (1, 2, 3) for j in range(len(w) - r + 1)]
    assert sorted(zip(row.tolist(), found.tolist(), strict=True)) == sorted(want)


def brute_resample(docs, target):
    s, t = Counter(), Counter()
    for text in target:
        t.update(map(bucket, plain_features(text)))
    for _, text in docs:
        s.update(map(bucket, plain_features(text)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        f = [gain[bucket(x)] for x in plain_features(text)]
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: 25 * len(enough) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def test_op12_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    want = brute_resample(docs, target)
    assert sorted(map(tuple, queries.op12_resampling(spark, sf_dir).collect())) == sorted(want)
    assert sum(r[4] is not None for r in want) > 20


def test_resampling_edges(spark, edge_docs, edge_rows, no_docs):
    long = " ".join(f"w{i % 50}" for i in range(300_000))
    rows = [(r[0], r[1]) for r in edge_rows] + [(500, long), (501, "same words here " * 20), (501, "same words here " * 20), (None, "other words now " * 20)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row long, rank long, score long").repartition(5)
    target = spark.createDataFrame([("same words here",), (None,), ("",)], "text string")
    got = target_resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(brute_resample(rows, ["same words here", None, ""]), key=order)
    assert target_resampling.resample(no_docs, target).count() == 0
    assert target_resampling.resample(docs, target.limit(0)).count() == len(rows)


def test_ranks_are_whole_over_many_partitions(spark):
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"), (F.col("id") % 7).alias("weight"), (F.col("id") % 7).alias("score")).repartition(9)
    got = target_resampling.ranked(rows).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, n // 4 + 1))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in rows.collect())[: n // 4]


def brute_whitening(vectors):
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    c = (fit - total / n).astype(np.float64)
    e, v = np.linalg.eigh(c.T @ c / n)
    return rows, n, total, e[::-1], v[:, ::-1]


def check(got, vectors):
    rows, n, total, e, v = brute_whitening(vectors)
    k = min(16, v.shape[1])
    assert len(got) == len(rows) * k
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, x in rows:
        exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, total.tolist(), strict=True))
        z = np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, total.tolist(), strict=True)]) @ v[:, :k] / np.sqrt(e[:k])
        for j in range(k):
            r = by_id[i, j + 1]
            assert (r["n"], r["deviation"]) == (n, exact)
            assert abs(r["explained"] / (e[j] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
            if abs(z[j]) > 1e-3:
                signs.setdefault(j, np.sign(z[j] * r["whitened"]))
            assert abs(r["whitened"] * signs.get(j, 1) - z[j]) < 1e-7


def test_op11_equals_eigenvectors(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, sf_dir).collect(), vectors)


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(200)]
    copies = [(1000 + i, vectors[0][1]) for i in range(300)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0]), (2003, [float("nan")] * 5), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, x long, n long, whitened string"
    frame = lambda rows: spark.createDataFrame([(*r, 1, 2, "c") for r in rows], schema).repartition(7)
    got = whitening.whiten(frame(vectors + copies + odd)).collect()
    check(got, vectors + copies)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame(copies)).count() == 0
    flat = [(i, [float(a), 2.0 * a, 0.0]) for i, a in enumerate(range(20))]
    assert {r["component"] for r in whitening.whiten(frame(flat)).collect()} == {1}
    same_id = whitening.whiten(frame([(None, v) for _, v in vectors])).collect()
    assert len(same_id) == 1000 and {r["vec_id"] for r in same_id} == {None}
    far = whitening.whiten(frame([(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 0.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in far}[0] is None


def test_merged_factors_have_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 6)) + 1_000_000
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    n, total = whitening.sums(fit)
    assert n == 3000 and total == x.sum(axis=0).tolist()
    monkeypatch.setattr(whitening, "MERGED", 3)
    r = whitening.factor(fit, n, total)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)
    sigma, v = whitening.jacobi(r)
    assert np.allclose(sigma, np.linalg.svd(c, compute_uv=False), rtol=1e-13) and np.allclose(v.T @ v, np.eye(6), atol=1e-13)


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_pairings_meet_once(d):
    met = Counter((int(a), int(b)) for x, y in whitening.pairings(d) for a, b in zip(x, y, strict=True))
    assert met == {(a, b): 1 for a in range(d) for b in range(a + 1, d)}


def test_jacobi_keeps_small_singular_values():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    scale = 10.0 ** -np.arange(8)
    sigma, _ = whitening.jacobi(q * scale)
    assert np.allclose(sigma, scale, rtol=1e-12)
    assert whitening.square_sums(np.array([[1 << 31, 1 << 31], [3, 4], [1 << 32, 0]], object)) == [None, 25, None]
