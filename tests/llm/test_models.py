"""Fitted operators by held-out accuracy and brute force; the pipeline stage by stage."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import ann, importance, queries, secret_scan, toxicity
from larkspur.llm.shared import materialise, table

SF = "/root/testdata/sf0.1"


def labels_of(spark, sf, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_toxicity_on_held_out_rows(spark):
    toxic = labels_of(spark, SF, "toxic")
    rows = queries.QUERIES["op4_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    bad, good = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert ((bad[:, None] > good) + 0.5 * (bad[:, None] == good)).mean() > 0.95
    assert (good >= 0.5).mean() < 0.02


def test_swapping_groups_moves_scores_little():
    """Toxic texts that name one group: without the penalty the group's name itself becomes toxic."""
    none = np.zeros(0, int)
    texts = [np.array([0, 2])] * 30 + [np.array([0])] * 6 + [np.array([1])] * 30 + [np.array([3])] * 30
    gone = [np.array([0])] * 36 + [np.array([1])] * 30 + [none] * 30
    come = [np.array([1])] * 36 + [np.array([0])] * 30 + [none] * 30
    y = np.array([1] * 30 + [0] * 66, float)
    gap = {}
    for penalty in (0.0, 3.0):
        w, _ = toxicity.train(texts, gone, come, y, np.ones(len(y)), np.ones(4), penalty)
        gap[penalty] = abs(w[0] - w[1])
        assert w[2] > 0.5
    assert gap[3.0] < 0.3 * gap[0.0]


def test_identity_terms_swap():
    swap = toxicity.Swap(toxicity.IDENTITY_GROUPS)
    assert swap("Women and MEN") == "men and women" and swap("womenfolk") is None


def test_the_penalty_acts_through_fit(spark):
    """Groups are found in the sample; with the penalty their terms move scores less, on the same texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, compare=True)
    found = [g for g in model.groups if g not in toxicity.IDENTITY_GROUPS]
    assert len(found) > 10 and model.swapped > 100
    assert 0 < model.change < 0.7 * model.change_without
    bad = {"idiot", "loser", "scum", "moron", "stupid", "pathetic"}
    assert not bad & {t for g in found for t in g}


def test_scores_by_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        words = set("".join(c if ord(c) > 127 or c.isalnum() else " " for c in r["text"].lower()).encode().split())
        names = words | {b"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}
        logit = model.intercept + sum(weights.get(h, 0.0) for h in {zlib.crc32(n) for n in names})
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_toxicity_edges(spark, edge_docs, edge_rows, no_docs):
    docs = edge_docs.unionByName(spark.createDataFrame([(1000 + i, "you vile oaf" if i % 2 else "a kind word", "en", "s", 1) for i in range(60)], edge_docs.schema))
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(edge_rows) + 60 and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows if (r["doc_id"] or 0) >= 1000)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(no_docs, none).collect() == [] and not len(none.keys)


def test_held_out_labels_never_reach_the_model(spark):
    docs = spark.createDataFrame([(i, "you vile oaf" if i % 2 else "a kind word") for i in range(200)], "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    assert 10 < sum(held) < 190
    models = [toxicity.fit(docs, spark.createDataFrame([(i, of(i) if held[i] else i % 2) for i in range(200)], "doc_id long, toxic int")) for of in (lambda i: 0, lambda i: 1)]
    assert models[0].intercept == models[1].intercept and len(models[0].keys) and (models[0].weights == models[1].weights).all()


def test_importance_keeps_the_clean_and_drops_the_rest(spark):
    quality = labels_of(spark, SF, "quality")
    rows = queries.QUERIES["op8_importance"](spark, SF).collect()
    kept = {r["doc_id"] for r in rows}
    assert all(r["kept"] for r in rows)
    rate = {q: np.mean([d in kept for d, y in quality.items() if y == q]) for q in (0, 1)}
    assert rate[1] > 0.98 and rate[0] < 0.05


def test_the_sample_is_the_gumbel_top_k(spark, sf_dir):
    """The drawn set against keys made and sorted by plain code; as many are drawn as the curve says."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = importance.resample(docs, labels).collect()
    keys = {}
    for r in rows:
        u = (int(hashlib.md5(f"{importance.SEED}:{r['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keys[r["doc_id"]] = r["log_weight"] - np.log(-np.log(u))
    ratio, (a, b) = importance.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        (grams,) = importance.grams([texts[r["doc_id"]]])
        assert r["log_weight"] == pytest.approx(importance.TEMPER * ratio[grams].mean() if len(grams) else 0.0)
    k = round(sum(1 / (1 + np.exp(-(a + b * r["log_weight"]))) for r in rows))
    best = sorted(keys, key=keys.get, reverse=True)[:k]
    assert {r["doc_id"] for r in rows if r["kept"]} == set(best) and 0 < k < len(rows)


def test_noise_decides_between_like_weights(spark):
    """Inclusion over seeds: equal weights are taken about as often, higher ones more often."""
    rows = spark.createDataFrame([(i, 0.0 if i < 100 else 1.0) for i in range(200)], "doc_id long, log_weight double")
    taken = np.zeros(200)
    for seed in range(40):
        keyed = rows.withColumn("sample_key", importance.sample_key(f"s{seed}")).toPandas()
        taken[keyed.nlargest(60, "sample_key")["doc_id"]] += 1
    low, high = taken[:100], taken[100:]
    assert 0 < low.mean() < high.mean() < 40 and (taken > 0).mean() > 0.95 and 1.8 < high.mean() / low.mean() < 3.5


def test_kth_largest(spark):
    values = [0.5, 2.0, 2.0, 2.0, -1.0, 7.0, 1e9, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, "v", k, bins=3) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0) == float("inf") == importance.kth_largest(df.limit(0), "v", 3)


def test_importance_edges(spark, edge_docs, edge_rows, no_docs):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.take(edge_docs, no_labels).count() == len(edge_rows)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], no_labels.schema)
    taken = importance.take(edge_docs, some)
    kept = {r["doc_id"] for r in importance.resample(edge_docs, some).where("kept").collect()}
    assert taken.columns == edge_docs.columns and {r["doc_id"] for r in taken.collect()} == kept
    assert importance.take(no_docs, some).collect() == []


def nearest(ids, x, query, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[query]
    s[query] = -9
    return [ids[i] for i in np.lexsort((ids, -s))[:k]]


def test_neighbours_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries.QUERIES["op9_neighbours"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked])
    hits = 0
    place = {i: n for n, i in enumerate(ids)}
    for q in asked:
        found = sorted(got[ids[q]])
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        for _, i, s in found:
            v = x[place[i]]
            assert s == pytest.approx(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]), abs=1e-12)
        hits += len({i for _, i, _ in found} & set(nearest(ids, x, q, 5)))
    assert hits >= 0.9 * 5 * len(asked)


def test_neighbours_of_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, list_size=8, shard_entries=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[0]) == [(i, i) for i in range(1, 6)]
    assert sorted(got[50]) == [(i + 1, i) for i in range(5)]
    assert set(got) == {0, 50, 100} and not {i for x in got.values() for _, i in x} & {200, 201, 202, 203, 204}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def exact(rows, k=5):
    """query, vec_id of the k nearest of every fiftieth, in exact order, ties to the smaller id."""
    made = {}
    for q, x in rows:
        if q % 50 == 0:
            scale = lambda v: np.array(v) / np.abs(v).max()
            cosine = {i: float(scale(x) @ scale(v) / np.linalg.norm(scale(x)) / np.linalg.norm(scale(v))) for i, v in rows if i != q}
            made[q] = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:k]
    return made


def test_ties_go_to_the_smaller_id_whatever_the_lengths(spark):
    """40 copies of one direction at lengths that are powers of two."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.5 * 2.0**((7 * i) % 40), -2.25 * 2.0**((7 * i) % 40), 0.5 * 2.0**((7 * i) % 40)]) for i in range(0, 41)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(60)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0, recall=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert [got[0][i] for i in range(1, 6)] == [1, 2, 3, 4, 5] == exact(rows)[0]


@pytest.mark.parametrize("size", [1e-200, 5e-324, 1e200])
def test_tiny_and_huge_vectors_lose_nothing(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)]
    rows += [(150, [size, 0.0, 0.0, 0.0]), (200, [size, size, 0.0, size])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, recall=1.0).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = exact(rows)
    assert set(got) == {50, 100, 150, 200} and all(np.isfinite(r["score"]) for r in found)
    hits = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert hits >= 18 and all(len(x) == 5 for x in got.values())


def test_lists_are_pruned(spark):
    """Clustered vectors: a query scores few of them and finds its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.1 * rng.normal(size=16)).tolist()) for i in range(3000)]
    pairs = spark.sparkContext.accumulator(0)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0, shard_entries=500, pairs=pairs).collect()
    want = exact(rows)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 5 * 60
    assert pairs.value < 0.2 * 60 * 3000


def test_the_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        seen.append((name, before, docs))
    assert [d.columns for _, _, d in seen[:-1]] == [columns] * 4
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for _, _, d in seen[:-1]]
    given = {r["doc_id"]: r["text"] for r in seen[0][1].collect()}
    assert texts[0].items() <= given.items()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts[0].items() for w in [t.lower().split()]}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    left = sorted(texts[1])
    assert not any(alike(a, b) for n, a in enumerate(left) for b in left[:n])
    assert all(any(alike(i, j) for j in texts[0] if j != i) for i in texts[0].keys() - texts[1].keys())
    assert texts[2] == {i: secret_scan.masked(t, secret_scan.spans(t)) for i, t in texts[1].items()}
    assert texts[3].items() <= texts[2].items()
    coded = seen[-1][2]
    assert coded.count() == seen[-1][1].count() and coded.columns[:3] == ["doc_id", "source", "n_tokens"]
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["ids_sha256"] for r in coded.collect())


def test_extra_columns_with_clashing_names_pass_through(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = ["size", "copies", "copy", "taken", "target", "source_size", "log_weight", "sample_key", "clean", "changed", "kept_id", "count", "fp", "_0", "_text", "component_id"]
    more = docs.select(*docs.columns, *(F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, clash = materialise(stage(spark, docs, sf_dir), "plain"), materialise(stage(spark, more, sf_dir), "clash")
        assert clash.columns == more.columns
        rows = clash.collect()
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, plain.collect()))
        docs, more = plain, clash
    assert corpus_pipeline.STAGES[-1][1](spark, more, sf_dir).count() == docs.count()


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(1, 0.1 / 1.01**0.5), (2, 1 / 1.01**0.5)]
    got = sorted((r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(i, pytest.approx(s)) for i, s in want]


def test_every_stage_takes_edges(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 3 * max(1, docs.count())


def test_megabyte_texts_repeated_rows_and_clashing_columns(spark):
    """Fitted operators on long texts, one huge word, repeated rows and columns with their own names."""
    base = [(i, ("you vile oaf " if i % 2 else "a kind word ") * (1 + i % 7), "en", "s", 1) for i in range(80)]
    odd = [(100, "word and " * 120_000, "en", "s", 1), (101, "x" * 1_000_000, "en", "s", 1), *base[:5], *base[:5]]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in ("toxic", "score", "words", "own", "good", "log_weight", "quality", "anomaly", "n_words", "ids"):
        docs = docs.withColumn(name, F.lit(f"{name}-x"))
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    drawn = importance.resample(docs, labels).collect()
    taken = importance.take(docs, labels)
    for rows in (scored, drawn):
        assert len(rows) == len(base) + len(odd)
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add(tuple(r))
        assert all(len(x) == 1 for x in by_id.values())
    assert taken.columns == docs.columns and taken.where("good <> 'good-x'").isEmpty()


def test_fitting_holds_no_number_for_each_pair_of_centroids(monkeypatch):
    """The driver's memory while centroids are fitted and linked is bounded, however many there are."""
    monkeypatch.setattr(ann, "VALUES", 1 << 16, raising=False)
    monkeypatch.setattr(ann, "ROUNDS", 1)
    x = np.random.default_rng(5).standard_normal((8192, 8)).astype(np.float32)
    tracemalloc.start()
    try:
        index = ann.Centroids.fit(x, 2048)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    k = len(index.points)
    assert k >= 2048 and index.links.shape == (k, ann.NEIGHBOURS + 3)
    assert peak < 4 * k * k, (peak, k)
