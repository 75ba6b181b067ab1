"""MinHash near-duplicates against all pairs of sets."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import components, confirm, minhash, queries
from larkspur.llm.shared import materialise


def plain_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    found = [(d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)]
    return sorted(((*f, f[0] == f[2]) for f in found), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def corpus(seed=1, bases=12, copies=14):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        texts += [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 15))) for _ in range(copies)]
    return texts


def test_op13_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_minhash(spark, sf_dir).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("max_list", [20_000, 7])
def test_edited_copies_edges_and_large_lists(spark, edge_rows, monkeypatch, max_list):
    """With lists cut into parts of about seven and windows of four, every link is found all the same."""
    monkeypatch.setattr(confirm, "MAX_LIST", max_list)
    monkeypatch.setattr(confirm, "SMALL", 3 if max_list == 7 else confirm.SMALL)
    monkeypatch.setattr(confirm, "WINDOW", 4 if max_list == 7 else confirm.WINDOW)
    monkeypatch.setattr(confirm, "EACH", 2)
    monkeypatch.setattr(confirm, "MAX_SETS", 5 if max_list == 7 else confirm.MAX_SETS)
    texts = corpus()
    rows = [(r[0], r[1]) for r in edge_rows] + [(1000 - i, t) for i, t in enumerate(texts)] + [(5000, texts[0])] * 3 + [(None, texts[5]), (None, "one two")]
    docs = spark.createDataFrame([(*r, b"x", 1, 2) for r in rows], "doc_id long, text string, code binary, size long, root long").repartition(6)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_no_link_at_all(spark):
    rows = [(i, " ".join(f"{i}-{j}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=repr) == brute(rows)


def test_groups_of_near_copies_make_few_rows(spark, monkeypatch):
    """Copies that link through a common text, and others alike but below the limit: about a row a class and bucket is written, never all pairs."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 6 if i < 150 else 14) if i else base)) for i in range(300)]
    made = []
    proposed = confirm.proposed
    monkeypatch.setattr(confirm, "proposed", lambda *a: made.append((f := proposed(*a)).count()) or f)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert len(made) == 2 and max(made) < 300 * minhash.PREFIX // 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 25))
def test_links_join_what_all_pairs_join(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**60, 40).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 2**60, 40).astype(np.uint64), base)[: rng.integers(20, 40)]) for _ in range(n)]
    labels = rng.integers(0, n, n)
    parent = {int(v): int(v) for v in labels}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(int(labels[i]))] = root(int(labels[j]))
    want = [root(int(v)) for v in labels]
    codes = [bytes([i]) for i in range(n)]
    parent = {int(v): int(v) for v in labels}
    links = confirm.joining(codes, [s.tobytes() for s in sets], labels, None, 80)
    for a, b in links:
        assert root(int(labels[a[0]])) != root(int(labels[b[0]]))
        parent[root(int(labels[a[0]]))] = root(int(labels[b[0]]))
    got = [root(int(v)) for v in labels]
    same = lambda g: {frozenset(i for i in range(n) if g[i] == k) for k in g}
    assert same(got) == same(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 60))
def test_merge_counts_collisions(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, minhash.COORDINATES, dtype=np.uint32)
    sigs = np.where(rng.random((n, minhash.COORDINATES)) < 0.75, base, rng.integers(0, 2**32, (n, minhash.COORDINATES), dtype=np.uint32))
    labels = rng.integers(0, max(2, n // 3), n)
    found = {tuple(sorted(p)) for i, j in minhash.merged(sigs, labels) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if labels[i] != labels[j] and (sigs[i] == sigs[j]).sum() >= minhash.MATCHES}


def test_signature_estimates_similarity():
    a, b = (confirm.shingle_set(" ".join(f"w{i}" for i in r), 4) for r in (range(2000), range(200, 2200)))
    sa, sb = minhash.values_of([minhash.signature(x) for x in (a, b)])
    assert abs((sa == sb).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    assert len(confirm.shingle_set("a b", 4)) == 1 and len(confirm.shingle_set(" ", 4)) == 0
    assert confirm.shingle_set("A b c", 4) == confirm.shingle_set("a  B\nc", 4) != confirm.shingle_set("a b", 4)


def test_large_sets_in_pieces_have_the_same_signature(monkeypatch):
    x = confirm.shingle_set(" ".join(f"w{i}" for i in range(9000)), 4)
    whole = minhash.signature(x)
    monkeypatch.setattr(minhash, "AT_ONCE", 77)
    assert minhash.signature(x) == whole


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    """However small Spark takes postings, labels and pointers to be, no join of them goes through the driver."""
    plans = []

    def spied(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, name)

    for module in (confirm, components):
        monkeypatch.setattr(module, "materialise", spied)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(40)]
    assert sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == brute(rows)
    joins = [(name, plan) for name, plan in plans if "Join" in plan and name != "links"]  # links: texts meet a counted list of the wanted ones
    assert {"members", "pointers", "class-roots"} <= {name for name, _ in joins}
    assert not [name for name, plan in joins if "Broadcast" in plan]
