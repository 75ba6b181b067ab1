"""Near-dedup at a similarity, against exact similarities of all pairs."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import confirm, similar
from larkspur.llm.shared import materialise, shared_dir


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_link_and_others_do_not(spark):
    """Copies with every 90th word changed (similarity near 0.9) go; texts that share a third of their words stay."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    rows = []
    for i in range(40):
        own = text(360)
        near = [w if j % 90 else f"changed{i}" for j, w in enumerate(own)]
        part = own[:120] + text(240)
        rows += [(3 * i, own), (3 * i + 1, near), (3 * i + 2, part)]
    rows = [(i, " ".join(t)) for i, t in rows]
    assert all(jaccard(rows[3 * i][1], rows[3 * i + 1][1]) > 0.85 and jaccard(rows[3 * i][1], rows[3 * i + 2][1]) < 0.5 for i in range(40))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in similar.keep_one(docs).collect()}
    assert all(3 * i in kept and 3 * i + 2 in kept for i in range(40))
    assert sum(3 * i + 1 in kept for i in range(40)) <= 4


def test_hot_classes_are_kept_once(spark):
    """A third of all rows is one text, more are blank; no copy is left, ids may repeat."""
    rows = [(i % 50, "the same words over and over again here") for i in range(400)] + [(i, "") for i in range(300)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = [(r["doc_id"], r["text"]) for r in similar.keep_one(docs).collect()]
    assert sorted(kept) == sorted([rows[0], rows[400], *rows[700:]])


def test_one_of_each_group_stays_whatever_the_ids(spark):
    """Groups of unlike texts that share null or repeated ids, one of them with its smallest id in another group too."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (None, texts[4]), (2, texts[5]), (5, texts[5]), (1, texts[6]), (1, texts[6]), (1, texts[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (2, texts[5]), (1, texts[6]), (1, texts[7])]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def plain_sets(texts):
    found = []
    for t in texts:
        w = (t or "").encode().lower().split()
        found.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return found


def alike_pairs(sets, percent=80):
    """All pairs of unlike sets of a similarity of 0.8 or more, by counting shared shingles."""
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = Counter((a, b) for at in where.values() for n, b in enumerate(at) for a in at[:n])
    return {(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def pairs_of_texts():
    """Texts in pairs of all similarities about 0.8, sets of 30 to 600 shingles."""
    rng = random.Random(11)
    texts = []
    for _ in range(260):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 90, 200, 600]))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.randrange(1, 2 + len(base) // 40)))]
    return texts


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_links_are_exact_and_recall_holds(spark, pairs_of_texts):
    """No pair below 0.8 is joined, and at least 0.9 of those from there on are, with keys of a width for tens of millions of texts."""
    assert similar.KEY_BITS == 16  # 65,536 buckets a mask, whatever the table's size
    texts = pairs_of_texts
    want = alike_pairs(plain_sets(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = materialise(confirm.coded(confirm.with_text_key(docs), similar.SHINGLE, similar.fingerprint), "rows")
    of_class, _ = confirm.groups(rows, confirm.with_text_key(docs).select("th", "text"), similar.SHINGLE, similar.with_keys, similar.SEARCH)
    root = {r["doc_id"]: bytes(r["root"]) for r in rows.join(of_class, "code").select("doc_id", "root").collect()}
    exact = components(len(texts), want)
    members = defaultdict(set)
    for i, r in root.items():
        members[r].add(exact[i])
    assert all(len(m) == 1 for m in members.values())
    found = sum(root[a] == root[b] for a, b in want)
    assert len(want) > 120 and found >= 0.9 * len(want), (found, len(want))


def test_stage_keeps_one_of_each_exact_group(spark):
    """On the given documents the rows kept are those of exact groups, but for pairs that no key finds."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = plain_sets([t for _, t in rows])
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    copies = [(first[frozenset(s)], i) for i, s in enumerate(sets)]
    exact = components(len(rows), [*alike_pairs(sets), *copies])
    want = {min(rows[j][0] for j in range(len(rows)) if exact[j] == r) for r in set(exact)}
    kept = {r["doc_id"] for r in similar.keep_one(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert want <= kept and len(kept) - len(want) <= 0.1 * (len(rows) - len(want))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 200))
def test_search_finds_all_within_its_limits(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (4, similar.WORDS)).astype(np.uint64)
    flips = np.packbits(rng.random((n, 320)) < 0.08, axis=1).view(np.uint64)
    words = np.ascontiguousarray(base[rng.integers(0, 4, n)] ^ flips)
    labels = rng.integers(0, max(2, n // 4), n)
    found = {tuple(sorted(p)) for i, j in similar.search(words, labels) for p in zip(i.tolist(), j.tolist(), strict=True)}
    apart = lambda x: sum(int(v).bit_count() for v in x)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if labels[i] != labels[j] and apart(words[i] ^ words[j]) <= similar.ALL_BITS and apart((words[i] ^ words[j])[:1]) <= similar.FIRST_BITS}
    assert found == want


def test_edges(spark, edge_docs, no_docs):
    twice = edge_docs.unionByName(edge_docs)
    kept = similar.keep_one(twice)
    texts = [r["text"] for r in kept.collect()]
    words = [tuple((t or "").encode().lower().split()) for t in texts]
    assert kept.columns == edge_docs.columns and len(set(words)) == len(words) and set(words) == {tuple((r["text"] or "").encode().lower().split()) for r in edge_docs.collect()}
    assert similar.keep_one(no_docs).collect() == []


def test_long_sets_in_pieces(monkeypatch):
    x = confirm.shingle_set(" ".join(f"w{i % 997}x{i % 31}" for i in range(40_000)), 5)
    whole = similar.fingerprint(x)
    monkeypatch.setattr(similar, "AT_ONCE", 100)
    assert similar.fingerprint(x) == whole and len(whole) == 8 * similar.WORDS


def test_no_step_leaves_its_shuffles_behind(spark):
    """The shuffle files of a step are gone soon after the next one, without a heap that fills."""
    counts = lambda n: spark.range(5000).withColumn("k", F.col("id") % n).groupBy("k").count().repartition(7, "k")
    before = _shuffle_files(spark)
    made = confirm.step(counts(700), "counts")
    first = _shuffle_files(spark) - before
    confirm.step(counts(600), "counts")
    until = time.monotonic() + 20
    while (left := first & _shuffle_files(spark)) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and made.count() == 700


def near_copies(n, words):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    return [" ".join(edited(rng, base, 1)) for _ in range(n)]


def test_no_step_holds_the_postings_of_all_masks(spark, monkeypatch):
    """Whatever the classes share, what one step shuffles is their postings in a slice of the masks."""
    counts = []
    proposed = confirm.proposed
    monkeypatch.setattr(confirm, "proposed", lambda cells, *a: counts.append(cells.count()) or proposed(cells, *a))
    kept = similar.keep_one(spark.createDataFrame(list(enumerate(near_copies(60, 150))), "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert max(counts) <= 60 * (similar.MASKS // 4 + 1)


def test_no_text_stays_on_disk_beside_its_fingerprint(spark):
    """What near-dedup has written when its rows are read is much less than the texts."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(400)) for _ in range(300)]
    before = _shared_bytes(spark)
    kept = similar.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 300
    assert _shared_bytes(spark) - before < sum(map(len, texts)) / 10


@pytest.mark.parametrize("max_list", [7, 20, 20_000])
def test_crowded_buckets_in_parts(spark, monkeypatch, max_list):
    """Buckets of near copies that are cut into parts give the groups of exact similarities."""
    monkeypatch.setattr(confirm, "MAX_LIST", max_list)
    monkeypatch.setattr(confirm, "SMALL", 3 if max_list == 7 else confirm.SMALL)
    monkeypatch.setattr(confirm, "WINDOW", 4 if max_list == 7 else confirm.WINDOW)
    texts = [*near_copies(50, 200), *(" ".join(f"u{i}x{j}" for j in range(50)) for i in range(30))]
    kept = similar.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    exact = components(len(texts), alike_pairs(plain_sets(texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(exact))


def test_postings_are_counted_in_cells_first(spark):
    posted = spark.createDataFrame([(i, b) for b, n in ((5, 3), (-9, confirm.MAX_LIST + 1), (77, 40)) for i in range(n)], "id long, bucket long")
    assert [tuple(r) for r in confirm.crowded(posted, 100).collect()] == [(-9, confirm.MAX_LIST + 1, 0)]


def _shared_bytes(spark):
    return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())


def _shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "shuffle_" in name}
