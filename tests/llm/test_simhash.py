"""SimHash against hashes of another library's making and brute-force links."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import queries, simhash
from larkspur.llm.components import connected


def brute_fingerprint(spark_hash, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [spark_hash[s] for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(fps):
    """Smallest member of each component of fingerprints within 3 bits, over all pairs."""
    items = list(fps)
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def test_fingerprints_are_sparks_xxhash64(spark, edge_docs, edge_rows):
    shingles = set()
    for _, t, *_ in edge_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles |= {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {" ".join(words)}
    rows = spark.createDataFrame([(s,) for s in shingles], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    hashed = {r["s"]: r["h"] % (1 << 64) for r in rows}
    got = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in simhash.codes(edge_docs).collect())
    assert got == sorted((i or -1 if i is not None else -1, brute_fingerprint(hashed, t)) for i, t, *_ in edge_rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 12))
def test_bucket_links_join_what_all_pairs_join(seed, n, centres):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(centres)]
    fps = set()
    for _ in range(n):
        x = rng.choice(seeds)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    want = groups(fps)
    place = {x: i for i, x in enumerate(fps)}
    found, _ = simhash.bucket_links(np.array(fps, np.uint64))
    links = [(fps[a], fps[b]) for a, b in found]
    parent = {x: x for x in fps} | dict(links)
    assert len({m for m, _ in links}) == len(links)
    named = [place[parent[x]] for x in fps]
    same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == k) for k in g}
    assert same(named) == same(want)


def packed(fps):
    return [(x.to_bytes(8, "big"), x - (1 << 64) if x >> 63 else x) for x in fps]


@pytest.mark.parametrize(("many", "max_bucket", "bucket"), [(False, 20_000, 1024), (True, 20_000, 4), (False, 5, 16), (True, 5, 1024)])
def test_all_ways_of_dealing_find_all_groups(spark, many, max_bucket, bucket):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):  # one dense group, and chains away from it
        x = centre
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(20)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(150)}
    fps = sorted(fps)
    classes = spark.createDataFrame(packed(fps), "code binary, fp long")
    rule = simhash.Rule(max_bucket=max_bucket, bucket=bucket)
    roots = {bytes(r["node"]): bytes(r["root"]) for r in connected(simhash.links(classes, rule, many)).collect()}
    named = [roots.get(c, c) for c, _ in packed(fps)]
    same = lambda g: {frozenset(i for i in range(len(g)) if g[i] == k) for k in g}
    assert same(named) == same(groups(fps))


@pytest.mark.parametrize(("sure", "blocks", "width"), [(3, 1, 64), (3, 1, 5), (3, 2, 9), (6, 2, 10), (3, 1, 0)])
def test_masks_part_no_pair(sure, blocks, width):
    rng = random.Random(sure * 100 + width)
    masks = simhash.block_masks(sure, blocks, width)
    assert all(m.bit_count() <= width for m in masks)
    for _ in range(300):
        change = sum({1 << rng.randrange(64) for _ in range(sure)})
        assert any(change & m == 0 for m in masks)


def test_the_query_goes_through_the_index(spark):
    """near_duplicates visits nodes of Gray-order indexes, leaves whole groups out, and finds what all pairs give."""
    visits = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.near_duplicates(docs, visits=visits).orderBy("doc_id").collect()
    n = len({r["fingerprint"] for r in rows})
    assert 0 < visits[0].value < n * n / 2 and visits[1].value > n
    want = groups([int(r["fingerprint"], 16) for r in rows])
    assert [r["component_id"] for r in rows] == [rows[i]["doc_id"] for i in want]


def test_hot_classes(spark):
    """A third of all rows is one text, more are blank; ids may repeat."""
    rows = [(i % 50, "the same words over and over again here") for i in range(400)] + [(i, "") for i in range(300)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(300)]
    rows = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(rows) == 1000 and len({r["component_id"] for r in rows}) <= 302


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300), (401, 400), (400, 402)]
    rng.shuffle(edges)
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = lambda x: roots.get(x, x)
    assert len({name(i) for i in range(41)}) == 1 and len({name(i) for i in range(100, 160)}) == 1 and len({name(i) for i in (400, 401, 402)}) == 1
    assert len({name(0), name(100), name(400)}) == 3


def test_op2_equals_brute_force(spark, sf_dir):
    rows = queries.QUERIES["op2_simhash"](spark, sf_dir).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    fps = [simhash.fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]
    want = groups(fps)
    assert [r["component_id"] for r in rows] == [rows[i]["doc_id"] for i in want]
    assert len(set(want)) < len(rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    blank = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert blank == {0}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_texts_of_megabytes(monkeypatch):
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(200_000))
    whole = simhash.code(long)
    monkeypatch.setattr(simhash, "HASHES", 1000)
    assert simhash.code(long) == whole
    assert simhash.fingerprint("x" * 2_000_000) == simhash.fingerprint("X" * 2_000_000) != 0
