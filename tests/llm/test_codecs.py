"""Encoding against the libraries on whole texts, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import piece_codec, queries, sstable
from larkspur.llm.shared import materialise

PIECES = public_tokenizers.path(piece_codec.MODEL)
BYTES = public_tokenizers.path(sstable.VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MERGES = tokenizers.Tokenizer.from_file(BYTES)

odd_texts = st.text(alphabet=st.sampled_from(list("ab .,!'\n\t▁ 　é1s\U0001f600\x00")), max_size=40)


def test_chunks_are_found_in_this_model():
    assert piece_codec.codec(PIECES).by_chunk


@settings(max_examples=300, deadline=None)
@given(st.one_of(odd_texts, st.text(max_size=30)))
def test_pieces_equal_the_library(text):
    ids = np.frombuffer(piece_codec.codec(PIECES).encode([text])[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert piece_codec.codec(PIECES).decode([np.array(ids, "<u4").tobytes()]) == [LIBRARY.decode(ids)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(odd_texts, st.text(max_size=30)))
def test_byte_pieces_equal_the_library(text):
    table = sstable.encoder(BYTES)
    assert np.frombuffer(table.ids([text])[0], table.dtype).tolist() == MERGES.encode(text, add_special_tokens=False).ids


def test_a_full_table_is_emptied():
    from larkspur.llm.chunks import ChunkTable, packed

    table = ChunkTable(str.split, lambda words: [packed([len(w)], "H") for w in words], limit=300)
    texts = ["a bb ccc", "a dddd", "bb a eeeee"]
    assert [np.frombuffer(x, "<u2").tolist() for t in texts for x in table.ids([t])] == [[1, 2, 3], [1, 4], [2, 1, 5]]
    assert set(table.table) == {"bb", "a", "eeeee"} or len(table.table) < 5


def test_round_trip_of_edges(edge_docs, edge_rows, no_docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), r["decoded"]) for r in piece_codec.round_trip(edge_docs, PIECES).collect())
    want = sorted((i is None, i or 0, np.array(ids := LIBRARY.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), LIBRARY.decode(ids)) for i, t, *_ in edge_rows)
    assert got == want
    assert piece_codec.round_trip(no_docs, PIECES).collect() == []


def test_op1_digests(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_shards_hold_everything_in_order(spark, edge_docs, edge_rows, no_docs):
    clash = edge_docs.withColumn("shard", edge_docs["lang"]).withColumn("ids", edge_docs["lang"]).withColumn("by", edge_docs["lang"])
    kept = sorted(sstable.write_and_read(clash, BYTES).collect(), key=lambda r: r["start"])
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t, *_) in zip(kept, order, strict=True):
        ids = [*MERGES.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    assert sstable.write_and_read(no_docs, BYTES).collect() == []


def test_ids_with_a_third_of_all_rows_are_dealt_over_shards(spark, tmp_path):
    """Null and repeated ids fill several shards; order and starts hold over all of them."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = sstable.write(docs, BYTES, f"file://{tmp_path}/shards", shards=12)
    assert sum(s["entries"] for s in shards) == 900 and max(s["entries"] for s in shards) < 200
    kept = sorted(sstable.read(spark, shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in kept] == sorted(i or -1 for i, _ in rows)
    assert [r["start"] for r in kept[1:]] == np.cumsum([len(r["ids"]) // 4 for r in kept])[:-1].tolist()
    coded = sorted((i or -1, tuple([*MERGES.encode(t, add_special_tokens=False).ids, 0])) for i, t in rows)
    assert sorted((r["doc_id"] or -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in kept) == coded


def test_texts_of_megabytes(spark):
    texts = ["word and " * 120_000, "x" * 300_000, "é" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in piece_codec.round_trip(docs, PIECES).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
    for r in sstable.write_and_read(docs, BYTES).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*MERGES.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]


def test_lookup_by_key(spark, tmp_path):
    rows = [(i * 3 - 300, f"text {i} " * (i % 50)) for i in range(2000)] + [(0, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = sstable.write(docs, BYTES, f"file://{tmp_path}/shards")
    assert sum(s["entries"] for s in shards) == len(rows)
    readers = [sstable.ShardReader(s["path"]) for s in shards]
    assert any(len(r.index) > 1 for r in readers)

    def found(key):
        return sorted(x.tolist() for r in readers for x in r.lookup(key))

    for key in (-300, 0, 3, 5697, None):
        assert found(key) == sorted([*MERGES.encode(t, add_special_tokens=False).ids, 0] for i, t in rows if i == key)
    assert found(1) == [] and found(10**12) == []
    keys = [k for r in readers for k, _ in r]
    assert keys == sorted(keys)


def test_op10_digests(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    for r in sorted(materialise(queries.QUERIES["op10_sstable"](spark, sf_dir), "out").collect(), key=lambda r: r["doc_id"]):
        ids = [*MERGES.encode(docs.pop(r["doc_id"]), add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not docs
