"""Token ids in sorted-string-table shards.

Documents are encoded where they are read; only their ids are shuffled, to
shards by ranges of doc_id (bounds are quantiles of doc_id alone), and sorted;
each partition becomes one shard, so shard after shard lists ascending ids.  A
doc_id that fills several ranges, or none at all (null), is dealt over as many
shards by a hash of its ids.  A shard file is

    block*  index  bloom  footer

block: entries in key order; an entry is (bytes shared with the previous key,
    rest of the key, number of ids) as varints and bytes, then the ids; every
    RESTART-th key is stored whole.  A block ends at about BLOCK_BYTES.
index: first key, offset and length of each block (sparse: one entry a block).
bloom: a Bloom filter of the keys, BLOOM_BITS a key, BLOOM_HASHES probes.
footer: fixed size, at the end: offsets, counts, width of an id, magic.

A key is one byte for "not null" and the doc_id as 8 big-endian bytes with the
sign bit flipped, so byte order is numeric order and null comes first.  To
look a document up: footer, Bloom filter, binary search in the index, one
block (``lookup``).  Shards are written under a name of the attempt and moved
into place when complete, so a lost or repeated task leaves no half shard.

Nulls and edges: a null text is an empty one (its end id only); a text of any
length is encoded whole and is one entry; repeated doc_ids are separate entries,
in an order fixed by a hash of their ids; a null doc_id comes first; an empty
table gives no rows.  Only doc_id and text are read, whatever other columns
there are.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tokenizers
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.chunks import ChunkTable, Table, packed
from larkspur.llm.shared import ROWS_AT_ONCE, shared_path, text_of

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"LKSST001"
#: offset and length of index and bloom, entries, ids, bytes of an id, magic.
FOOTER = struct.Struct("<QQQQQQI8s")
_INDEX = struct.Struct("<9sQQ")
#: White space after a character that isn't white space starts a new chunk.
_AT_SPACE = re.compile(r"(?<=\S)(?=\s)")
_TWO_SPACES = re.compile(r"\s\s")
#: First characters of keys of chunks that don't begin with one space; no text from Arrow holds them.
_AS_IS, _LINE = "\ud800", "\ud801"
_STARTS = {_AS_IS: "", _LINE: "\n"}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters that byte-level vocabularies write for the bytes 0 to 255.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b)) for b in range(256)}
_loaded: dict[str, Vocabulary] = {}


def _split(text: str) -> list[str]:
    """Chunks that begin where white space does, where byte-level pieces never cross; keys leave a first space out."""
    if not text:
        return []
    if _TWO_SPACES.search(text):
        return [c[1:] if c[0] == " " else _AS_IS + c for c in _AT_SPACE.split(text)]
    keys = text.replace("\n", " " + _LINE).split(" ")
    if not keys[0]:
        del keys[0]
    else:
        keys[0] = _AS_IS + keys[0]
    return keys


class Vocabulary:
    """A byte-level vocabulary of the tokenizers library with its chunk table; special strings in texts are what the library makes of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.model = self.whole.model
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.kind = "H" if self.width == 2 else "I"
        self.table = ChunkTable(_split, self._segment)
        self.words = Table()
        self.ids = self.table.ids

    def _word(self, start: str, word: str) -> bytes:
        """The ids of a word of Latin letters, and of the white space before it: one unit to the library's splitter, or two."""
        key = start + word
        found = self.words.get(key)
        if found is None:
            written = word if start else " " + word
            written = written.replace(" ", "Ġ") if word.isascii() else written.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = packed([t.id for t in self.model.tokenize(written)], self.kind)
            found = self.words.add(key, self._whole("\n") + found if start == _LINE else found)
        return found

    def _whole(self, text: str) -> bytes:
        key = " " + text
        found = self.words.get(key)
        if found is None:
            found = self.words.add(key, packed(self.whole.encode(text, add_special_tokens=False).ids, self.kind))
        return found

    def _segment(self, keys: list[str]) -> list[bytes]:
        """Words, with or without ASCII marks after them, by the model; the rest by the whole tokenizer."""
        self.words.trim()
        made: list[bytes | None] = []
        others: list[int] = []
        for i, key in enumerate(keys):
            start = key[0] if key and key[0] in _STARTS else ""
            word = key[len(start) :].rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                marks = key[len(start) + len(word) :]
                made.append(self._word(start, word) + self._whole(marks) if marks else self._word(start, word))
            else:
                made.append(None)
                others.append(i)
        texts = [_STARTS[keys[i][0]] + keys[i][1:] if keys[i] and keys[i][0] in _STARTS else " " + keys[i] for i in others]
        for i, x in zip(others, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            made[i] = packed(x.ids, self.kind)
        return made


def encoder(path: str) -> Vocabulary:
    """The vocabulary, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, which must come in key order, to an open file."""

    def __init__(self, out: pa.NativeFile, width: int):
        self.out, self.width = out, width
        self.block, self.in_block, self.last = bytearray(), 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.first, self.at, self.entries, self.n_ids = b"", 0, 0, 0
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        if not self.in_block:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(ids) // self.width) + ids
        self.last, self.in_block = key, self.in_block + 1
        self.entries, self.n_ids = self.entries + 1, self.n_ids + len(ids) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            self.index.append((self.first, self.at, len(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.in_block = bytearray(), 0

    def finish(self) -> None:
        self.flush()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        bloom = np.packbits(bloom).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.n_ids, self.width, MAGIC))


def _entries(block: bytes, width: int) -> Iterator[tuple[bytes, bytes]]:
    at, last = 0, b""
    while at < len(block):
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        last, at = last[:shared] + block[at : at + rest], at + rest
        n, at = _read_varint(block, at)
        yield last, block[at : at + n * width]
        at += n * width


class ShardReader:
    """Reads one shard: all entries in order, or those of one key."""

    def __init__(self, path: str):
        fs, place = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.entries, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a shard")
        self.index = list(_INDEX.iter_unpack(self._read(self.index_at, self.index_len)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from _entries(self._read(at, n), self.width)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that doc_id."""
        key, bits = key_of(doc_id), np.frombuffer(self._read(self.bloom_at, self.bloom_len), np.uint8)
        if not all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, 8 * self.bloom_len)):
            return []
        firsts = [x[0] for x in self.index]
        at = bisect_right(firsts, key) - 1
        while at > 0 and firsts[at] == key:
            at -= 1
        found = []
        for first, start, n in self.index[max(0, at) :]:
            if first > key:
                break
            found += [np.frombuffer(ids, f"<u{self.width}") for k, ids in _entries(self._read(start, n), self.width) if k == key]
        return found


def bounds_of(docs: DataFrame, shards: int) -> tuple[int, list[int]]:
    """How many first shards are for null ids, and the upper bounds of the other shards but the last, which may repeat."""
    total, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    nulls = min(shards - 1, -(-shards * (total - known) // max(total, 1)))
    rest = shards - nulls
    found = docs.approxQuantile("doc_id", [i / rest for i in range(1, rest)], 1 / (20 * rest)) if known and rest > 1 else []
    return nulls, [int(x) for x in found]


def shard_of(ids: np.ma.MaskedArray, share: np.ndarray, nulls: int, bounds: list[int]) -> np.ndarray:
    """The shard of each doc_id; share (0 to 1) deals an id over all shards that its bounds leave open."""
    known = ids.filled(0)
    low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
    dealt = nulls + low + ((high - low + 1) * share).astype(np.int64)
    return np.where(ids.mask, (max(nulls, 1) * share).astype(np.int64), dealt).astype(np.int32)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> list[dict]:
    """Encode, append the end id and write shards (spark.sql.shuffle.partitions, if not given) into ``folder`` (a URI); returns path, entries and n_ids of each, in order.

    What comes back to the driver is one small row a shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nulls, bounds = bounds_of(rows, shards)
    width = encoder(vocabulary).width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(vocabulary)
        end = np.array([end_id], table.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                coded = [ids + end for ids in table.ids(part.column(1).to_pylist())]
                by = np.fromiter((xxhash.xxh64_intdigest(x) >> 12 for x in coded), np.int64, len(coded))
                keys = np.ma.masked_array(part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, by / (1 << 52), nulls, bounds)), part.column(0), pa.array(by), pa.array(coded, pa.binary())], names=["shard", "doc_id", "by", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, out, shard = None, None, None
        fs, place = pafs.FileSystem.from_uri(folder)
        name = f"{place}/attempt-{uuid.uuid4().hex}"
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                if writer is None:
                    fs.create_dir(place)
                    shard, out = part.column(0)[0].as_py(), fs.open_output_stream(name)
                    writer = ShardWriter(out, width)
                for doc_id, ids in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    writer.add(key_of(doc_id), ids)
        if writer is not None:
            writer.finish()
            out.close()
            path = f"shard-{shard:06d}-{name[-32:]}.sst"
            fs.move(name, f"{place}/{path}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{path}"], "entries": pa.array([writer.entries], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    coded = rows.mapInArrow(encode, "shard int, doc_id long, by long, ids binary")
    in_order = coded.repartitionById(shards, "shard").sortWithinPartitions("doc_id", "by", "ids").select("shard", "doc_id", "ids")
    return sorted((r.asDict() for r in in_order.mapInArrow(run, "shard int, path string, entries long, n_ids long").collect()), key=lambda r: r["shard"])


def read(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit integers), from the files."""
    rows, start = [], 0
    for s in shards:
        rows.append((s["path"], start))
        start += s["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardReader(path)
                got: list[tuple[int | None, int, bytes]] = []
                for key, ids in shard:
                    ids = np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes()
                    got.append((id_of(key), before, ids))
                    before += len(ids) // 4
                    if len(got) == ROWS_AT_ONCE:
                        yield _batch(got)
                        got = []
                if got:
                    yield _batch(got)

    def _batch(got: list) -> pa.RecordBatch:
        ids, starts, coded = zip(*got, strict=True)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "ids": pa.array(coded, pa.binary())})

    listed = spark.createDataFrame(rows, "path string, before long")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, ids binary")


def write_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The shards of ``docs`` in the shared folder, read back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "shards")
    return read(spark, write(docs, vocabulary, folder if "://" in folder else f"file://{folder.removeprefix('file:')}"))
