"""SentencePiece encoding and decoding through a distinct-chunk table.

The library marks each space with U+2581 and puts one mark before the text.  If
no piece of the model has a mark after another character, merges never cross
from one marked word to the next, so each distinct marked word (its run of
marks with it) is segmented once and ids are joined back by position.  A model
with other pieces, or one that rewrites characters, is applied to whole texts.

Nulls and edges: a null text is an empty one (begin and end id only; decoded
empty); ids, texts and lengths are of whole texts, of any length; null or
repeated doc_ids are kept as they are; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from larkspur.llm.chunks import ChunkTable, packed
from larkspur.llm.shared import map_texts

MARK = "▁"
MODEL = "piece_bpe_32k.model"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Strings that a model which rewrites characters would not give back.
_PROBES = ("ﬁ ① Ａ", "a  b ", " a", "é", "　x")
_loaded: dict[str, Codec] = {}


class Codec:
    """Encodes and decodes texts; made once in each Python worker."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        rewrites = any(self.model.decode(self.model.encode(x)) != x for x in _PROBES)
        self.by_chunk = MARK in pieces and not rewrites and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.table = ChunkTable(self._split, self._segment)

    @staticmethod
    def _split(text: str) -> list[str]:
        """The marked words, each without its first mark."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if MARK * 2 in marked or marked[0] == MARK:
            return [x[1:] for x in _MARKED.findall(MARK + marked)]
        return marked.split(MARK)

    def _segment(self, words: list[str]) -> list[bytes]:
        found = self.model.encode(words, num_threads=1) if words else []
        alone = [self.model.piece_to_id(MARK)]
        return [packed(ids if w else alone) for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Begin id, ids and end id of each text as little-endian unsigned 32-bit integers."""
        if self.by_chunk:
            found = self.table.ids(texts)
        else:
            found = [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]
        return [self.begin + x + self.end for x in found]

    def decode(self, coded: list[bytes]) -> list[str]:
        return [self.model.decode(np.frombuffer(x, "<u4").tolist()) for x in coded]


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def round_trip(docs: DataFrame, model_path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys, ids (binary: little-endian unsigned 32-bit integers), decoded (the text that the ids give back)."""

    def rows(_: list, texts: list[str]) -> dict:
        coder = codec(model_path)
        ids = coder.encode(texts)
        return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(coder.decode(ids), pa.string())}

    return map_texts(docs, "ids binary, decoded string", rows, keys)
