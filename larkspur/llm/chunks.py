"""Distinct-chunk tables: each distinct piece of text is segmented once, ids are joined back by position.

A tokenizer whose pieces never cross a space gives a text the same ids as its
chunks one after another.  About one chunk in eight of a partition is distinct,
so a task keeps a table of the chunks that it has met, asks the tokenizer's
library only for new ones (all new ones of a batch in one call), and puts the
ids of a text together from the table.  The table lives with the Python
worker, is emptied when it holds ``LIMIT`` bytes, or when all tables of the worker
together do and another task is at work, and needs no shuffle: a
table of the whole corpus would have to shuffle each partition's distinct
chunks and each text's positions to save at most half of the segmentation.
"""

from __future__ import annotations

import weakref
from array import array
from collections.abc import Callable

from pyspark import TaskContext

#: Bytes of a worker's tables, of keys and ids with what Python needs for each entry.
LIMIT = 96 << 20
ENTRY = 180


def packed(ids: list[int], kind: str = "I") -> bytes:
    """The ids as integers of that array type, little-endian as all machines that Spark runs on."""
    return array(kind, ids).tobytes()


_tables: weakref.WeakValueDictionary[int, Table] = weakref.WeakValueDictionary()


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


class Table(dict):
    """Bytes by string, and about how much memory they take.

    A worker serves one stage after another, so tables that earlier tasks have left
    make room for the one in use.
    """

    size = 0
    task: int | None = None

    def __init__(self) -> None:
        super().__init__()
        _tables[id(self)] = self

    def add(self, key: str, value: bytes) -> bytes:
        self[key] = value
        self.size += len(key) + len(value) + ENTRY
        return value

    def empty(self) -> None:
        self.clear()
        self.size = 0

    def trim(self, limit: int = LIMIT) -> None:
        """Start anew if the limit is passed; if all tables pass it, those that this task hasn't used go."""
        self.task = _task()
        held = list(_tables.values())
        if sum(t.size for t in held) > limit:
            for other in held:
                if other.task != self.task:
                    other.empty()
        if self.size > limit:
            self.empty()


class ChunkTable:
    """ids(texts): the packed ids of each text.

    split(text) gives the keys of a text's chunks, segment(keys) the packed ids
    of each new one.  Packed, since the many small lists of a table would each
    be looked at again and again by the garbage collector.
    """

    def __init__(self, split: Callable[[str], list[str]], segment: Callable[[list[str]], list[bytes]], limit: int = LIMIT):
        self.split, self.segment, self.limit = split, segment, limit
        self.table = Table()

    def ids(self, texts: list[str]) -> list[bytes]:
        chunks = [self.split(t) for t in texts]
        self.table.trim(self.limit)
        seen: set[str] = set()
        for c in chunks:
            seen.update(c)
        new = [key for key in seen if key not in self.table]  # set.difference would walk a dict's subclass as a whole
        for key, found in zip(new, self.segment(new), strict=True):
            self.table.add(key, found)
        find = self.table.__getitem__
        return [b"".join(map(find, c)) for c in chunks]
