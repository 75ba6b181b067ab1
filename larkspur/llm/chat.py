"""Chat formatting by prefix-target expansion.

A turn is written ``### role: text </turn>`` and a line feed.  In texts and
roles a backslash goes before each ``\\``, ``#``, ``<`` (and ``:`` in roles), so
a control string never appears inside one and the text comes back exactly.
Every assistant turn becomes an example of its own: all turns before it as
context, and only its reply under the loss mask.  Turns after the last reply
make a last example with an empty mask, so that nothing is lost.

Every example is a prefix of its conversation's text, so ``examples`` gives that
text once, a row a turn, and in the row of an example's last turn where the
example ends and which part of it is under the mask, in code points from the
start of the conversation.  ``expanded`` deals each turn to all examples that
hold it: the examples in full, context and target, a row a turn.  That is as much as all
contexts together, which the method asks for, in one form for every length;
``expand`` has each example as one text.  ``digest_expanded`` reads the examples in full,
``digest`` the conversations by their ranges alone.

Rows are numbered by windows and read back in order, batch by batch, with
running hashes: a task holds one batch, and sorts that spill, however long a
conversation is.

Nulls and edges: a null text or role is empty, texts may be of any length; rows
of a null conv_id are one conversation; a null turn comes first, ties of turn go
by role, then text, and repeated rows are turns of their own; an empty table
gives no rows.  Only conv_id, turn, role and text are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = " </turn>\n"
TARGET = "assistant"
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column, special: str = r"([\\#<])") -> Column:
    return F.regexp_replace(text, special, r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), written, start; example (from 0), stop, loss_start, loss_len, null in rows that end no example; first, last: the examples that hold the row."""
    by_conv = Window.partitionBy("conv_id")
    in_order = by_conv.orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    body = escape(F.col("text"))
    turns = turns.withColumns({"is_reply": F.col("role") == TARGET, "body_len": F.length(body).cast("long"), "written": F.concat(F.lit("### "), escape(F.col("role"), r"([\\#<:])"), F.lit(": "), body, F.lit(END))})
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumns(
        {"at": F.row_number().over(in_order), "stop": F.sum(F.length("written").cast("long")).over(so_far), "replies": F.sum(F.col("is_reply").cast("int")).over(so_far), "is_last": F.lead("is_reply").over(in_order).isNull()}
    )
    ends = F.col("is_reply") | F.col("is_last")
    loss_len = F.when(F.col("is_reply"), F.col("body_len")).otherwise(0)
    loss_start = F.when(F.col("is_reply"), F.col("stop") - len(END) - F.col("body_len")).otherwise(0)
    example = F.col("replies") - F.col("is_reply").cast("int")
    return placed.select(
        "conv_id", "at", "written", (F.col("stop") - F.length("written")).alias("start"),
        *(F.when(ends, c).alias(n) for n, c in (("example", example), ("stop", F.col("stop")), ("loss_start", loss_start), ("loss_len", loss_len))),
        example.alias("first"), F.max(example).over(by_conv).alias("last"),
    )


def expanded(written: DataFrame) -> DataFrame:
    """conv_id, example, at, written, start, loss_start, loss_len: every example in full, a row a turn: all turns before its target, then the target, whose row alone has a mask.

    Each turn is dealt to the examples that hold it, so no task holds a conversation or an example.
    """
    dealt = written.withColumn("of", F.explode(F.sequence("first", "last")))
    target = F.col("example") == F.col("of")
    return dealt.select("conv_id", F.col("of").cast("long").alias("example"), "at", "written", "start", *(F.when(target, F.col(c)).alias(c) for c in ("loss_start", "loss_len")))


def expand(written: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_len: each example in full; as long as all contexts together."""
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = written.withColumn("formatted", F.array_join(F.collect_list("written").over(so_far), ""))
    return whole.where("example is not null").select("conv_id", "example", "formatted", "loss_start", "loss_len")


def in_order(written: DataFrame) -> DataFrame:
    return written.select("conv_id", "at", "written", "start", "stop", "loss_start", "loss_len").repartition("conv_id").sortWithinPartitions("conv_id", "at")


class Reading:
    """What is known of one conversation, of whose text more and more is read."""

    def __init__(self, conv_id: object):
        self.conv_id, self.rest = conv_id, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def read(self, rows: list[tuple]) -> Iterator[tuple[str, str]]:
        """The turns (role, text) that the text of these rows (written, start, stop, loss_start, loss_len) completes."""
        *whole, self.rest = (self.rest + "".join(r[0] for r in rows)).split(END)
        for piece in whole:
            role, text = (unescape(x) for x in _TURN.fullmatch(piece).groups())
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            yield role, text
        for piece, start, stop, loss_start, loss_len in rows:
            if stop is not None:
                self.formatted_chars += stop
                if loss_len:
                    reply = unescape(piece[loss_start - start : loss_start - start + loss_len])
                    self.loss.update(reply.encode())
                    self.loss_chars += len(reply)


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Reading, list[tuple[str, str]], bool]]:
    """For each stretch of a conversation's rows: what is known so far, the turns read, and whether the conversation is at its end."""
    reading = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
        start = 0
        for row in range(1, batch.num_rows + 1):
            if row == batch.num_rows or columns[0][row] != columns[0][start]:
                if reading is None or reading.conv_id != columns[0][start]:
                    if reading is not None:
                        yield reading, [], True
                    reading = Reading(columns[0][start])
                yield reading, list(reading.read(list(zip(*(c[start:row] for c in columns[1:]), strict=True)))), False
                start = row
    if reading is not None:
        yield reading, [], True


def read_back(written: DataFrame) -> DataFrame:
    """conv_id, at (from 1), role, text: the turns, from the written text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reading, turns, _ in _readings(batches):
            first = reading.n_turns - len(turns) + 1
            ids, at = pa.array([reading.conv_id] * len(turns), pa.int64()), pa.array(range(first, first + len(turns)), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, at, pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())], names=["conv_id", "at", "role", "text"])

    return in_order(written.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, "conv_id long, at long, role string, text string")


def digest(written: DataFrame) -> DataFrame:
    """One row of lengths and hashes for each conversation that is read back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def made(done: list[tuple]) -> pa.RecordBatch:
        ids, *others = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, others)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for r, _, ended in _readings(batches):
            if ended:
                done.append((r.conv_id, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars))
            if len(done) == 4096:
                yield made(done)
                done = []
        if done:
            yield made(done)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_order(written.withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, schema)


def read_examples(full: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, turns_sha256, loss (text under the mask), formatted_chars: each example of ``expanded``, read from its own text."""
    names = ["conv_id", "example", "n_turns", "turns_sha256", "loss", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reading, loss = None, None, ""
        for batch in batches:
            done: list[tuple] = []
            for conv_id, example, piece, start, loss_start, loss_len in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if reading is None or key != (conv_id, example):
                    if reading is not None:
                        done.append((*key, reading.n_turns, reading.turns.hexdigest(), loss, reading.formatted_chars))
                    key, reading, loss = (conv_id, example), Reading(conv_id), ""
                for _ in reading.read([(piece, start, None, None, None)]):
                    pass
                if loss_len:
                    loss = unescape(piece[loss_start - start : loss_start - start + loss_len])
                reading.formatted_chars += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays(list(map(_column, zip(*done, strict=True))), names=names)
        if reading is not None:
            yield pa.RecordBatch.from_arrays([_column([x]) for x in (*key, reading.n_turns, reading.turns.hexdigest(), loss, reading.formatted_chars)], names=names)

    rows = full.select(F.col("conv_id").cast("long"), "example", "written", "start", "loss_start", "loss_len", "at")
    ordered = rows.repartition("conv_id", "example").sortWithinPartitions("conv_id", "example", "at").drop("at")
    return ordered.mapInArrow(run, "conv_id long, example long, n_turns long, turns_sha256 string, loss string, formatted_chars long")


def _column(values: tuple | list) -> pa.Array:
    return pa.array(values, pa.string() if any(isinstance(x, str) for x in values) else pa.int64())


def digest_expanded(full: DataFrame) -> DataFrame:
    """The columns of ``digest``, from the examples in full: replies in their order, the turns from the last example, which holds them all."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list | None = None
        for batch in batches:
            done: list[tuple] = []
            for conv_id, n_turns, turns, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if known is None or known[0] != conv_id:
                    if known is not None:
                        done.append((*known[:4], known[4].hexdigest(), known[5]))
                    known = [conv_id, 0, "", 0, hashlib.sha256(), 0]
                known[1:4] = n_turns, turns, known[3] + len(loss)
                known[4].update(loss.encode())
                known[5] += chars
            if done:
                yield pa.RecordBatch.from_arrays(list(map(_column, zip(*done, strict=True))), names=names)
        if known is not None:
            yield pa.RecordBatch.from_arrays([_column([x]) for x in (*known[:4], known[4].hexdigest(), known[5])], names=names)

    ordered = read_examples(full).repartition("conv_id").sortWithinPartitions("conv_id", "example").drop("example")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
