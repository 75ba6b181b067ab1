"""Resampling towards a target text: hashed word runs weigh each document, Gumbel noise draws the sample.

Features are runs of one to ``runs`` neighbouring words, each hashed by CRC-32 to
one of ``buckets``.  A bucket's gain is the log ratio of its share in the target
texts over its share in all documents; a document's weight is the floored mean
gain of its features.  With noise from a hash of doc_id added, the highest
scores are drawn without replacement, in proportion to the weights.

Words are found and hashed by a byte automaton over the UTF-8 buffer of an Arrow
column, without a Python string for any word: a table gives each byte's class,
words begin and end where classes differ (or a document ends), and table-driven
CRCs are advanced by one byte at all words at once, longest words first so that
those still running are a slice.  A run of two words goes on from the state after
the first one.

Plan at scale: one pass over the texts counts buckets (each task hands on one
number a bucket), one pass weighs them; neither shuffles a text.  Ranks come from
one range partitioning of narrow rows, sorted within partitions, and the counts
of the partitions before (one number a partition at the driver), so no task
holds all rows.

Nulls and edges: a null, blank or wordless text has no features and weight 0;
texts of any length count whole; a null doc_id hashes as the word null and comes
after all others of its score; of repeated rows each is drawn by itself, with equal
scores; ties go to the smaller doc_id; without target texts all gains come from
the smoothing; an empty table gives no rows.  Only doc_id and text are read, so
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import discard, materialise, text_of

BUCKETS = 10_000
RUNS = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that a task looks at together, but for one longer document.
AT_ONCE = 2 << 20
#: Words still running below which each is finished by itself.
FEW = 8

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z; and whether a byte, lower-cased, is part of a word: a digit, a letter, or of a character beyond ASCII.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
SPACE = np.uint32(0x20)


def _crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(polynomial), state >> 1)
    return state.astype(np.uint32)


CRC = _crc_table()


def step(state: np.ndarray, byte: np.ndarray | np.uint32) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, lower-cased, and where each row starts (and the end)."""
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[found], at - at[0]


def words(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of all words, in order; no word crosses a row's end."""
    inside, edge = IN_WORD[text], np.zeros(len(text) + 1, bool)
    edge[at] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before[: len(inside)] | edge[:-1]))
    ends = np.flatnonzero(inside & (~after[: len(inside)] | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(at, starts, "right") - 1


def advance(state: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each state after the bytes of its word, all words one byte at a time."""
    longest = int(lengths.max(initial=0))
    order = np.argsort(longest - lengths.astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
    s, at, size = state[order], starts[order], lengths[order]
    running = np.cumsum(np.bincount(size, minlength=longest + 1)[::-1])[::-1]  # words of at least so many bytes
    done = 0
    while done < longest and (n := int(running[done + 1])) > FEW:
        s[:n] = step(s[:n], text[at[:n] + done])
        done += 1
    for i in np.flatnonzero(size[: FEW + 1] > done) if done < longest else ():
        s[i] = zlib.crc32(text[at[i] + done : at[i] + size[i]].tobytes(), int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    made = np.empty_like(s)
    made[order] = s
    return made


def features(column: pa.Array, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and the bucket of each feature of a string column, and the words of each row."""
    text, at = buffer_of(column)
    starts, lengths, row = words(text, at)
    first = np.arange(len(starts))  # words at which a run starts; the state is that after the run so far
    state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), text, starts, lengths)
    rows, found = [row], [~state % np.uint32(buckets)]
    for more in range(1, runs):
        whole = first + more < len(starts)
        first, state = first[whole], state[whole]
        whole = row[first] == row[first + more]
        first, state = first[whole], state[whole]
        state = advance(step(state, SPACE), text, starts[first + more], lengths[first + more])
        rows.append(row[first])
        found.append(~state % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found), np.bincount(row, minlength=len(column))


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The column in slices of about AT_ONCE bytes."""
    at = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + AT_ONCE, "right")) - 1)
        yield begin, column.slice(begin, end - begin)
        begin = end


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: partial sums by task, one number a bucket at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                total += np.bincount(features(part, runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(text_of()).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets, np.int64)
    total[counted["bucket"].to_numpy(int)] = counted["n"].to_numpy()
    return total


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """1000 times the log of a bucket's share in the target over that in all, one added to each count, floored."""
    more = len(raw)
    t_all, s_all = float(target.sum() + more), float(raw.sum() + more)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in _parts(batch.column(1)):
                row, bucket, n_words = features(part, runs, len(gain))
                n = np.bincount(row, minlength=len(part))
                total = np.bincount(row, weights=gain[bucket], minlength=len(part)).astype(np.int64)  # whole numbers below 2^53: exact
                columns = [batch.column(0).slice(begin, len(part)), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """1000 times Gumbel noise from a hash of seed and doc_id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / float(1 << 32))))


def ranked(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """weighed (doc_id, n_words, score and others) plus rank: 1, 2, 3 ... for the drawn share of documents of enough words, else null."""
    small = F.col("n_words") < min_words
    keys = [small, F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.col("n_features"), F.col("row")]
    numbered = weighed.withColumn("row", F.monotonically_increasing_id())
    dealt = materialise(numbered, "weighed-rows")  # the range bounds are sampled from it
    places = materialise(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").withColumn("place", F.monotonically_increasing_id()), "ranked-rows")
    discard(dealt)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, total, offsets = 0, 0, []
    for r in places.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count(F.when(~small, 1)).alias("enough")).orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before))
        before, total = before + r["n"], total + r["enough"]
    begins = places.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + within + 1
    return places.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; target: the texts to sample towards."""
    gain = gains(bucket_counts(target, runs, buckets), bucket_counts(docs, runs, buckets))
    scored = weigh(docs, gain, runs).withColumn("score", F.col("weight") + noise(seed))
    return ranked(scored, percent, min_words)


ORACLE_SQL = """
with crc as (select list_transform(range(0, 256), lambda c: list_reduce(list_prepend(c, range(0, 8)), lambda a, k: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as crc),
texts as (select 0 as side, row_number() over () as row, doc_id, text from documents union all select 1, row_number() over (), null, text from benchmark),
split as (select side, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
runs as (select side, row, unnest(w) as feature from split
         union all select side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from split),
counted as (select side, row, feature, count(*) as n from runs group by all),
coded as (select feature, hex(encode(feature)) as h from (select distinct feature from counted)),
hashed as (select feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                  lambda s, y: xor(crc[(xor(s, y) & 255) + 1], s >> 8))) % 10000 as bucket from coded, crc),
by_bucket as (select bucket, sum(case when side = 1 then n else 0 end)::double as t, sum(case when side = 0 then n else 0 end)::double as s from counted join hashed using (feature) group by bucket),
gain as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from by_bucket) + 10000) / ((s + 1) * ((select sum(t) from by_bucket) + 10000))))::bigint as gain from by_bucket),
of_row as (select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as total from counted join hashed using (feature) join gain using (bucket) where side = 0 group by row),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(total::double / n_features), 0)::bigint as weight,
                  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
           from texts join split using (side, row) left join of_row using (row) where side = 0),
placed as (select *, weight + noise as score, row_number() over (order by n_words < 20, weight + noise desc, doc_id nulls last) as place, count(*) filter (where n_words >= 20) over () as enough from scored)
select doc_id, n_features, weight, score, case when place <= 25 * enough // 100 then place end as rank from placed
"""
