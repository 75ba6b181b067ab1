"""Helpers of the training-data operators."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import chunks, shared


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=30), st.lists(st.integers(1, 7), min_size=1, max_size=30))
def test_runs_are_whole(rows, sizes):
    rows = sorted(rows)
    batches, at = [], 0
    for n in sizes:
        part = rows[at : at + n]
        batches.append(pa.RecordBatch.from_arrays([pa.array([a for a, _ in part], pa.int64()), pa.array([b for _, b in part], pa.int64())], names=["a", "b"]))
        at += n
    rows = rows[:at]
    found = list(shared.runs(batches, 2))
    assert [tuple(r.values()) for t in found for r in t.to_pylist()] == rows
    last = [tuple(t.slice(t.num_rows - 1).to_pylist()[0].values()) for t in found]
    first = [tuple(t.slice(0, 1).to_pylist()[0].values()) for t in found]
    assert all(a != b for a, b in zip(last, first[1:], strict=False))


def test_starts():
    assert shared.starts_of(np.array([1, 1, 2]), np.array([1, 2, 2])).tolist() == [0, 1, 2, 3]
    assert shared.starts_of(np.zeros(0)).tolist() == [0]


def test_hash_sample_is_the_same_however_the_rows_lie(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    picked = [sorted(r[0] for r in shared.hash_sample(df.repartition(p), 300, seed=4).collect()) for p in (1, 7)]
    assert picked[0] == picked[1] and len(picked[0]) == 300
    assert shared.hash_sample(df, 9000).count() == 5000 and shared.hash_sample(df.limit(0), 5).count() == 0


def test_hash_sample_with_ids_that_many_rows_share(spark):
    """A third of all ids null, or one id for all rows: the sample has its size, by whole rows."""
    n = 3000
    df = spark.range(n).selectExpr("if(id % 3 = 0, null, id) as doc_id", "id as size").repartition(5)
    taken = shared.hash_sample(df, 600, ("doc_id", "size")).collect()
    assert len(taken) == 600 and 120 < sum(r["doc_id"] is None for r in taken) < 280
    same = spark.range(n).selectExpr("7L as doc_id", "id as size")
    assert shared.hash_sample(same, 100, ("doc_id", "size")).count() == 100
    assert shared.hash_sample(same, 100).count() == 1


def test_chunk_table_asks_for_new_keys_only():
    """The time of a call is in proportion to its keys: the table itself is never walked."""

    class Watched(chunks.Table):
        walks = 0

        def __iter__(self):
            type(self).walks += 1
            return super().__iter__()

        keys = __iter__

    made = chunks.ChunkTable(str.split, lambda keys: [k.encode() for k in keys])
    made.table = Watched()
    assert made.ids(["a b a", "c"]) == [b"aba", b"c"] and made.ids(["b d"]) == [b"bd"]
    assert Watched.walks == 0 and len(made.table) == 4


def test_small_and_large_joins_agree(spark):
    a, b = spark.range(40), spark.range(20)
    assert shared.join_small(a, b, "id").count() == shared.join_small(a, b, "id", rows=3).count() == 20


def test_tables_of_earlier_tasks_make_room(monkeypatch):
    """All tables of a worker together keep to the limit, whatever stages it has served; a task's own tables stay."""
    task = [1]
    monkeypatch.setattr(chunks, "_task", lambda: task[0], raising=False)
    tables = [chunks.Table() for _ in range(3)]
    for table in tables[:2]:
        table.trim(1000)
        for i in range(3):
            table.add(f"key {i}", b"0123456789")
    tables[0].trim(1000)
    assert [len(t) for t in tables] == [3, 3, 0]
    task[0] = 2
    tables[2].trim(1000)
    assert [len(t) for t in tables] == [0, 0, 0] and sum(t.size for t in tables) == 0
