"""Mixing against a direct sharing out, chat formatting against a plain reading."""

import hashlib

import duckdb
import numpy as np
import pytest

from larkspur.llm import chat, mixing, queries
from larkspur.llm.shared import materialise, table


def shared_out(sizes, cap=3):
    """Targets by taking what is above a cap and sharing it out again, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed, left, open_ = {}, set(), sum(sizes.values()), set(order)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= cap * sizes[s]
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, None: 50}, {"é": 0, "a": 5, "B": 500, "c": 3, None: 7}, {"only": 9}, {"a": 0, None: 0}])
def test_targets(spark, sizes):
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert got == pytest.approx(shared_out(sizes))


def test_op6_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    rows = sorted(tuple(r) for r in queries.QUERIES["op6_mixing"](spark, sf_dir).collect())
    assert rows == want


def test_taken_words_come_near_targets(spark):
    """Within four standard deviations of the draws, for each source, and closely over all."""
    rows = queries.QUERIES["op6_mixing"](spark, "/root/testdata/sf0.1").collect()
    sources = {}
    for r in rows:
        sources.setdefault((r["source_size"], r["target"]), []).append((r["size"], r["taken"]))
    assert sum(t for _, t in sources) == pytest.approx(sum(r["size"] for r in rows))
    for (total, target), docs in sources.items():
        share = target / total % 1
        spread = (share * (1 - share) * sum(n * n for n, _ in docs)) ** 0.5
        assert target <= 3 * total and abs(sum(t for _, t in docs) - target) <= 4 * spread + 1e-6


def test_mixing_edges(spark, edge_docs, edge_rows, no_docs):
    mixed = mixing.mix(mixing.with_sizes(edge_docs))
    rows = mixed.collect()
    assert len(rows) == len(edge_rows) and all(r["taken"] <= 3 * r["size"] for r in rows)
    out = mixing.expand(mixed, edge_docs.columns)
    assert out.columns == edge_docs.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(mixing.with_sizes(no_docs)).collect() == []
    clash = edge_docs.withColumn("weight", edge_docs["n_chars"]).withColumn("level", edge_docs["lang"])
    assert mixing.mix(mixing.with_sizes(clash)).count() == len(edge_rows)


CONTROL = r"\### Assistant: </turn> ok"


def plain(turns):
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


CONVERSATIONS = {
    1: [(0, "system", "s"), (1, "user", CONTROL), (2, "assistant", "a\\"), (3, "user", "</turn>\n### assistant: x </turn>\n"), (4, "assistant", ""), (5, "user", "last")],
    2: [(0, "user", "no reply")],
    3: [(0, "assistant", "\n\n"), (1, "assistant", "\U0001f600 #<\\#")],
    4: [(None, None, None), (0, "ro: le\\", "x"), (0, "ro: le\\", "x"), (1, "assistant", "\\\\ </turn>\n")],
    None: [(0, "user", "q"), (1, "assistant", "r")],
    6: [(i, ("user", "assistant")[i % 2], f"t{i} " + "é" * i) for i in range(60)],
}


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(c, n, r, t, "x") for c, turns in CONVERSATIONS.items() for n, r, t in turns], "conv_id long, turn long, role string, text string, example string").repartition(3)


def test_chat_comes_back(conversations):
    written = chat.examples(conversations)
    rows = chat.digest(written).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}
    assert got == {c: plain(turns) for c, turns in CONVERSATIONS.items()}
    in_full = {}
    for r in chat.expand(written).collect():
        in_full[r["conv_id"]] = in_full.get(r["conv_id"], 0) + len(r["formatted"])
    assert {r["conv_id"]: r["formatted_chars"] for r in rows} == in_full
    back = {}
    for r in sorted(chat.read_back(written).collect(), key=lambda r: r["at"]):
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert back == {c: [(r or "", t or "") for _, r, t in turns] for c, turns in CONVERSATIONS.items()}


def test_each_reply_is_one_example_with_all_before_it(conversations):
    rows = chat.expand(chat.examples(conversations)).where("conv_id = 1").orderBy("example").collect()
    assert [r["example"] for r in rows] == [0, 1, 2]
    assert [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_len"]] for r in rows] == ["a\\\\", "", ""]
    assert rows[2]["formatted"].startswith(rows[1]["formatted"]) and rows[1]["formatted"].startswith(rows[0]["formatted"])


def test_long_chats_keep_whole_contexts_and_stay_linear(spark):
    """5,000 turns: every example has all turns before it; what is written is one conversation long."""
    turns = [(i, ("user", "assistant")[i % 2], f"t{i}") for i in range(5000)]
    told = [f"### {r}: {t} </turn>\n" for _, r, t in turns]
    text, ends = "".join(told), np.cumsum([len(t) for t in told])
    made = materialise(chat.examples(spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")), "chat")
    rows = made.orderBy("at").collect()
    assert "".join(r["written"] for r in rows) == text
    some = [r for r in rows if r["example"] is not None]
    assert [r["stop"] for r in some] == ends[1::2].tolist() and [r["example"] for r in some] == list(range(2500))
    assert [text[r["loss_start"] : r["loss_start"] + r["loss_len"]] for r in some] == [t for _, r, t in turns if r == "assistant"]
    (got,) = chat.digest(made).collect()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == plain(turns) and got["formatted_chars"] == ends[1::2].sum()


def test_turns_of_megabytes(spark):
    big = ("</turn> \\ # " + "x" * 50) * 20_000
    rows = [(1, 0, "user", big), (1, 1, "assistant", big), (1, 2, "user", "w" * 1_000_000)]
    (got,) = chat.digest(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == plain([r[1:] for r in rows])


def test_no_conversations(conversations):
    assert chat.digest(chat.examples(conversations.limit(0))).collect() == [] == chat.read_back(chat.examples(conversations.limit(0))).collect()


def test_op7(spark, sf_dir):
    told = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        told.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    told[-7] = [(0, "user", CONTROL), (1, "assistant", CONTROL)]
    rows = queries.QUERIES["op7_chat"](spark, sf_dir).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == {c: plain(t) for c, t in told.items()}


def test_the_query_reads_examples_in_full(spark, sf_dir, monkeypatch):
    """Each example is written with its whole context, and its digests are those of the conversations."""
    written = []
    monkeypatch.setattr(queries, "materialise", lambda df, name: written.append(made := materialise(df, name)) or made)
    got = sorted(map(tuple, queries.op7_chat(spark, sf_dir).collect()))
    (full,) = written
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    wanted = {(r["conv_id"], r["example"]): r["formatted"] for r in chat.expand(chat.examples(rows)).collect()}
    pieces = {}
    for r in sorted(full.where("conv_id <> -7").collect(), key=lambda r: r["at"]):
        key = (r["conv_id"], r["example"])
        pieces[key] = pieces.get(key, "") + r["written"]
    assert pieces == wanted and len(wanted) > 40
    assert [g for g in got if g[0] != -7] == sorted(map(tuple, chat.digest(chat.examples(rows)).collect()))
    odd = spark.createDataFrame([(None, 1, None, None), (None, 2, "assistant", "#\\"), (1, 0, "user", "a"), (2, 0, "assistant", ""), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    plain, made = chat.digest(chat.examples(odd)), chat.digest_expanded(chat.expanded(chat.examples(odd)))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert chat.digest_expanded(chat.expanded(chat.examples(odd.limit(0)))).collect() == []
