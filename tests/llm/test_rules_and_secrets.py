"""Quality rules and secret scans against plain versions."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import quality_rules, queries, secret_scan
from larkspur.llm.shared import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from(list("ab \n\t#|é \x1c")), max_size=60), st.text(max_size=40)))
def test_counts(text):
    assert quality_rules.counts(text)[:5] == plain_counts(text)


def test_isolation_forest_sets_the_odd_apart():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(500, 3)), [[9.0, 9, 9], [-9, 9, 0]]])
    score = quality_rules.IsolationForest(rows).score(rows)
    assert set(np.argsort(-score)[:2]) == {500, 501} and score.max() < 1 and score.min() > 0


def test_op3(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeated = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_rules_catch_labelled_junk_and_keep_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_quality_rules"](spark, sf).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_quality_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(r["anomaly"] is None for r in rows)
    assert {r["kept"] for r in rows if r["base_failed"]} == {False}
    assert quality_rules.judge(no_docs, labels).collect() == []


def plain_spans(text):
    assign = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


PIECES = ["password", "PassWd", "api_key", "apiKEY", "token", "secret", "=", ":", " ", '"', "'", "hunter22", "abc", "AKIA", "AKIAAKIA" + "Z9" * 9, "0123456789abcdef" * 2, "deadbeef", "é", "ſecret", "toKen", "\n", "x=1", "-"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    base = [s for s in secret_scan.spans(text) if s[0] in secret_scan.BASE_KINDS]
    assert base == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('k = "q8Zr!2mK#x9LpV0w"\ndb_password = k', ["q8Zr!2mK#x9LpV0w"]),
        ("clientCredential: 'zX9#kQ2!vB7$'", ["zX9#kQ2!vB7$"]),
        ("<private-key>f3J9-q0Z7-LmX2</private-key>", ["f3J9-q0Z7-LmX2"]),
        ('a = "9fK2#"\nb = "Lq8$zT0!"\nauth_header = "Basic " + b', ["Lq8$zT0!"]),
        ('colour = "q8Zr!2mK#x9LpV0w"', []), ('passphrase = "changeme"', []), ('db_pwd = "${DB_PASSWORD}"', []), ("see http://x.org/a:b", []),
    ],
)
def test_literals_reach_sensitive_targets(text, found):
    assert [text[a:b] for k, a, b in secret_scan.spans(text) if k == "literal"] == found


@pytest.mark.parametrize("name", ["api.key", "access.key", "aws.access.key", "private.key", "connectionString", "ConnectionString", "Api-Key", "spring.datasource.connection-string"])
def test_names_in_any_spelling_are_looked_at(name):
    text = f"{name} = q8Zr2mK9xLpV0wT4"
    assert ["q8Zr2mK9xLpV0wT4"] == [text[a:b] for k, a, b in secret_scan.spans(text) if k == "literal"]
    assert secret_scan.names_any("x " + name) and not secret_scan.names_any("colour = q8Zr2mK9xLpV0wT4")


def test_lexing_long_texts_is_linear():
    assert secret_scan.spans("a" * 200_000 + ' password_="' + "b." * 100_000) is not None
    assert secret_scan.spans('secret ' + '"' * 50_000 + "=" * 50_000) is not None


def test_joined_constants_are_linear():
    secret = "q8Zr!2mK#x9LpV0w"
    doubled = f'k0 = "{secret}"\n' + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 2000))
    for last, n in (("db_password = k1999\n", 1), ("colour = k1999\n", 0)):
        assert [s[0] for s in secret_scan.spans(doubled + last + "# secret")] == ["literal"] * n
    grown = 'k = "a1b2#"\n' + "".join(f'k = k + "q{i}Zr!2mK#x"\n' for i in range(3000)) + "auth_header = k\n"
    assert len(secret_scan.spans(grown)) == 3000
    again = f'k = "{secret}"\nauth_header = k\nk = "Lq8$zT0!mmQ4"\n'
    assert [again[a:b] for _, a, b in secret_scan.spans(again)] == [secret]


def plain_path(tree, row):
    """The path length of a row, by walking one tree."""
    feature, cut, left, length = tree
    node = 0
    while left[node] != node:
        node = left[node] + int(row[feature[node]] >= cut[node])
    return length[node]


def test_kept_is_the_verdict_of_a_plain_forest(spark):
    """Path lengths walked one by one give the anomalies, which differ, and the threshold gives kept; labels of the forest's half change nothing."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = materialise(quality_rules.statistics(docs), "stats")
    rules = quality_rules.fit(stats, labels)
    seen = stats.select("doc_id", *(c.alias(n) for n, c in quality_rules.rates().items())).collect()
    plain = {}
    for r in seen[:150]:
        mean = np.mean([plain_path(t, tuple(r)[1:]) for t in rules.forest.trees])
        plain[r["doc_id"]] = 2 ** (-mean / quality_rules._mean_path(rules.forest.size))
    rows = quality_rules.judge(docs, labels).collect()
    assert all(r["anomaly"] == pytest.approx(plain[r["doc_id"]]) for r in rows if r["doc_id"] in plain)
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] < rules.threshold) for r in rows)
    assert len({r["anomaly"] for r in rows}) > 0.5 * len(rows)
    flipped = labels.withColumn("quality", F.when(quality_rules.fits_forest(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_rules.fit(stats, flipped).threshold == rules.threshold


def test_rules_on_megabyte_texts_and_clashing_columns(spark):
    rows = [(1, "word and " * 120_000, "a"), (2, "x" * 1_000_000, "b"), (2, "x" * 1_000_000, "b"), (3, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("anomaly", F.lit("x"))
    found = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"]) for r in found) == [(1, 240_000, 840_000), (2, 1, 1_000_000), (2, 1, 1_000_000), (3, 0, 0)]


SECRET_FORMS = (
    'password: str = "{}"', 'api.key: "{}"', "const apiKey: string = '{}';", "DB_PASSWORD={}", 'k = "{}"\nclient_secret = k', "<password>{}</password>", "dbPassword2 => '{}'", 'authToken := "{}"', "db_password: {}",
    'signing_key: dict[str, str] = "{}"', 'a = "{}"\nb = a\nauth = "Basic " + b', '{{"private_key": "{}"}}',
)
HARMLESS_FORMS = (
    'author = "Smith, J. {}"', 'secretary = "Mary {}"', 'tokenizer: "BertWordPiece-{}"', 'token_count = "{}"', 'token_type: "{}"', 'compass = "{}"', 'password_policy: "{}"', 'monkey = "{}"', 'passage: "{}"', 'tokens = "{}"', "see http://x.org/{} for a secret: none", 'colour = "{}"',
)


def planted(n=25):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    for _ in range(n):
        for forms, secret in ((SECRET_FORMS, True), (HARMLESS_FORMS, False)):
            for form in forms:
                value = "".join(rng.choice(letters, 14)) + "7!" + "q"
                yield f"some words before\n{form.format(value)}\nand after", value, secret


def test_precision_and_recall_on_planted_spans():
    hit = missed = false = 0
    for text, value, secret in planted():
        spans = secret_scan.spans(text)
        found = any(a <= text.index(value) and text.index(value) + len(value) <= b for _, a, b in spans)
        hit, missed, false = hit + (secret and found), missed + (secret and not found), false + (not secret and bool(spans))
    assert hit / (hit + missed) >= 0.98 and hit / (hit + false) >= 0.98


@pytest.mark.parametrize("text", ["password=" * 100_000, "a: " * 200_000 + "password=1", "a: b[c " * 100_000 + "password = 1", "password: " + "str | " * 50_000, '"' * 200_000 + "password=", "x" * 2_000_000 + " password = q8Zr2mK9xLpV0w"])
def test_texts_of_megabytes_are_lexed_once(text):
    began = time.perf_counter()
    secret_scan.spans(text)
    assert time.perf_counter() - began < 10


def test_op5(spark, sf_dir):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in secret_scan.BASE_KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""} if spans else True


def test_redaction(spark, edge_docs, no_docs):
    rows = [(1, "x password=hunter22 y", "en", "s", 21), (2, "plain", "en", "s", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, edge_docs.schema)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.redact(docs).collect()}
    assert got == {1: ("x [SECRET] y", 12), 2: ("plain", 5), 3: (None, None)}
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(no_docs).collect() == []
    assert sorted(map(str, secret_scan.redact(edge_docs).collect())) == sorted(map(str, edge_docs.collect()))
