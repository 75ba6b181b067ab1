"""Quality rules: counts of each text, and an isolation forest over them.

The base rule rejects texts of fewer than MIN_WORDS words, or with more than
half of their words in repeated 3-word windows.  The rest are judged by an
isolation forest over plain rule statistics (``rates``): documents that few
random splits set apart from the others are anomalous.  The forest sees no
labels: it is fitted on at most ``FIT_ROWS`` documents that pass the base rule,
by hash of doc_id, of one half of all doc_ids.  Labels give only the threshold:
over all labelled rows of the other half it is the anomaly that best separates
quality 0 from 1 while at most ``MAX_LOST`` of quality 1 is rejected.

Nulls and edges: a null or blank text has no words and fails the base rule;
texts of any length are counted whole; null or repeated doc_ids are kept as
they are (a null one has no label, the labels of one doc_id are averaged and
rounded); without labels of both kinds only the base rule applies; an empty
table gives no rows.  Only doc_id and text are read, whatever other columns
there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import discard, hash_sample, map_texts, materialise

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TREES, SAMPLE, FIT_ROWS, SEED = 200, 64, 8192, 7
MAX_LOST = 0.002
#: Scores are calibrated to this many steps.
STEPS = 2000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_digits", "n_bare", "n_ended")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_DIGITS, _MARKS = bytes(range(48, 58)), bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Each byte as a mark, white space, or part of a word.
_KINDS = bytes(46 if c in _MARKS else 32 if c in b" \t\n\x0b\x0c\r" else 97 for c in range(256))
_BARE = re.compile(rb"(?<![.a])\.+(?![.a])")


def counts(text: str) -> tuple[int, ...]:
    """The values of BASE and MORE of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    places: dict[bytes, int] = {}
    codes = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        k = len(places)
        pairs = codes[:-1] * k + codes[1:]
        if k >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * k + codes[2:], return_inverse=True, return_counts=True)
        twice, covered = times[which] > 1, np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        repeated = int(covered.sum())
    size, kinds = len(data), data.translate(_KINDS) + b" "
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), size - len(data.translate(None, _UPPER)), size - len(data.translate(None, _LETTERS)), size - len(data.translate(None, _MARKS)), len(places),
        size - len(data.translate(None, _DIGITS)), len(_BARE.findall(kinds)), kinds.count(b". "),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts."""

    def rows(_: list, texts: list[str]) -> dict:
        found = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(BASE) + len(MORE))
        return {name: found[:, i] for i, name in enumerate((*BASE, *MORE))}

    return map_texts(docs, ", ".join(f"{c} long" for c in (*BASE, *MORE)), rows)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _rate(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rates() -> dict[str, Column]:
    """The rule statistics that the forest sees: shares of words and of characters, and the logarithm of words a line."""
    return {
        "word_length": _rate("word_chars", "n_words"), "symbols_a_word": _rate("n_symbols", "n_words"), "symbols": _rate("n_symbols", "word_chars"),
        "marks_a_word": _rate("n_marks", "n_words"), "marks": _rate("n_marks", "word_chars"), "bare_marks": _rate("n_bare", "n_words"), "ended_by_marks": _rate("n_ended", "n_words"),
        "digits": _rate("n_digits", "word_chars"), "upper": _rate("n_upper", "n_letters"), "distinct": _rate("n_distinct", "n_words"), "words_a_line": F.log1p(_rate("n_words", "n_lines")),
    }


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random splits of small samples; score() is near 1 for rows that are soon alone."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """feature, cut, left child, path length (of a leaf) of each node; a leaf's left child is itself."""
        nodes: list[list[float]] = []
        todo = [(rows, 0)]
        queue = 0
        while queue < len(todo):
            part, depth = todo[queue]
            queue += 1
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(wide):
                nodes.append([0, 0.0, queue - 1, depth + _mean_path(len(part))])
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            nodes.append([f, cut, len(todo), 0.0])
            todo += [(part[part[:, f] < cut], depth + 1), (part[part[:, f] >= cut], depth + 1)]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            node = np.zeros(len(rows), int)
            for _ in range(self.depth):
                leaf = left[node] == node
                node = np.where(leaf, node, left[node] + (rows[at_row, feature[node]] >= cut[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(_mean_path(self.size), 1e-9))


@dataclass
class Rules:
    """What is fitted: the forest, and the anomaly from which documents go."""

    forest: IsolationForest
    threshold: float = float("inf")


def with_scores(stats: DataFrame, rules: Rules) -> DataFrame:
    """stats plus ``anomaly``."""
    found = stats.withColumns(rates())
    schema = T.StructType([*found.schema.fields, T.StructField("anomaly", T.DoubleType())])
    names = list(rates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.column_stack([batch.column(c).to_numpy() for c in names])
            yield batch.append_column("anomaly", pa.array(rules.forest.score(seen), pa.float64()))

    return found.mapInArrow(run, schema).drop(*names)


def fits_forest() -> Column:
    """Whether a row is of the half that the forest may see, by hash of the id; the other half sets the threshold, with its labelled rows."""
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the rows that pass the base rule and have a quality label."""
    one = labels.where("quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    return stats.where(~base_failed()).join(one, "doc_id")


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_lost: float = MAX_LOST) -> Rules | None:
    """The fitted rules; None without labelled rows of both kinds to set the threshold, or without rows for the forest.

    The driver gets the rates of at most fit_rows rows, and at most 2 * STEPS counts.
    """
    known = materialise(labelled(stats, labels).where(~fits_forest()), "labelled-statistics")
    taken = hash_sample(stats.where(~base_failed()).where(fits_forest()), fit_rows, tuple(stats.columns), SEED).select(*(c.alias(n) for n, c in rates().items())).toPandas()
    if not len(taken) or known.where("quality >= 1").isEmpty() or known.where("quality < 1").isEmpty():
        return None
    rules = Rules(IsolationForest(taken.to_numpy(float)))
    is_good = (F.col("quality") >= 1).cast("int")
    steps = with_scores(known, rules).groupBy(F.floor(F.col("anomaly") * STEPS).cast("int").alias("step")).agg(F.sum(is_good).alias("good"), F.sum(1 - is_good).alias("bad"))
    step, kept, gone = np.array([tuple(r) for r in steps.orderBy("step").collect()], float).T
    discard(known)
    lost, caught = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (kept, gone))
    gain = np.where(lost <= max_lost, caught - lost, -1.0)
    if gain.max() > 0:
        rules.threshold = float(step[np.flatnonzero(gain == gain.max())[-1]] / STEPS)
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, anomaly (null if nothing could be fitted), kept."""
    stats = materialise(statistics(docs), "statistics")
    rules = fit(stats, labels)
    scored = stats.withColumn("anomaly", F.lit(None).cast("double")) if rules is None else with_scores(stats, rules)
    good = F.lit(True) if rules is None else F.col("anomaly") < rules.threshold
    return scored.select("doc_id", *BASE, base_failed().alias("base_failed"), "anomaly", (~base_failed() & good).alias("kept"))
