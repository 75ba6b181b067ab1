"""Toxicity: a counterfactual-regularised classifier.

Inputs are the distinct words of a text and the beginnings of its longer words
(for inflected forms), all hashed to 32 bits; none is left out.  A logistic
regression weighs them, each scaled by its log share in toxic over other texts
of the sample.  Of each sampled text that names a group, a copy with the
group's terms swapped is made, and the loss has, besides the log loss,
COUNTERFACTUAL times the mean squared change of the log-odds between text and
copy, so a neutral mention of one group can't score above that of another.

Groups: IDENTITY_GROUPS (or the caller's), and groups that are found in the
sample itself (``found_groups``): frequent words whose share in toxic and other
texts doesn't differ beyond chance, put together when the same words stand
before them, which keeps languages and kinds of words apart.

Fitted on a bounded sample: at most FIT_ROWS labelled ids of each class, by
hash of doc_id, one document an id, of rows that are not held out (crc32 of the
doc_id as text, mod FOLDS, is 0 for held-out rows); their ids are the only
thing broadcast.  Every whole text is scored.  Labels, language, source and
doc_id are never inputs of a score.

Nulls and edges: a null or blank text scores the intercept; texts of any length
count whole; a null doc_id is kept (never held out, never labelled); repeated
rows get equal scores; without labels of both classes the score is 1 if there
are toxic labels only, else 0; an empty table gives no rows.  Only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.chunks import Table, packed
from larkspur.llm.shared import discard, hash_sample, join_small, map_texts, materialise

FOLDS = 5
FIT_ROWS = 2000
#: Bytes of the beginnings of words.
STEMS = (4, 5, 6)
RIDGE, COUNTERFACTUAL, STEPS, RATE = 1e-3, 1.0, 80, 0.1
#: Words that may form groups, words before them that are looked at, share of texts that a term is in at least, terms of a group, least likeness.
TERMS, BEFORE, LEAST_SHARE, GROUP, LIKENESS = 400, 400, 0.02, 4, 0.3

Groups = tuple[tuple[str, ...], ...]

#: Terms of which one may stand for another of its line.
IDENTITY_GROUPS: Groups = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("africans", "europeans", "asians", "americans", "arabs"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W_]+")
_SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Codes(Table):
    """The packed hashes of a word (bytes of ASCII letters and digits, or others) and of its beginnings."""

    def __missing__(self, word: bytes) -> bytes:
        return self.add(word, packed([zlib.crc32(word), *(zlib.crc32(b"^" + word[:n]) for n in STEMS if len(word) > n)]))


_codes = Codes()


def features(text: str) -> np.ndarray:
    """The distinct hashes of the lower-case words, ASCII punctuation taken as space, and of their beginnings, in order."""
    _codes.trim()
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())
    return np.unique(np.frombuffer(b"".join(map(_codes.__getitem__, words)), "<u4"))


class Swap:
    """Puts each term of a group as the next of its group."""

    def __init__(self, groups: Groups):
        self.next = {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group) if len(group) > 1}

    def __call__(self, text: str) -> str | None:
        """The text with its terms swapped; None if it has none."""
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            other = self.next.get(m[0].lower())
            n += other is not None
            return m[0] if other is None else other

        made = _WORD.sub(put, text)
        return made if n else None


@dataclass
class Model:
    """Hashes in order and their weights; ``swapped``, ``change``, ``change_without``: sampled texts with group terms and the mean change of their log-odds, with and without the penalty."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    intercept: float = 0.0
    groups: Groups = ()
    swapped: int = 0
    change: float = 0.0
    change_without: float = 0.0

    def logit(self, text: str) -> float:
        if not len(self.keys):
            return self.intercept
        found = features(text)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return self.intercept + float(self.weights[at[self.keys[at] == found]].sum(dtype=np.float64))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array([self.logit(t) for t in texts], float), -50, 50)))


def train(texts: list[np.ndarray], gone: list[np.ndarray], come: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, scale: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on all rows at once.

    texts: places of the features of each row; gone, come: of those that its
    copy lacks or adds (none: no copy); scale: what each feature counts for.
    """
    lengths = np.array([len(x) for x in texts])
    rows, cols = np.repeat(np.arange(len(texts)), lengths), np.concatenate([*texts, np.zeros(0, np.int64)])
    paired = np.array([i for i in range(len(texts)) if len(gone[i]) or len(come[i])], int)
    changed = [np.concatenate([gone[i], come[i]]) for i in paired]
    pair_rows = np.repeat(np.arange(len(paired)), [len(x) for x in changed])
    pair_cols = np.concatenate([*changed, np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([*(np.repeat([1.0, -1.0], [len(gone[i]), len(come[i])]) for i in paired), np.zeros(0)]) * scale[pair_cols]
    value, n = scale[cols], len(scale)
    u, b = np.zeros(n), float(np.log((weight @ toxic + 1) / (weight @ (1 - toxic) + 1)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    share = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, value * u[cols], len(texts))
        residual = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic)
        g = np.append(np.bincount(cols, residual[rows] * value, n) + RIDGE * u, residual.sum())
        if len(paired) and counterfactual:
            change = np.bincount(pair_rows, sign * u[pair_cols], len(paired))
            g[:-1] += 2 * counterfactual / len(paired) * np.bincount(pair_cols, sign * change[pair_rows], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        u, b = u - move[:-1], b - move[-1]
    return u * scale, float(b)


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """toxic, text of at most fit_rows labelled ids of each class that aren't held out, one document each (of the least hash of its text)."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))
    known = materialise(known, "toxic-labels")
    first = [hash_sample(known.where(F.col("toxic") == c), fit_rows) for c in (1, 0)]
    chosen = materialise(first[0].union(first[1]), "toxic-sample")
    found = join_small(docs.select("doc_id", "text"), chosen, "doc_id", rows=2 * fit_rows)
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")


def found_groups(rows: DataFrame, terms: int = TERMS, before: int = BEFORE) -> Groups:
    """Groups of frequent, label-independent words that stand after the same words; the driver gets at most ``terms`` words and a table of terms by words before."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ()
    counted = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share_a, share_b = F.col("a") / n[1], F.col("b") / n[0]
    pooled = (F.col("a") + F.col("b")) / (n[0] + n[1])
    chance = F.abs(share_a - share_b) <= 2 * F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    frequent = counted.where((share_b >= LEAST_SHARE) & (F.length("word") > 1)).orderBy(F.desc("b"), "word").limit(terms + before)
    listed = frequent.select("word", chance.alias("neutral")).collect()
    preceding = {r["word"]: i for i, r in enumerate(listed[:before])}
    place = {r["word"]: i for i, r in enumerate([r for r in listed if r["neutral"]][:terms])}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(place), len(preceding)), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                said = _WORD.findall((text or "").lower())
                for a, b in zip(said, said[1:], strict=False):
                    if b in place and a in preceding:
                        counts[place[b], preceding[a]] += 1
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(counts[i, j])], names=["term", "before", "n"])

    table = rows.select("text").mapInArrow(contexts, "term long, before long, n long").groupBy("term", "before").agg(F.sum("n").alias("n")).toPandas()
    context = np.zeros((len(place), len(preceding)))
    context[table["term"], table["before"]] = np.sqrt(table["n"])
    return grouped(list(place), context)


def grouped(terms: list[str], context: np.ndarray, size: int = GROUP, likeness: float = LIKENESS) -> Groups:
    """Terms in order, each with the most alike of those that are left."""
    unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    like, left, made = unit @ unit.T, np.ones(len(terms), bool), []
    for i in range(len(terms)):
        if left[i]:
            left[i] = False
            best = [j for j in np.argsort(-like[i], kind="stable") if left[j] and like[i, j] >= likeness][: size - 1]
            if best:
                left[best] = False
                made.append((terms[i], *(terms[j] for j in best)))
    return tuple(made)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, groups: Groups | None = None, counterfactual: float = COUNTERFACTUAL, compare: bool = False) -> Model:
    """The model; the driver gets the hashed features of at most 2 * fit_rows texts.

    groups: identity groups instead of IDENTITY_GROUPS and those found in the
    sample; compare: fit once more without the penalty, for ``change_without``.
    """
    rows = materialise(sample(docs, labels, fit_rows), "toxic-texts")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(intercept=50.0 if n.get(1) else -50.0)
    if groups is None:
        known = {t for g in IDENTITY_GROUPS for t in g}
        groups = IDENTITY_GROUPS + tuple(g for g in found_groups(rows) if not known.intersection(g))
    swap = Swap(groups)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[], [], []]
            for text in batch.column("text").to_pylist():
                own = features(text or "")
                copy = swap(text or "")
                other = own if copy is None else features(copy)
                for to, x in zip(made, (own, np.setdiff1d(own, other), np.setdiff1d(other, own)), strict=True):
                    to.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x, pa.binary()) for x in made)], names=["toxic", "own", "gone", "come"])

    table = rows.select("toxic", "text").mapInArrow(coded, "toxic int, own binary, gone binary, come binary").toArrow()
    discard(rows)
    own, gone, come = ([np.frombuffer(x, "<u4") for x in table.column(c).to_pylist()] for c in ("own", "gone", "come"))
    toxic = table.column("toxic").to_numpy().astype(float)
    keys = np.unique(np.concatenate([*own, *come]))
    own, gone, come = ([np.searchsorted(keys, x) for x in part] for part in (own, gone, come))
    total = {r["toxic"]: r["count"] for r in labels.where("toxic is not null").where(~held_out()).groupBy(F.when(F.col("toxic") >= 1, 1).otherwise(0).alias("toxic")).count().collect()}
    weight = np.where(toxic == 1, total.get(1, 1) / n[1], total.get(0, 1) / n[0])
    with_toxic, without = (sum((np.bincount(x, minlength=len(keys)) for x, y in zip(own, toxic, strict=True) if y == c), np.zeros(len(keys))) for c in (1, 0))
    scale = np.log((with_toxic + 1) / (n[1] + 2)) - np.log((without + 1) / (n[0] + 2))
    paired = [i for i in range(len(own)) if len(gone[i]) or len(come[i])]

    def change(w: np.ndarray) -> float:
        return float(np.mean([abs(w[come[i]].sum() - w[gone[i]].sum()) for i in paired])) if paired else 0.0

    w, intercept = train(own, gone, come, toxic, weight, scale, counterfactual)
    used = np.abs(w) > 1e-9
    plain = change(train(own, gone, come, toxic, weight, scale, 0.0)[0]) if compare else 0.0
    return Model(keys[used], w[used].astype(np.float32), intercept, groups, len(paired), change(w), plain)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def rows(_: list, texts: list[str]) -> dict:
        return {"score": model.score(texts)}

    return map_texts(docs, "score double", rows)
