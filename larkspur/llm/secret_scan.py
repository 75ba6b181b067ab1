"""Secret scans: fixed patterns, and assignment-aware lexing.

Base patterns (assign, access, hex) give leftmost non-overlapping spans.  Then
each text that mentions a sensitive name is lexed for name-literal pairs of
source, configuration and markup (``assignments``).  Constants are propagated:
a value that names an earlier constant, joins it, or holds it in a formatted
string, stands for its literals.
Names are lexed into words (camelCase, digits and separators part them), so an
author isn't auth and a tokenizer no token; a name that ends in a neutral word
(``token_count``) isn't sensitive.  A literal's score is how sensitive the target
names are that it reaches, times how random it looks; literals of at least
THRESHOLD become spans of kind ``literal`` unless a base span covers them.

Offsets are code points, ends exclusive, in whole texts of any length.  Nulls
and edges: a null text is empty and has no spans; null or repeated doc_ids are
kept as they are; an empty table gives no rows; other columns, whatever their
names, are not read, or pass through ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import assignments
from larkspur.llm.shared import aside, back, map_texts, places

KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: How sensitive a name with these words is.
SENSITIVE = {
    ("password",): 1.0, ("passwords",): 1.0, ("passwd",): 1.0, ("pwd",): 1.0, ("pass",): 0.8, ("passphrase",): 1.0, ("secret",): 1.0, ("secrets",): 1.0, ("token",): 0.9, ("authtoken",): 0.9,
    ("apikey",): 1.0, ("api", "key"): 1.0, ("privatekey",): 1.0, ("private", "key"): 1.0, ("accesskey",): 1.0, ("access", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0,
    ("credential",): 0.9, ("credentials",): 0.9, ("auth",): 0.7, ("bearer",): 0.8, ("dsn",): 0.6, ("connection", "string"): 0.8, ("connectionstring",): 0.8,
}
#: Endings that make a word written together sensitive too.
ENDINGS = ("password", "passwd", "passphrase", "apikey", "secretkey", "privatekey", "accesskey")
#: Last words of names that tell of a secret and don't hold it.
NEUTRAL = frozenset(
    "count counts limit limits length len size sizes type types kind name names url uri path file dir folder expiry expires expiration ttl timeout age policy rule rules hint field label prefix suffix"
    " endpoint index num number total rate id ids enabled required version format min max budget usage cost model class event reset".split()
)
#: Literals that stand for a secret and are none.
PLACEHOLDERS = ("changeme", "example", "placeholder", "redacted", "your_", "your-", "xxxx", "****", "todo", "none", "null", "true", "false", "undefined")
THRESHOLD = 0.5

_PLAIN = frozenset("".join(words) for words in SENSITIVE)
_SQUEEZED = tuple({"".join(words) for words in SENSITIVE} | set(ENDINGS))
#: What every form of a pair holds one of.
_SIGNS = ("=", ":", "<", "(", "#", "--", "ENV", "ARG", "setenv")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


@lru_cache(1 << 14)
def sensitivity(name: str) -> float:
    """How sensitive a target is, by the words of its name."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in NEUTRAL:
        return 0.0
    known = {*zip(words), *zip(words, words[1:], strict=False)}
    return max(*(weight for part, weight in SENSITIVE.items() if part in known), 1.0 if any(w.endswith(ENDINGS) for w in words) else 0.0, 0.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy of the characters, over that of a random literal of that length; 0 for placeholders."""
    literal = literal.strip()
    low = literal.lower()
    if len(literal) < MIN_ASSIGN or any(p in low for p in PLACEHOLDERS) or literal.startswith(("${", "$(", "{{", "%(")):
        return 0.0
    n, counts = len(literal), Counter(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    share = entropy / min(math.log2(n), 6.0)
    mixed = any(c.isdigit() for c in literal) or not literal.isalpha()
    return share if mixed else share * 0.5


def literal_spans(text: str) -> list[Span]:
    """Spans of literals that reach a sensitive target.

    Sensitivity flows from each pair back to the earlier ones whose names it
    uses, so a constant that many others join is looked at once for each use.
    """
    latest: dict[str, int] = {}
    weights: list[float] = []
    found: list[assignments.Pair] = []
    uses: list[list[int]] = []
    for pair in assignments.pairs(text, sensitivity, _PLAIN):
        uses.append([latest[name] for name in pair.uses if name in latest])
        latest[pair.known_as] = len(found)
        weights.append(max(map(sensitivity, pair.names)))
        found.append(pair)
    reached: dict[tuple[int, int], float] = {}
    for i in range(len(found) - 1, -1, -1):
        for j in uses[i]:
            weights[j] = max(weights[j], weights[i])
        for span in found[i].literals:
            reached[span] = max(reached.get(span, 0.0), weights[i])
    for name, span in assignments.elements(text):
        reached[span] = max(reached.get(span, 0.0), sensitivity(name))
    return sorted(("literal", a, b) for (a, b), weight in reached.items() if weight > 0 and weight * randomness(text[a:b]) >= THRESHOLD)


def names_any(text: str) -> bool:
    """Whether a sensitive name can be in the text: whatever ``sensitivity`` rates holds one of these once case and separators are gone."""
    low = text.lower().replace("_", "").replace("-", "").replace(".", "")
    return any(w in low for w in _SQUEEZED)


def spans(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    found = base_spans(text)
    if any(sign in text for sign in _SIGNS) and names_any(text):
        found += [s for s in literal_spans(text) if not any(a <= s[1] and s[2] <= b for _, a, b in found)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "spans array<struct<kind:string,start:int,stop:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans."""

    def rows(_: list, texts: list[str]) -> dict:
        return {"spans": pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in spans(t)] for t in texts], _TYPE)}

    return map_texts(docs, _SPANS, rows)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(text: str, found: list[Span]) -> str:
    """The text with each span, overlapping ones together, put as [SECRET]."""
    out, at = [], 0
    for _, a, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text, and n_chars of the new text; rows without secrets stay as they are."""
    columns = docs.columns

    def rows(_: list, texts: list[str]) -> dict:
        clean = [masked(t, found) if (found := spans(t)) else t for t in texts]
        return {"clean": pa.array(clean, pa.string()), "changed": pa.array([a is not b for a, b in zip(clean, texts, strict=True)])}

    made = map_texts(aside(docs, "text"), "clean string, changed boolean", rows, keys=places(columns))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return back(made, columns, {c: F.when(F.col("changed"), new[c]).otherwise(F.col(place)) for c, place in zip(columns, places(columns), strict=True) if c in new})
