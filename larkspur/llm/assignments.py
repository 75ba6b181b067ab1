"""Name-literal pairs of source and configuration texts.

``pairs`` lexes a text once, whatever its language, for what gives a name a
literal:

* assignments and entries: ``name = "x"``, ``name: type = "x"``, ``name: x``, ``"name" => 'x'``,
  ``box["name"] = "x"``, ``a, b = "x", "y"``, ``#define NAME "x"``, ``ENV NAME x``, ``--name x``;
* calls: ``set_name("x")``, ``.name("x")``, ``setProperty("name", "x")``.

``elements`` has those of markup: ``<name>x</name>``, ``<item key="name" value="x"/>``,
``<item key="name">x</item>``.

A value is a string (plain, prefixed, triple-quoted, in backticks), strings and
names joined by ``+``, ``.``, ``..``, ``||`` or only put side by side, a list or
tuple of such in brackets that may go over lines, one on the next, deeper
line, a YAML list or block, or bare characters with a digit.  Names of
earlier targets in it, as they are, ``${name}``, ``#{name}``, ``%(name)s``, or
``{name}`` in a formatted string, are uses.

Every part of a text is looked at a bounded number of times: brackets and
strings are taken by the target before them, and a quote that doesn't close is
remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

Place = tuple[int, int]

NAME = r"[A-Za-z_][\w.-]*+"
_TYPE_NAME = r"[A-Za-z_][\w.]*+(?:\[[^\]\n=]{0,80}+\]|<[^>\n=]{0,80}+>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_]\w*+)*+"
_START = re.compile(
    rf"""(?<![^\n])[ \t]*+(?:\#[ \t]*+define|ENV|ARG|setenv)[ \t]++(?P<directive>{NAME})[ \t]++
    |(?<![\w.-])--(?P<flag>{NAME})(?:=|[ \t]++(?!-))
    |(?<![\w.-])(?P<call>{NAME})\((?:[ \t\n]*+["'](?P<key>[\w.-]++)["'][ \t]*+,)?
    |(?<![\w.-])["']?(?P<name>{NAME})["']?(?P<keys>(?:\[[ \t]*+(?:["']?[\w.-]{{1,80}}+["']?[ \t]*+)?\])*+)[ \t]*+
      (?P<sign>:=|=>|=(?!=)|:[ \t]*+{_TYPE_NAME}[ \t]*+=(?![=>])|:(?!//))[ \t]*+""",
    re.ASCII | re.VERBOSE,
)
_KEY = re.compile(r"[A-Za-z_][\w.-]*+", re.ASCII)
_OPEN = re.compile(r"""(?P<prefix>[A-Za-z@$]{0,2}+)(?P<quote>\"{3}|'{3}|["'`])""")
_REST = {q: re.compile(rf"(?:[^\\\n{q}]|\\.)*+{q}") for q in "\"'`"}
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>&|+]+(?:\+[^\s"'`,;(){}\[\]<>&|+]+)*+""")
_JOIN = re.compile(r"""(?:\+|\.\.?|\|\|)[ \t]*+(?=["'`A-Za-z_$@])""")
_SPACES, _LINES = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"[ \t\r\n\\]*+")
_USE = re.compile(r"\$\{(?P<shell>[\w.-]++)\}|\#\{(?P<ruby>[\w.-]++)\}|%\((?P<old>[\w.-]++)\)s|\{\{[ \t]*+(?P<mustache>[\w.-]++)[ \t]*+\}\}", re.ASCII)
_FORMATTED = re.compile(r"\$?\{(?P<name>[A-Za-z_][\w.]*+)(?:![rsa])?(?::[^{}\n]{0,40}+)?\}", re.ASCII)
#: Calls that give their literal on as it is.
_WRAPPED = re.compile(r"(?:new[ \t]++)?(?:\w++\.)*+(?:str|bytes|String|Secret|SecretStr|SecretString|Password|b64decode|atob|decode|fromhex|encode)\((?=[ \t\n]*+[\"'`A-Za-z@$])", re.ASCII)
#: Below a key: the indent, a list's dash, and a token that is all of its line.
_BELOW = re.compile(r"(?:[|>][+-]?)?[ \t]*+\r?\n(?P<indent>[ \t]*+)(?P<dash>-[ \t]++)?")
_LINE_END = re.compile(r"[ \t,;}\])]*+(?=\r?\n|\Z)")
_SETTER = re.compile(r"(?:set|with|put|use|add|store|save)(?:_|(?=[A-Z]))")
_STATEMENT = re.compile(r"(?:const|let|var|auto|local|my)[ \t]+\Z")
_LITTLE = 6

_TAG = re.compile(rf"""<(?P<tag>[A-Za-z_][\w:.-]*+)(?P<attributes>(?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+)>(?P<text>[^<>\n]++(?=</(?P=tag)>))?""", re.ASCII)
_ATTRIBUTE = re.compile(r"""(?P<name>[A-Za-z_][\w:.-]*+)[ \t\n]*+=[ \t\n]*+(?:"(?P<double>[^"<]*+)"|'(?P<single>[^'<]*+)')""", re.ASCII)
NAMING, VALUED = ("name", "key", "id", "property"), ("value", "content", "default", "text")


class Pair(NamedTuple):
    """Names of a target (its own and its keys), under which later values know it, the places of its literals, and the targets it uses."""

    names: tuple[str, ...]
    known_as: str
    literals: list[Place]
    uses: list[str]


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = text
        self.known: set[str] = set()
        self.unclosed: dict[str, int] = {}
        self.run_end = self.last_digit = 0

    def string(self, at: int) -> tuple[str, int, int, int] | None:
        """Prefix, inner start and stop, and end of the string at a place."""
        if (m := _OPEN.match(self.text, at)) is None:
            return None
        quote, start = m["quote"], m.end()
        if start < self.unclosed.get(quote, 0):
            return None
        if len(quote) == 3:
            stop = self.text.find(quote, start)
        else:
            closed = _REST[quote].match(self.text, start)
            stop = closed.end() - 1 if closed else -1
        if stop < 0:
            line = self.text.find("\n", start) if len(quote) == 1 else -1
            self.unclosed[quote] = line if line >= 0 else len(self.text)
            return None
        return m["prefix"].lower() + (quote if quote == "`" else ""), start, stop, stop + len(quote)

    def take_string(self, at: int, literals: list[Place], uses: list[str]) -> int:
        """The end of the string at a place, 0 if there is none; a string with uses is no literal itself, long parts between them with digits are."""
        if (found := self.string(at)) is None:
            return 0
        prefix, start, stop, end = found
        pattern = _FORMATTED if "f" in prefix or "$" in prefix or "`" in prefix else _USE
        cut, parts = start, []
        for m in pattern.finditer(self.text, start, stop):
            uses += [name for name in m.groups() if name in self.known]
            parts.append((cut, m.start()))
            cut = m.end()
        if not parts:
            literals.append((start, stop))
        else:
            for a, b in [*parts, (cut, stop)]:
                part = self.text[a:b]
                if b - a > _LITTLE and any(c.isdigit() for c in part) and not any(c.isspace() for c in part) and ":" not in part:
                    literals.append((a, b))
        return end

    def below(self, at: int, literals: list[Place], uses: list[str]) -> int:
        """The end of what lines below a key give it: one deeper token or string, or a list of them."""
        text = self.text
        while (m := _BELOW.match(text, at)) and (m["indent"] or m["dash"]):
            mine: list[Place] = []
            if not (end := self.take_string(m.end(), mine, uses)):
                bare = _BARE.match(text, m.end())
                if bare is None or bare[0].endswith(":") or not any(c.isdigit() for c in bare[0]):
                    break
                mine, end = [bare.span()], bare.end()
            if _LINE_END.match(text, end) is None:
                break
            literals += mine
            at = end
            if not m["dash"]:
                break
        return at

    def value(self, at: int, several: bool = False) -> tuple[list[tuple[list[Place], list[str]]], int]:
        """(literals, uses) of each element of the value at a place, and the end of a bare one, else 0."""
        text, parts, depth, wanted, bare_end = self.text, [([], [])], 0, True, 0
        while True:
            literals, uses = parts[-1]
            at = (_LINES if depth else _SPACES).match(text, at).end()
            sign = text[at : at + 1]
            if sign and sign in "([" and wanted:
                depth, at = depth + 1, at + 1
            elif depth and sign and sign in ")]":
                depth, at, wanted = depth - 1, at + 1, False
            elif sign == "," and (depth or several):
                parts.append(([], []))
                at, wanted = at + 1, True
            elif end := self.take_string(at, literals, uses):
                at, wanted = end, False
            elif not wanted:
                if (joined := _JOIN.match(text, at)) is None:
                    break
                at, wanted = joined.end(), True
            elif used := _USE.match(text, at):
                uses += [name for name in used.groups() if name in self.known]
                at, wanted = used.end(), False
            elif wrapped := _WRAPPED.match(text, at):
                depth, at = depth + 1, wrapped.end()
            elif depth:
                name = _KEY.match(text, at)
                if name is None or name[0] not in self.known:
                    break
                uses.append(name[0])
                at, wanted = name.end(), False
            else:
                names: list[str] = []
                if at >= self.run_end:
                    if (bare := _BARE.match(text, at)) is None:
                        if len(parts) == 1 and not literals and not uses:
                            self.below(at, literals, uses)
                        break
                    self.run_end = bare.end()
                    self.last_digit = next((i for i in range(self.run_end - 1, at - 1, -1) if text[i].isdigit()), -1)
                    names = bare[0].split("+")
                if names and all(name in self.known for name in names):
                    uses += names
                elif not literals and not uses and self.last_digit >= at:
                    bare_end = self.run_end
                    while text[bare_end - 1] in ".:":
                        bare_end -= 1
                    literals.append((at, bare_end))
                at, wanted = self.run_end, False
        return parts, bare_end

    def names_before(self, at: int) -> list[str]:
        """Names before a target that are parted by commas, if a statement starts with them."""
        text, names = self.text, []
        while True:
            i = at
            while i and text[i - 1] in " \t":
                i -= 1
            if not names and (not i or text[i - 1] != ","):
                return []
            if not i or text[i - 1] != ",":
                return names[::-1] if not i or text[i - 1] in "\n;{" or _STATEMENT.search(text, max(0, at - 8), at) else []
            i -= 1
            while i and text[i - 1] in " \t":
                i -= 1
            end = i
            while i and (text[i - 1].isalnum() or text[i - 1] in "_."):
                i -= 1
            if i == end:
                return []
            names.append(text[i:end])
            at = i


def _called(name: str, plain: frozenset[str]) -> str | None:
    """What a call sets, by its name; None if it sets nothing."""
    last = name.rsplit(".", 1)[-1]
    if setter := _SETTER.match(last):
        return last[setter.end() :]
    return last if "." in name and last.replace("_", "").lower() in plain else None


def pairs(text: str, rate: Callable[[str], float], plain: frozenset[str] = frozenset()) -> Iterator[Pair]:
    """Pairs in order.  Assignments within the bare value of a target that ``rate`` rates above 0 are part of that value; ``plain``: names of calls that set what they are called."""
    reader, covered = _Reader(text), 0
    for m in _START.finditer(text):
        if m.start() < covered:
            continue
        if m["call"]:
            name = m["key"] or _called(m["call"], plain)
            if name:
                ((literals, uses), *_), _ = reader.value(m.end()) if text[m.end() - 1] == "," else reader.value(m.end() - 1)
                whole = [(a, b) for a, b in literals if not any(c.isspace() for c in text[a:b])]
                if whole or uses:
                    yield Pair((name,), name, whole, uses)
            continue
        name = m["name"] or m["directive"] or m["flag"]
        keys = tuple(_KEY.findall(m["keys"] or ""))
        others = reader.names_before(m.start()) if m["sign"] in ("=", ":=") and not keys else []
        parts, bare_end = reader.value(m.end(), several=bool(others))
        targets = [(other,) for other in others] + [(name, *keys)]
        if len(parts) != len(targets) or not others:
            parts = [([x for a, _ in parts for x in a], [x for _, b in parts for x in b])]
            targets = [tuple(n for t in targets for n in t)]
        for names, (literals, uses) in zip(targets, parts, strict=True):
            if literals or uses:
                known_as = names[0] if len(names) == 1 else name + (m["keys"] or "")
                reader.known.add(known_as)
                if bare_end and max(map(rate, names)) > 0:
                    covered = bare_end
                yield Pair(names, known_as, literals, uses)


def elements(text: str) -> Iterator[tuple[str, Place]]:
    """Names and the places of their literals in markup."""
    for m in _TAG.finditer(text):
        named, valued = [], []
        for a in _ATTRIBUTE.finditer(text, *m.span("attributes")):
            at = a.span("double") if a["double"] is not None else a.span("single")
            (named if a["name"].lower() in NAMING else valued if a["name"].lower() in VALUED else []).append(at)
        if m["text"]:
            yield m["tag"], m.span("text")
            valued.append(m.span("text"))
        yield from ((text[slice(*n)], v) for n in named for v in valued)
