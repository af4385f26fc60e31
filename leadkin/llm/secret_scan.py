"""Secret scans (operator 11): fixed patterns propose spans, the cost of guessing a value confirms others.

Base kinds (assign, access, hex) follow a fixed contract: leftmost matches
without overlap per kind, and a match that is too short is dropped without
another try. The method adds the kind `guess`: a value that stands where
credentials stand (after a word for one and a sign or verb, after `bearer`, or between user
and host of an address) and is dear to guess.

Guess cost is the least sum, in powers of ten, over all ways to cut a value
into segments, found by dynamic programming from left to right. Segments are
words (the cost is the place in a public word list, plus capitals and
stand-in signs as 0 for o), dates and years, repeats of a unit, walks over
neighbouring keys or along the alphabet or digits, and stretches that must be tried out sign by sign. Every
segment adds SEGMENT. So `password1234` or `qwertz2019` is cheap and
`x9K#qP2!` is not. Values of letters only, which may be ordinary text, need
LETTERS, others THRESHOLD. Base spans are kept whatever they cost.

The words are those of a public tokenizer's vocabulary, in its order, which goes by
frequency; its file is a parameter, read once by the driver (a few megabytes, fixed).

Cases. Null text is empty and has no spans. Repeated rows give repeated
results; an empty table gives an empty one; other columns are ignored. Work per
text is in proportion to its length, also for very long values: every segment
kind has a bounded number of ends for each start.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from math import log10
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import per_text, texts

KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]
THRESHOLD = 9.0
LETTERS = 14.0
SEGMENT = 0.5
LEAST_WORD = 3
LONGEST_UNIT = 8

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

# Words that credentials stand after, and verbs between the two.
_NAMES = (
    "passphrase", "passcode", "password", "passwort", "passwd", "pass", "pwd", "kennwort", "secret", "token", "api[ _-]?key",
    "access[ _-]?key", "private[ _-]?key", "credentials?", "authorization", "login", "pin", "contraseña", "clave", "mot de passe", "identifiant",
)
_VERBS = ("is", "was", "ist", "lautet", "es", "est")
_VALUE = r"""[^\s"'`<>|,;()\[\]{}]{6,}"""
_CONTEXT = re.compile(
    rf"""(?<![a-z])(?:(?:{"|".join(_NAMES)})["']?(?:[ \t]*+(?::=|=>|->|[:=])[ \t]*+|[ \t]++(?:{"|".join(_VERBS)})(?:[ \t]*+:)?[ \t]++)(?:bearer[ \t]++)?|bearer[ \t]++)["'`]?({_VALUE})""",
    re.I,
)
_IN_ADDRESS = re.compile(r"://[^\s:/@]{1,256}+:([^\s:/@]{6,}+)@")

_DATE = re.compile(
    r"(?:(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)?[0-9]{2}))"
)
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
_DATE_COST, _SIGNS_COST, _YEAR_COST = log10(365 * 150), log10(4), log10(150)

# Keys as they lie, each row half a key further right.
_KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_CAPITAL, _STAND_IN = log10(2), log10(3)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    cost: float | None


def _neighbours() -> dict[str, str]:
    """Key to the keys around it, with the direction as place in the string."""
    place = {key: (r, c) for r, row in enumerate(_KEY_ROWS) for c, key in enumerate(row)}
    at = {p: key for key, p in place.items()}
    around = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    return {key: "".join(at.get((r + dr, c + dc), "\0") for dr, dc in around) for key, (r, c) in place.items()}


_AROUND = _neighbours()


def _sign_cost(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class Guesses:
    """Costs of values, with a word list in the order of frequency."""

    def __init__(self, words: list[str]):
        self.rank = {w: log10(i + 1) for i, w in reversed(list(enumerate(words, 1)))}
        self.longest = max(map(len, self.rank), default=0)

    def _words(self, value: str, plain: str, i: int) -> Iterator[tuple[int, float]]:
        capitals = stand_ins = 0
        for j in range(i, min(len(value), i + self.longest)):
            capitals += value[j].isupper()
            stand_ins += plain[j] != value[j].lower()
            if not plain[j].isalpha():
                return
            if j - i + 1 >= LEAST_WORD and plain[i : j + 1] in self.rank:
                # one capital in front, or capitals only, is one choice of two
                choices = 1 if capitals == j - i + 1 or (capitals == 1 and value[i].isupper()) else capitals
                yield j + 1, self.rank[plain[i : j + 1]] + choices * _CAPITAL + stand_ins * _STAND_IN

    @staticmethod
    def _dates(value: str, i: int) -> Iterator[tuple[int, float]]:
        if value[i].isdigit():
            if m := _DATE.match(value, i):
                yield m.end(), _DATE_COST + _SIGNS_COST * bool(m[1] or m[2])
            if m := _YEAR.match(value, i):
                yield m.end(), _YEAR_COST

    @staticmethod
    def _repeats(value: str) -> list[list[tuple[int, float]]]:
        """Per start: ends of a unit's repeats, as far as they go."""
        n = len(value)
        prices = [0.0]
        for c in value:
            prices.append(prices[-1] + _sign_cost(c))
        found: list[list[tuple[int, float]]] = [[] for _ in value]
        for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
            same = 0
            for i in range(n - unit - 1, -1, -1):
                same = same + 1 if value[i] == value[i + unit] else 0
                times = 1 + same // unit
                if times >= (3 if unit == 1 else 2):
                    found[i].append((i + unit * times, prices[i + unit] - prices[i] + log10(times)))
        return found

    @staticmethod
    def _walks(lowered: str) -> list[tuple[int, float] | None]:
        """Per start: the end of the walk from there on, if it takes three keys or more."""
        n = len(lowered)
        ways: list[str] = []
        for a, b in zip(lowered, lowered[1:]):
            step = ord(b) - ord(a)
            if step in (1, -1) and a.isalnum() and b.isalnum():
                ways.append("up" if step > 0 else "down")
            else:
                d = _AROUND.get(a, "").find(b)
                ways.append(f"key {d}" if d >= 0 else "")
        found: list[tuple[int, float] | None] = [None] * n
        end, turns = n, 0
        for i in range(n - 2, -1, -1):
            if not ways[i]:
                end, turns = i + 1, 0
                continue
            if i + 2 < n and ways[i + 1] and ways[i + 1] != ways[i]:
                turns += 1
            if end - i >= 3:
                found[i] = (end, log10(len(_AROUND)) + log10(end - i) + turns * log10(len("lrudab")))
        return found

    def cut(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """Least cost, and the segments (start, end, kind) that it is the cost of."""
        n = len(value)
        lowered = value.lower() if len(value.lower()) == n else value
        plain = "".join([_STANDS_FOR.get(c, c) for c in lowered])
        repeats, walks = self._repeats(value), self._walks(lowered)
        far = float("inf")
        # best cost up to each place: with any last segment, and with one that is tried out sign by sign
        best, tried = [0.0] + [far] * n, [far] * (n + 1)
        came: list[tuple[int, str]] = [(0, "")] * (n + 1)
        began = [0] * (n + 1)
        for i in range(n):
            if tried[i] < best[i]:
                best[i], came[i] = tried[i], (began[i], "tried")
            ends = [(j, c, "word") for j, c in self._words(value, plain, i)] + [(j, c, "date") for j, c in self._dates(value, i)]
            ends += [(j, c, "repeat") for j, c in repeats[i]]
            if walk := walks[i]:
                ends.append((*walk, "walk"))
            for j, cost, kind in ends:
                if best[i] + cost + SEGMENT < best[j]:
                    best[j], came[j] = best[i] + cost + SEGMENT, (i, kind)
            price = _sign_cost(value[i])
            fresh, on = best[i] + SEGMENT + price, tried[i] + price
            tried[i + 1], began[i + 1] = (on, began[i]) if on <= fresh else (fresh, i)
        if tried[n] < best[n]:
            best[n], came[n] = tried[n], (began[n], "tried")
        segments, j = [], n
        while j > 0:
            i, kind = came[j]
            segments.append((i, j, kind))
            j = i
        return best[n], segments[::-1]

    def cost(self, value: str) -> float:
        return self.cut(value)[0]


@functools.lru_cache(maxsize=2)
def guesses(raw: bytes) -> Guesses:
    """From the bytes of a tokenizer file: its tokens that are whole words, in the order of their numbers."""
    spec = json.loads(raw)["model"]
    ending = spec.get("end_of_word_suffix") or ""
    ordered = sorted(spec["vocab"], key=spec["vocab"].get)
    words = [t[: len(t) - len(ending)] for t in ordered if t.endswith(ending)]
    return Guesses([w for w in words if len(w) >= LEAST_WORD and w.isascii() and w.isalpha()])


def assigned(text: str) -> Iterator[tuple[int, int]]:
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            yield m.span()


FINDERS = {"assign": assigned, "access": lambda text: (m.span() for m in _ACCESS.finditer(text)), "hex": lambda text: (m.span() for m in _HEX.finditer(text))}


def credentials(text: str) -> list[tuple[int, int]]:
    """Places of values that stand where credentials stand; a point or the like behind one is not part of it."""
    found = set()
    for pattern in (_CONTEXT, _IN_ADDRESS) if "://" in text else (_CONTEXT,):
        for m in pattern.finditer(text):
            value = m[1].rstrip(".:!?")
            if len(value) >= 6:
                found.add((m.start(1), m.start(1) + len(value)))
    return sorted(found)


def dear(value: str, cost: float) -> bool:
    return cost >= (LETTERS if value.isalpha() else THRESHOLD)


def spans(text: str, costs: Guesses) -> list[Span]:
    """All spans of a text by start, then by kind in the order of KINDS."""
    found = [Span(kind, a, b, None) for kind in BASE for a, b in FINDERS[kind](text)]
    for a, b in credentials(text):
        cost = costs.cost(text[a:b])
        if dear(text[a:b], cost):
            found.append(Span("guess", a, b, round(cost, 3)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def written(found: list[Span]) -> str:
    return ",".join([f"{s.kind}:{s.start}:{s.end}" for s in found])


def find(docs: DataFrame, path: str) -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points, end exclusive), cost (powers of ten; guess only), value."""
    with open(path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def rows():
        costs = guesses(raw.value)
        return lambda text: ([f"{s.kind}\x1f{s.start}\x1f{s.end}\x1f{'' if s.cost is None else s.cost}\x1f{text[s.start : s.end]}" for s in spans(text, costs)],)

    packed = per_text(texts(docs), "doc_id long, found array<string>", rows)
    parts = F.split("one", "\x1f", 5)
    return packed.select("doc_id", F.explode("found").alias("one")).select(
        "doc_id", parts[0].alias("kind"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"),
        F.when(parts[3] != "", parts[3]).cast("double").alias("cost"), parts[4].alias("value"),
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, for every whole text."""
    with open(path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def rows():
        costs = guesses(raw.value)

        def each(text: str) -> tuple:
            found = spans(text, costs)
            base = [s for s in found if s.kind in BASE]
            counts = [sum(s.kind == k for s in base) for k in BASE]
            return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(found))

        return each

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return per_text(texts(docs), schema, rows)
