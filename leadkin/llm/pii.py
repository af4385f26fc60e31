"""Personal data (operator 5): expressions propose spans, checksums confirm, context decides.

Base kinds (e-mail, ip, card, phone) follow a fixed contract: leftmost
matches without overlap per kind, and a match that fails its check is dropped
without another try. The method adds two kinds that need more than a pattern:
account numbers (iban: two letters, 15 to 34 signs and mod-97; a context word raises the
score) and social numbers (ssn: ranges that are never given out are refused;
without a context word near by the score stays below the threshold).

Every span has a score: what the pattern is worth, what a passed checksum
adds, and what words within CONTEXT characters add or take. Base spans are
always kept, whatever their score.

Cases. Null text is empty and has no spans. Repeated rows give repeated
results; an empty table gives an empty one; other columns are ignored. No
pattern goes over the same place more than a fixed number of times, so very
long texts take time in proportion. All work is in the map task of the row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.llm.common import per_text, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT = 40
THRESHOLD = 0.5

# What a kind is worth by itself, with its checksum, with a word of its own near by.
PATTERN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKSUM_SCORE = {"card": 0.5, "iban": 0.5}
CONTEXT_SCORE = 0.3
CONTEXT_WORDS = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "test", "example")
AGAINST_SCORE = -0.2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its start only: a match from inside would also match from there
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """International account number without spaces: letters count from 10, the first four stand last."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every domain with what stands before it, back to the last match at most."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield m.span()


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": social_numbers}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    words = {w.lower() for w in _WORD.findall(near)}
    points = PATTERN_SCORE[kind] + CHECKSUM_SCORE.get(kind, 0.0)
    points += CONTEXT_SCORE * bool(words & set(CONTEXT_WORDS[kind])) + AGAINST_SCORE * bool(words & set(AGAINST))
    return round(min(1.0, max(0.0, points)), 3)


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then by kind in the order of KINDS."""
    found = [Span(kind, a, b, score(text, kind, a, b)) for kind in KINDS for a, b in FINDERS[kind](text)]
    return sorted([s for s in found if s.kind in BASE or s.score >= THRESHOLD], key=lambda s: (s.start, KINDS.index(s.kind)))


def written(found: list[Span]) -> str:
    return ",".join([f"{s.kind}:{s.start}:{s.end}" for s in found])


def find(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points, end exclusive), score, value."""

    def rows():
        return lambda text: ([f"{s.kind}\x1f{s.start}\x1f{s.end}\x1f{s.score}\x1f{text[s.start : s.end]}" for s in spans(text)],)

    packed = per_text(texts(docs), "doc_id long, found array<string>", rows)
    parts = F.split("one", "\x1f")
    return packed.select("doc_id", F.explode("found").alias("one")).select(
        "doc_id", parts[0].alias("kind"), parts[1].cast("int").alias("start"), parts[2].cast("int").alias("end"),
        parts[3].cast("double").alias("score"), parts[4].alias("value"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, for every whole text."""

    def each(text: str) -> tuple:
        found = spans(text)
        base = [s for s in found if s.kind in BASE]
        counts = [sum(s.kind == k for s in base) for k in BASE]
        return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(found))

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return per_text(texts(docs), schema, lambda: each)
