"""Chat formatting (operator 8): quotation linking.

A line that begins with `>` marks is quoted; the number of marks is its level.
Neighbouring lines of one level are a passage. A message's own text is what is
left without quoted lines and without the line that announces a quotation
(ending in a colon, directly above it).

Passages and own texts are normalised (lower case, white space as one space)
and hashed; a message is known by its whole own text and by each of its
paragraphs. It is known as well by each of its runs of lines and of sentences
as long as some passage (or paragraph of one) quoted in the conversation, so a trimmed quotation
and one of a part between two quotations are found. Hashes of runs are differences
of running hashes of the pieces, so a run costs the same however long it is. A passage joins the first message of the conversation that has
that text and came before. A message replies to the latest message whose
passage it quotes at level 1, or else at its lowest linked level. Following
replies up gives the thread; a conversation in the order (thread, turn) has
every message after the one it answers.

Messages with a `>` are parsed first; own texts are hashed only in
conversations that quote at all. A text that is repeated many times is one key
with its first turn before the join, and keys that very many passages have are
sent to the workers, so equal messages never meet each other; no conversation
is collected. What is collected of one are the different lengths of its
passages, of which a text of n pieces in all has fewer than the root of 2n.

Cases. Null text is an empty message without quotes. Without conv_id or turn a
message stays, alone and unlinked. Repeated rows stay and get equal results.
Messages without quotes reply to none and are threads of their own. An
empty table gives an empty one; other columns are ignored. Very long texts take memory
in proportion to their length. Ties
cannot arise: the first turn of a text is unique. Very deep reply chains take
a number of steps that is the logarithm of their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin.operators.lookup import heavy_light_lookup
from leadkin.session import cut

_MARKS = re.compile(r"\s*((?:>[ \t]?)+)(.*)", re.S)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def normalised(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def key(text: str) -> str:
    return hashlib.md5(normalised(text).encode()).hexdigest()


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, passages as (level, text)) of a message."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if level != before:
                passages.append((level, []))
                if not before and own and own[-1].rstrip().endswith(":"):
                    own.pop()
            passages[-1][1].append(m[2])
        else:
            own.append(line)
        before = level
    whole = "\n".join(own)
    return (whole.strip("\n") if passages else whole), [(level, "\n".join(lines)) for level, lines in passages]


def units(text: str) -> list[str]:
    """Keys under which a text can be found: itself and its paragraphs."""
    return list(dict.fromkeys(key(t) for t in [text, *_PARAGRAPH.split(text)] if normalised(t)))


def pieces(text: str) -> dict[str, list[str]]:
    """Normalised lines and sentences of a text, in order, without blank ones."""
    split = {"lines": text.split("\n"), "sentences": _SENTENCE.split(normalised(text))}
    return {kind: [t for t in map(normalised, parts) if t] for kind, parts in split.items()}


class Running:
    """Hashes of all runs of some pieces: sums of the pieces' hashes times powers of a base, modulo a prime."""

    PRIME = (1 << 127) - 1
    BASE = int.from_bytes(hashlib.md5(b"base").digest(), "big") % PRIME

    def __init__(self, parts: list[str]):
        self.sums = [0]
        for t in parts:
            value = int.from_bytes(hashlib.md5(t.encode()).digest(), "big")
            self.sums.append((self.sums[-1] * self.BASE + value) % self.PRIME)

    def of(self, n: int) -> Iterator[int]:
        """Hash of every run of n pieces."""
        power = pow(self.BASE, n, self.PRIME)
        return ((high - low * power) % self.PRIME for low, high in zip(self.sums, self.sums[n:]))


def run_key(kind: str, n: int, value: int) -> str:
    return f"{kind} {n} {value:032x}"


def asked(text: str) -> list[tuple[str | None, int, str]]:
    """What a passage can be found by: (null, 0, key) for it and its paragraphs, (kind, pieces, key) as runs."""
    found = dict.fromkeys((None, 0, k) for k in units(text))
    for t in [text, *_PARAGRAPH.split(text)]:
        for kind, parts in pieces(t).items():
            if parts:
                found[kind, len(parts), run_key(kind, len(parts), Running(parts).sums[-1])] = None
    return list(found)


def told(text: str, lengths: list[tuple[str, int]]) -> set[str]:
    """Keys an own text is known by, runs only of the lengths asked for."""
    found = set(units(text))
    split = pieces(text)
    running = {kind: Running(split[kind]) for kind in {kind for kind, _ in lengths}}
    for kind, n in lengths:
        if n <= len(split[kind]):
            found.update(run_key(kind, n, value) for value in running[kind].of(n))
    return found


def _slim(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def _flat(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: Callable[[dict], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """Any number of rows for each row, written in batches of bounded size."""
    waiting: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            for out in rows(row):
                waiting.append(out)
                if len(waiting) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
                    waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


_PASSAGE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("kind", pa.string()), ("n", pa.int32()), ("key", pa.string())])
_TOLD = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("key", pa.string())])


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind, n, key of everything that quoted passages can be found by."""

    def rows(row: dict) -> Iterator[tuple]:
        for level, text in parse(row["text"])[1]:
            for kind, n, k in asked(text):
                yield row["conv_id"], row["turn"], level, kind, n, k

    quoting = messages.filter(F.contains("text", F.lit(">")) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return quoting.select("conv_id", "turn", "text").mapInArrow(lambda b: _flat(b, _PASSAGE, rows), "conv_id long, turn long, level int, kind string, n int, key string")


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to for messages that quote an earlier one."""
    quoted = cut(passages(messages))
    lengths = quoted.groupBy("conv_id").agg(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))).alias("lengths"))

    def rows(row: dict) -> Iterator[tuple]:
        for k in told(parse(row["text"] or "")[0], [(x["kind"], x["n"]) for x in row["lengths"]]):
            yield row["conv_id"], row["turn"], k

    own = messages.filter("turn is not null").select("conv_id", "turn", "text").join(lengths, "conv_id")
    known = own.mapInArrow(lambda b: _flat(b, _TOLD, rows), "conv_id long, turn long, key string")
    first = known.groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    wanted = quoted.groupBy("conv_id", "key").agg(F.count("*").alias("n_asked"))
    found = cut(wanted.join(first, ["conv_id", "key"]))
    total = found.agg(F.sum("n_asked")).first()[0] or 0
    probe = quoted.select("conv_id", "turn", "level", "key")
    linked = heavy_light_lookup(probe, found, ["conv_id", "key"], "n_asked", total, F.xxhash64("conv_id", "turn", "key")).filter("source < turn")
    # lowest level first, then the latest source
    return linked.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("nearest"), "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (first turn of the chain of replies), steps (its length)."""
    now = cut(links.withColumns({"thread": F.col("reply_to"), "steps": F.lit(1)}))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("next"), F.col("steps").alias("more"))
        joined = now.join(up, (now.conv_id == up.c) & (now.thread == up.t), "left")
        longer = cut(
            joined.select(
                "conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"),
            )
        )
        now = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            return now


def _without_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content (own text), n_quotes, depth of every message."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("n_quotes", pa.int32()), ("depth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t) if t and ">" in t else (t or "", []) for t in batch.column(3).to_pylist()]
            own = [pa.array([o for o, _ in found], type=pa.string()), pa.array([len(p) for _, p in found], type=pa.int32())]
            depth = pa.array([max([level for level, _ in p], default=0) for _, p in found], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own, depth], schema=schema)

    return messages.mapInArrow(run, "conv_id long, turn long, role string, content string, n_quotes int, depth int")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, content without quotes, reply_to, thread, steps, n_quotes, depth."""
    slim = _slim(messages)
    found = threads(replies(slim))
    joined = _without_quotes(slim).join(found, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "content", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("steps", F.lit(0)).alias("steps"), "n_quotes", "depth",
    )
