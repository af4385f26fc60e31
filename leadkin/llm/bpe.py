"""BPE encoding and decoding (operator 3): backtracking over longest matches.

Encoding. An Aho-Corasick automaton of all tokens gives, in one pass over a
word, every token at every place. The encoder takes the longest token that is
compatible with the one before it; if none is, it goes back one token and
notes the place, so no place is left twice. A sequence in which all
neighbours are compatible is the only one, and is what the merges give. Words,
and parts between white space, are looked up in bounded caches first.

Decoding. All token strings stand in one block of bytes, each followed by the
separator; an offset table gives their places, and a whole sequence of ids is
gathered at once.

Cases. Null text is empty and has no tokens. Special tokens inside a text
become their own ids. Repeated rows give repeated results; an empty table
gives an empty one; other columns are ignored. A word of any length is encoded.
Everything happens inside the map task of a row, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from leadkin.llm.common import Kept, per_text, texts
from leadkin.llm.vocab import Compatible, Vocabulary, opened, sent

_COMMON = re.compile("[a-z]*[a-z\u1061-\u107a]")


class Encoder:
    LIMIT = 100_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.compatible = Compatible(vocabulary)
        self.automaton = ahocorasick.Automaton()
        self.length = {i: len(s) for i, s in vocabulary.strings.items()}
        # the automaton looks through the branches of a node in the order of their coming: common letters first
        for token, string in sorted(vocabulary.strings.items(), key=lambda x: (not _COMMON.fullmatch(x[1]), x[0])):
            self.automaton.add_word(string, token)
        self.automaton.make_automaton()
        self.words = Kept(lambda word: np.array(self.word(word), dtype="<u4").tobytes(), self.LIMIT)
        self.parts = Kept(lambda part: b"".join([self.words[w] for w in vocabulary.words(part)]), self.LIMIT)

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        length, compatible, n = self.length, self.compatible, len(word)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(word):
            at[end - length[token] + 1].append(token)  # shorter tokens first
        taken: list[int] = []
        choice: list[int] = []
        closed: set[int] = set()
        place, k = 0, len(at[0]) - 1
        while place < n:
            here = at[place]
            while k >= 0:
                token = here[k]
                if place + length[token] not in closed and (not taken or compatible(taken[-1], token)):
                    break
                k -= 1
            if k >= 0:
                taken.append(token)
                choice.append(k)
                place += length[token]
                k = len(at[place]) - 1 if place < n else -1
            elif taken:
                closed.add(place)
                place -= length[taken.pop()]
                k = choice.pop() - 1
            else:
                raise ValueError(f"no encoding of {word!r}")
        return taken

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        v, out = self.vocabulary, []
        for segment in v.segments(text):
            if segment in v.special:
                out.append(v.special[segment].to_bytes(4, "little"))
            elif (plain := v.lowered(segment)) is not None:
                out += map(self.parts.__getitem__, plain.split())
            else:
                out += map(self.words.__getitem__, v.library_words(segment))
        return b"".join(out)


class Decoder:
    """Token strings in one block, with their offsets; the library joins tokens by a space here."""

    STEP = 1 << 18

    def __init__(self, vocabulary: Vocabulary):
        pieces = [(vocabulary.contents.get(i, "") + " ").encode() for i in range(vocabulary.size)]
        self.block = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        return b"".join(self._piece(ids[i : i + self.STEP]) for i in range(0, len(ids), self.STEP))[:-1]

    def _piece(self, ids: np.ndarray) -> bytes:
        start, end = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        lengths = end - start
        before = np.cumsum(lengths) - lengths
        return self.block[np.repeat(start - before, lengths) + np.arange(lengths.sum())].tobytes()


@functools.lru_cache(maxsize=2)
def tools(raw: bytes) -> tuple[Encoder, Decoder]:
    vocabulary = opened(raw)
    return Encoder(vocabulary), Decoder(vocabulary)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the tokens of every whole text."""
    file = sent(docs.sparkSession, path)

    def rows():
        encoder, _ = tools(file.value)
        return lambda text: (np.frombuffer(encoder.encode(text), dtype="<u4").astype(np.int32),)

    return per_text(texts(docs), "doc_id long, ids array<int>", rows)


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: count and digests of both, and on demand the ids."""
    file = sent(docs.sparkSession, path)

    def rows():
        encoder, decoder = tools(file.value)

        def each(text: str) -> tuple:
            raw = encoder.encode(text)
            ids = np.frombuffer(raw, dtype="<u4")
            out = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest())
            return (*out, ids.astype(np.int32)) if with_ids else out

        return each

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(texts(docs), schema + (", ids array<int>" if with_ids else ""), rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids are an empty text."""
    from collections.abc import Iterator

    import pyarrow as pa

    file = sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = tools(file.value)
        for batch in batches:
            out = [decoder.decode(np.array(ids or [], dtype=np.int64)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
