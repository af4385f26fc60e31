"""Token counts (operator 6): a transducer that emits the number of tokens.

State. After some letters of a word, the state holds, for every place at which
a token may still be open, the letters read since then (a node of the token
tree), the last token before that place and its count relative to now. Equal
states are one state, so the machine is deterministic. A transition reads one
letter, finds the one token that may end there, and emits by how much the
count of tokens changes. States are compiled when first reached, and at most
LIMIT are kept. Whole words, as loops from the start state to itself, are
remembered with what they emit, in bounded caches.

Chunks. A text is cut into chunks of a fixed size. White space leads every
state back to the start, so the map from the state before a chunk to the state
and count after it is given by the letters before its first white space, the
count between, and the letters after its last. Such maps compose, and a
parallel prefix scan (a tree of doublings) gives the count up to every chunk:
the last one is the count of the text, and a search among them says how many
whole chunks fit the limit. Where unusual characters have to be prepared by the
library, chunks are runs of whole words of the same size, which begin and end in the start
state; a special token is a chunk of its own that adds one. All chunks of a
text go through one scan.

Cases. Null text is empty: no bytes, no tokens. Special tokens inside a text
count one each. Repeated rows give repeated results, an empty table an empty
one; other columns are ignored. Everything stays in the map task of the row.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from leadkin.llm.common import Kept, per_text, texts
from leadkin.llm.vocab import Compatible, Vocabulary, opened, sent

CHUNK = 8192
TOKEN_LIMIT = 2048


class Transducer:
    LIMIT = 50_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.compatible = Compatible(vocabulary)
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        for token, string in vocabulary.strings.items():
            node = 0
            for letter in string:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][letter]
            self.token[node] = token
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.numbers = {start: 0}
        self.items = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _compile(self, state: int, letter: str) -> tuple[int, int]:
        """(next state, emitted count)."""
        still, found = [], None
        for node, before, count in self.items[state]:
            node = self.children[node].get(letter, -1)
            if node < 0:
                continue
            token = self.token[node]
            if token >= 0 and found is None and (before < 0 or self.compatible(before, token)):
                found = (token, count + 1)
            if self.children[node]:
                still.append((node, before, count))
        token, emitted = found
        key = (*[(node, before, count - emitted) for node, before, count in still], (0, token, 0))
        if key not in self.numbers:
            self.numbers[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
        move = self.moves[state][letter] = (self.numbers[key], emitted)
        return move

    def count(self, word: str) -> int:
        """Tokens of one word: the sum of what its letters emit."""
        if len(self.items) > self.LIMIT:
            self._reset()
        state, total = 0, 0
        for letter in word:
            move = self.moves[state].get(letter) or self._compile(state, letter)
            state = move[0]
            total += move[1]
        return total


class Map(NamedTuple):
    """What a chunk does: letters before its first white space, tokens between, letters after the last.

    Without white space there is only a head and `count` is None.
    """

    head: str
    count: int | None
    tail: str


class Counter:
    LIMIT = 100_000

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK):
        self.vocabulary, self.chunk = vocabulary, chunk
        self.machine = Transducer(vocabulary)
        self.words = Kept(self.machine.count, self.LIMIT)
        self.parts = Kept(lambda part: sum([self.words[w] for w in vocabulary.words(part)]), self.LIMIT)

    def map_of(self, chunk: str) -> Map:
        parts = chunk.split()
        open_left, open_right = not chunk[:1].isspace(), not chunk[-1:].isspace()
        if len(parts) == 1 and open_left and open_right:
            return Map(chunk, None, "")
        head = parts[0] if parts and open_left else ""
        tail = parts[-1] if parts and open_right else ""
        inner = parts[open_left : len(parts) - open_right] if parts else []
        return Map(head, sum(map(self.parts.__getitem__, inner)), tail)

    def compose(self, a: Map, b: Map) -> Map:
        if a.count is None:
            return Map(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return Map(a.head, a.count, a.tail + b.head)
        between = a.tail + b.head
        return Map(a.head, a.count + (self.parts[between] if between else 0) + b.count, b.tail)

    def scan(self, maps: list[Map]) -> list[Map]:
        """Map of the text up to and including each chunk, by doubling steps."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, m: Map) -> int:
        return (self.parts[m.head] if m.head else 0) + (m.count or 0) + (self.parts[m.tail] if m.tail else 0)

    def maps(self, text: str) -> list[Map]:
        """The maps of all chunks of a text, in order."""
        v, out = self.vocabulary, []
        for segment in v.segments(text):
            if segment in v.special:
                out.append(Map("", 1, ""))
            elif (plain := v.lowered(segment)) is not None:
                out += [self.map_of(plain[i : i + self.chunk]) for i in range(0, len(plain), self.chunk)]
            else:
                out += self.maps_of_words(v.library_words(segment))
        return out

    def maps_of_words(self, words: list[str]) -> Iterator[Map]:
        """Chunks of whole words; a word belongs to the chunk of the fixed size in which it ends."""
        through = list(itertools.accumulate(map(len, words)))
        at = 0
        while at < len(words):
            end = len(words) if through[-1] <= self.chunk else bisect.bisect_right(through, ((through[at] - 1) // self.chunk + 1) * self.chunk, at)
            yield Map("", sum(map(self.words.__getitem__, words[at:end])), "")
            at = end

    def ended(self, m: Map) -> int:
        """Tokens without those of an open end; never falls from one prefix to the next."""
        return 0 if m.count is None else m.count + (self.parts[m.head] if m.head else 0)

    def counted(self, text: str, limit: int) -> tuple[int, int, int]:
        """Tokens, chunks, and how many chunks from the first on have at most `limit` tokens together."""
        through = self.scan(self.maps(text))
        total = self.total(through[-1]) if through else 0
        within = len(through) if total <= limit else bisect.bisect_right(through, limit, hi=len(through) - 1, key=self.ended)
        return total, len(through), within

    def count(self, text: str) -> int:
        return self.counted(text, TOKEN_LIMIT)[0]


@functools.lru_cache(maxsize=2)
def counter(raw: bytes) -> Counter:
    return Counter(opened(raw))


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, chunks_within for every whole text.

    `chunks_within` chunks from the first on have at most `limit` tokens; what is still
    open at the end of a chunk counts when it has ended.
    """
    file = sent(docs.sparkSession, path)

    def rows():
        tool = counter(file.value)

        def each(text: str) -> tuple:
            n, chunks, within = tool.counted(text, limit)
            return len(text.encode()), n, n > limit, chunks, within

        return each

    return per_text(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, chunks_within long", rows)
