"""A public tokenizer file: its text preparation, pieces and merges.

The file is a parameter; the driver reads it once and sends its bytes (a few
megabytes, fixed) to the workers. Text preparation of ordinary Latin text is
done here; a text with any other character goes through the library's own
normaliser and splitter, so rare characters cannot make a difference.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import SparkSession

# Fixed values of the tokenizer's splitting rule, for characters up to U+017F.
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
# Control characters U+001C to U+001F split words in Python only.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-ſ‐-‧€]")
_SHIFT = 0x1000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    place = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}
    return [chr(place[b]) for b in range(256)]


class Vocabulary:
    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ending: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._letters = byte_letters()
        # a word as a string: one letter per byte, the last one shifted to mark the end of the word
        self.strings = {i: self._marked(s) for s, i in self.ids.items()}
        known = {s: i for i, s in self.strings.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(known[self._marked(a)], known[self._marked(b)], known[self._marked(a) + self._marked(b)]) for a, b in pairs]
        self.base = {s: i for s, i in known.items() if len(s) == 1}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.contents = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}

    def _marked(self, token: str) -> str:
        if self.ending and token.endswith(self.ending):
            token = token[: -len(self.ending)]
            return token[:-1] + chr(ord(token[-1]) + _SHIFT)
        return token

    def word(self, shown: str) -> str:
        """A word in stand-in letters as the string that tokens are matched against."""
        return shown[:-1] + chr(ord(shown[-1]) + _SHIFT) if self.ending else shown

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which are pieces of their own."""
        return [s for s in self._special.split(text) if s] if self._special and "<" in text else [text]

    def lowered(self, text: str) -> str | None:
        """Prepared text of which white space separates the words; None if it needs the library."""
        return None if _UNUSUAL.search(text) else text.lower()

    def words(self, part: str) -> list[str]:
        """The words of a prepared part without white space."""
        letters = self._letters
        return [
            self.word(piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()]))
            for piece in _PIECE.findall(part)
        ]

    def library_words(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        return [self.word(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Compatible:
    """Whether two tokens may stand side by side in an encoding.

    They may not if a merge across their border would come before one of them
    is complete. Only the parts at the border matter: the last parts of the
    left token and the first parts of the right one, each of which exists from
    its own merge until the merge that takes it in.
    """

    LIMIT = 150_000

    def __init__(self, vocabulary: Vocabulary):
        never = len(vocabulary.merges) + 1
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocabulary.merges)}
        made = {t: (a, b, r) for r, (a, b, t) in enumerate(vocabulary.merges)}
        self.never, self.made = never, made
        self.last: dict[int, list[tuple[int, int]]] = {}
        self.first: dict[int, list[tuple[int, int]]] = {}
        self.known: dict[int, bool] = {}

    def _border(self, token: int, side: int, cache: dict) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it in), smallest part first."""
        if token not in cache:
            parts, until = [], self.never
            part = token
            while True:
                parts.append((part, until))
                if part not in self.made:
                    break
                until, part = self.made[part][2], self.made[part][side]
            cache[token] = parts[::-1]
        return cache[token]

    def __call__(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            known = self.known[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        a, b = self._border(left, 1, self.last), self._border(right, 0, self.first)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.rank.get((x, y))
            # equal ranks are merged from left to right
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until == y_until == self.never:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


@functools.lru_cache(maxsize=4)
def opened(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def sent(spark: SparkSession, path: str):
    """The bytes of a tokenizer file as a broadcast."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())
