"""Chunks of a text against the library's counts of what has ended before them."""

import random

import pytest

from leadkin.llm import queries, token_counts, vocab

PLAIN = ["word", "unbelievable", "1234", "it's", "a-b"]
UNUSUAL = ["中文", "Σίσυφος", "😀😁", "ترجمة"]


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    with open(queries.word_bpe(), "rb") as file:
        raw = file.read()
    return Tokenizer.from_file(queries.word_bpe()), vocab.opened(raw)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_every_chunk_goes_through_one_scan(tools, chunk):
    library, vocabulary = tools
    counter = token_counts.Counter(vocabulary, chunk=chunk)
    r = random.Random(chunk)
    for words in (PLAIN, UNUSUAL, PLAIN + UNUSUAL, PLAIN + ["<|endoftext|>"], UNUSUAL + ["<|endoftext|>", "word<|endoftext|>"]):
        for _ in range(60):
            text = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
            want = len(library.encode(text, add_special_tokens=False).ids)
            through = counter.scan(counter.maps(text))
            ended = [counter.ended(m) for m in through]
            assert ended == sorted(ended)
            for limit in (0, want // 2, want - 1, want, want + 1):
                total, chunks, within = counter.counted(text, limit)
                assert (total, chunks) == (want, len(through))
                assert within == (chunks if want <= limit else sum(n <= limit for n in ended[:-1]))


def test_prefixes_of_plain_text(tools):
    """Up to every chunk the scan has the tokens of the white-space-separated words that have ended there."""
    library, vocabulary = tools
    counter = token_counts.Counter(vocabulary, chunk=9)
    text = " ".join(random.Random(1).choices(PLAIN, k=200))
    for i, m in enumerate(counter.scan(counter.maps(text))):
        before = text[: (i + 1) * 9]
        closed = before if before.endswith(" ") else before.rpartition(" ")[0]
        assert counter.ended(m) == len(library.encode(closed, add_special_tokens=False).ids)


def test_no_white_space_and_no_text(tools):
    library, vocabulary = tools
    counter = token_counts.Counter(vocabulary, chunk=50)
    for text in ("", " ", "x" * 20_000, "中" * 20_000):
        n = len(library.encode(text, add_special_tokens=False).ids)
        total, chunks, within = counter.counted(text, 10)
        assert total == n and within <= chunks and (within == chunks) == (n <= 10)
