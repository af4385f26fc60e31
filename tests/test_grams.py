"""Grams as whole numbers against plain counts of strings."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadkin import fixed
from leadkin.functions import grams
from leadkin.operators import tfidf


def letters(g: grams.Grams, i: int) -> str:
    size = grams.SIZES[g.kind % len(grams.SIZES)]
    code, last = int(g.code[i]) % (1 << 64), int(g.last[i])
    if last:
        return "".join(chr(code >> 21 * k & 0x1FFFFF) for k in range(3)) + chr(last - 1)
    bits = 21 if size < 4 else 16
    return "".join(chr(code >> bits * k & (1 << bits) - 1) for k in range(size))


def plain(text: str) -> Counter:
    return Counter(text[i : i + n] for n in fixed.GRAM_SIZES for i in range(len(text) - n + 1))


ODD = st.text(alphabet="ab\0￿￾臺灣😀😁\U0010ffff", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD), max_size=8))
def test_every_gram_comes_back(texts):
    got = defaultdict(Counter)
    for g in grams.grams(texts, 2):
        assert g.kind // len(grams.SIZES) == 2
        for k, row, tf in zip(g.gram, g.row, g.tf):
            got[int(row)][letters(g, k)] += int(tf)
    assert {i: c for i, t in enumerate(texts) if (c := plain(t or ""))} == dict(got)


def test_pieces_keep_rows_and_bound_letters(monkeypatch):
    monkeypatch.setattr(tfidf, "_LETTERS", 10)
    texts = ["abc", None, "d" * 25, "", "efghij", "klmno", "p"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    parts = [p.column(0).to_pylist() for p in tfidf._pieces([batch])]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in parts)


TEXTS = [(1, "abab😀ab cd", "x"), (2, "臺灣點心😀😀", None), (3, None, "xyz xyz"), (4, "", "q"), (5, "abab😀ab cd", "")]


@pytest.mark.parametrize("held", [500_000, 3])
def test_document_counts(spark, monkeypatch, held):
    """Sums over the tasks' rows are the number of texts with a gram, also if a task hands on early."""
    monkeypatch.setattr(tfidf, "_HELD", held)
    docs = spark.createDataFrame(TEXTS, "id long, a string, b string").repartition(2)
    got = Counter()
    for r in tfidf.document_counts(docs, ["a", "b"]).collect():
        g = grams.Grams(r.kind, np.array([r.code]), np.array([r["last"]]), *[np.zeros(1)] * 3)
        got[r.kind // len(grams.SIZES), letters(g, 0)] += r.df
    want = Counter()
    for _, a, b in TEXTS:
        for field, text in enumerate((a, b)):
            want.update((field, g) for g in plain(text or ""))
    assert got == want


def test_sent_vocabulary_and_grams_as_rows_agree(spark):
    docs = spark.createDataFrame(TEXTS, "id long, a string, b string")
    words = tfidf.vocabulary_of(docs, docs.filter("id > 1"), ["a", "b"], 9)
    ways = [tfidf.with_vectors(docs, ["a", "b"], words, sent).collect() for sent in (10_000, 0)]
    for field in "ab":
        here, rows = ({r.id: dict(zip(r[f"g_{field}"], r[f"w_{field}"])) for r in way} for way in ways)
        assert here.keys() == rows.keys() == {1, 2, 3, 4, 5}
        for i in here:
            assert here[i].keys() == rows[i].keys() and np.allclose(list(here[i].values()), [rows[i][k] for k in here[i]])
    assert here[3] and not here[5]


def test_no_texts(spark):
    docs = spark.createDataFrame([], "id long, a string")
    words = tfidf.vocabulary_of(docs, docs, ["a"], 0)
    assert words.count() == 0
    assert tfidf.with_vectors(docs, ["a"], words).columns == ["id", "g_a", "w_a"]
    some = spark.createDataFrame([(1, "abc")], "id long, a string")
    assert [tuple(r) for r in tfidf.with_vectors(some, ["a"], words).collect()] == [(1, [], [])]
