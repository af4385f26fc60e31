"""Keywords found in names by automata, against a plain search."""

import random

from leadkin.operators.resolve import containing


def _pairs(spark, words, names, **sizes):
    found = containing(spark.createDataFrame([(w,) for w in words], "keyword string"), spark.createDataFrame([(n,) for n in names], "name string"), **sizes)
    rows = [(r.keyword, r.name) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_every_keyword_in_every_name(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("ab星河𠀀 ", k=n))
    words = {text(r.randint(1, 5)) for _ in range(300)} | {""}
    names = {text(r.randint(1, 30)) for _ in range(300)} | {""}
    want = {(w, n) for w in words for n in names if w and w in n}
    assert _pairs(spark, words, names) == want
    # many blocks of keywords and parts of names
    assert _pairs(spark, words, names, block_chars=60, part_chars=400) == want


def test_one_gram_in_most_names(spark):
    names = [f"共同{i}號" if i % 10 else f"其他{i}號" for i in range(30_000)]
    got = _pairs(spark, ["共同", "共同77號", "他3"], names, part_chars=20_000)
    assert got == {("共同", n) for n in names if "共同" in n} | {("共同77號", "共同77號")} | {("他3", n) for n in names if "他3" in n}


def test_nothing_to_find(spark):
    assert _pairs(spark, [], ["a"]) == set() == _pairs(spark, ["a"], []) == _pairs(spark, [], []) == _pairs(spark, [""], ["a", ""])
