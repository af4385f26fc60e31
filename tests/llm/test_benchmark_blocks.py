"""A benchmark in several blocks gives what it gives in one; a full block fits a worker."""

import os
import random
import subprocess
import sys

from leadkin.llm import decontamination as d


def _tables(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choices([f"w{i}" for i in range(40)], k=n))
    items = [(f"i{k}", text(r.randint(0, 30))) for k in range(60)] + [("i1", text(12)), (None, "w1"), ("n", None), ("short", "w1 w2")]
    docs = [(i, f"{text(r.randint(0, 50))} {r.choice(items)[1] or ''} {text(5)}", "x") for i in range(300)] + [(1, None, "y"), (None, "w1 w2", "z"), (5, "", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(3), spark.createDataFrame(items, "item_id string, text string")


def test_blocks_by_words_change_nothing(spark, monkeypatch):
    docs, items = _tables(spark)
    assert len(d._blocks(items)) == 1 and len(d._blocks(items, block_words=100)) > 5
    rows = lambda df: sorted(map(str, df.collect()))
    one = rows(d.search(docs, items))
    assert rows(d.search(docs, items, block_words=100)) == one
    assert rows(d.clean(docs, items, block_words=100)) == rows(d.clean(docs, items))
    assert d.clean(docs, items).columns == docs.columns
    whole = rows(d.matches(docs, items))
    blocks = d._blocks
    monkeypatch.setattr(d, "_blocks", lambda benchmark, *a, **k: blocks(benchmark, block_words=100))
    assert rows(d.matches(docs, items)) == whole


def test_a_block_is_opened_once_for_many_shards(monkeypatch):
    made = []
    monkeypatch.setattr(d, "SHARD_WORDS", 50)
    monkeypatch.setattr(d._Opened, "_compiled", lambda self, block: made.append(block) or d.Benchmark(block, self.window))
    opened = d._Opened([[("a", "x y z")], [("b", "y z w")]], 10)
    found = list(d._searched(["x y z w " * 40, "p q", None] * 5, opened))
    assert len(made) == 2 and [f[:2] for f in found] == [(160, 160), (2, 0), (0, 0)] * 5 and found[0][2] == {"a", "b"}


def test_memory_of_a_full_block():
    """A block of as many words as there may be, half of them different, searched in its own process."""
    code = """
import random, resource, sys
sys.path.insert(0, ROOT)
from leadkin.llm import decontamination as d
r = random.Random(1)
words = [f"word{i}" for i in range(d.BLOCK_WORDS // 2)]

items = [(str(i), " ".join(r.choices(words, k=1024))) for i in range(d.BLOCK_WORDS // 1024)]
b = d.Benchmark(items)
mask, _ = d.Shard([d.words(items[3][1])], b).hits()
assert mask.sum() == 1024
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code.replace("ROOT", repr(root))], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500, out.stdout
