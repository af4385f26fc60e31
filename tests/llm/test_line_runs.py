import collections
import random
import re

import corpus_pipeline
from leadkin.llm import line_dedup


def n_words(lines):
    return sum(len(re.findall("[^ \t]+", line)) for line in lines)


def brute_runs(docs):
    """Lines of every run of over 50 words, of any length, that stands at an earlier place as well."""
    lines = {d: t.split("\n") for d, t in docs}
    gone = collections.defaultdict(set)
    first = {}
    for d in sorted(lines):
        for a in range(len(lines[d])):
            for b in range(a + 1, len(lines[d]) + 1):
                run = tuple(lines[d][a:b])
                if n_words(run) > 50:
                    e, at = first.setdefault(run, (d, a))
                    if e != d or a >= at + len(run):
                        gone[d].update(range(a, b))
    return {d: "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in lines}


def test_repeated_runs_of_short_lines_go(spark):
    """Passages of short lines go whole, with their edges, one-line chunks and blank lines."""
    r = random.Random(9)
    line = lambda n: " ".join(r.choice("abcdefghijklmnop") * 3 + str(r.randint(0, 99)) for _ in range(n))
    shared = [[line(n) if r.random() < 0.85 else "" for _ in range(k)] for k, n in ((5, 11), (4, 13), (10, 10), (7, 14), (12, 9)) for _ in range(4)]
    docs = []
    for d in range(60):
        own = lambda: [line(r.randint(0, 12)) for _ in range(r.randint(0, 4))]
        docs.append((d, "\n".join([*own(), *r.choice(shared), *own(), *(r.choice(shared) if r.random() < 0.4 else []), *own()])))
    want = brute_runs(docs)
    chunk = 10**9  # no chunk ends inside a text, so only runs and whole texts are left to compare
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_runs(table, chunk)
    assert dict(got.collect()) == want
    left = collections.Counter(x for t in dict(line_dedup.dedup_runs(table).collect()).values() for x in t.split("\n") if x)
    assert set(left) == {x for _, t in docs for x in t.split("\n") if x}, "the first place of every line stays"
    assert all(left[x] <= 1 for p in shared for x in p if x and n_words(p) > 50)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
