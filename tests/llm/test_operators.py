import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadkin.llm import ann, bpe, decontamination, graph, language_id, line_dedup, pii, queries, quotes, simhash, token_counts, toxicity, vocab
from leadkin.llm.common import crc_mod, hash_share

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, TEXT2 string, print string, places string, a string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated and special texts, with extra columns that clash with names used inside."""
    texts = {
        1: None, 2: "", 3: "  \n\t ", 4: "Hello there, general text of some words here", 5: "hello there, general text of some words here",
        6: "word " * 60_000, 7: "x" * 50_000, 8: "one\ntwo\nthree\n\nfour", 9: "<|endoftext|> Ünï ² 'sure it's <|startoftext|>",
        10: "中文 Σ İ ​ \x1c é", 11: "a.b@c.de, +49 (30) 123-4567 and 4111 1111 1111 1111 or 1.2.3.4",
    }
    rows = [(i, t, None if i == 4 else "en", None, None, None, "z", None, None, None) for i, t in texts.items()]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_tokens_equal_the_library(spark, odd, documents, library):
    both = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = by_id(both)
    counts = by_id(token_counts.token_counts(both, queries.word_bpe()))
    digests = by_id(bpe.digests(both, queries.word_bpe()))
    assert len(texts) == len(counts) == len(digests)
    want = collections.Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, dtype="<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert collections.Counter(digests) == want
    assert collections.Counter((r[0], r[2]) for r in counts) == collections.Counter((i, n) for i, n, *_ in want.elements())
    assert all(r[3] == (r[2] > 2048) for r in counts)


def test_every_character_and_random_words(library):
    with open(queries.word_bpe(), "rb") as file:
        raw = file.read()
    encoder, _ = bpe.tools(raw)
    counter = token_counts.Counter(vocab.opened(raw), chunk=16)
    r = random.Random(5)
    letters = "abcdeéèüß'sdtrevml 0123²½ \n\t.,!?-—“”ΣÅşİı\x1c\x85\xa0​中"
    texts = [f"a{chr(i)}b {chr(i)}" for i in range(0x3000)] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, repr(text)
        assert counter.count(text) == len(ids), repr(text)


def test_encode_then_decode(spark, documents, library):
    encoded = bpe.encode(documents.limit(20), queries.word_bpe())
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for r in bpe.decode(encoded, queries.word_bpe()).collect():
        assert r.text == library.decode(ids[r.doc_id], skip_special_tokens=False)


def brute_pii(text):
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 9 <= len(digits) <= 15}
            if kind == "card":
                doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
                ok["card"] = 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
            if ok[kind]:
                found.append((m.start(), len(found) * 0 + pii.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_personal_data(spark, odd, documents):
    r = random.Random(3)
    made = ["".join(r.choice(["1", "23", "4111 1111 1111 1111", ".", "a", "@", "b.c", " ", "-", "+49", "(0)", "x@y.z", "é", "255.1.2.3"]) for _ in range(r.randint(0, 25))) for _ in range(800)]
    extra = spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    got = collections.Counter((r.doc_id, r.base_sha256) for r in pii.digests(both).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_pii(t or "").encode()).hexdigest()) for i, t in by_id(both))
    assert "iban:8:30" in pii.written(pii.spans("account DE89370400440532013000 ok"))
    assert "ssn" not in pii.written(pii.spans("see 123-45-6789")) and "ssn" in pii.written(pii.spans("social security 123-45-6789"))
    assert pii.spans("DE00370400440532013000") == []
    spans = pii.find(odd).filter("doc_id = 11").collect()
    assert {s.kind for s in spans} == {"email", "ip", "card", "phone"} and all(0 < s.score <= 1 for s in spans)


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = crc_mod("doc_id", 3) == 1
    model = language_id.train(docs, ~held_out)
    right = language_id.predict(docs, model).join(docs.filter(held_out).select("doc_id", "lang"), "doc_id")
    assert right.filter("lang = lang_pred").count() >= 0.98 * right.count() > 0
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und"
    assert language_id.predict(docs, language_id.train(docs.limit(0), ~held_out)).filter("lang_pred <> 'und'").count() == 0
    one = language_id.train(docs.filter("lang = 'fr'"), ~held_out)
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"fr"}
    code = language_id.codewords(12)
    assert len({tuple(c) for c in code}) == 12 and ((code.shape[1] - code @ code.T) / 2 + 99 * np.eye(12)).min() >= 5


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    assert 0 < len(model.places) < 5000
    told = toxicity.score(docs, model).join(labels.filter(held_out), "doc_id").select("toxic", (F.col("score") >= 0.5).alias("hit")).toPandas()
    assert told[told.toxic == 1].hit.mean() > 0.75 and told[told.toxic == 0].hit.mean() < 0.01
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    nothing = toxicity.train(docs, labels.limit(0), ~held_out)
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def brute_hits(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if x else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_decontamination(spark, odd):
    r = random.Random(1)
    words = ["Ab", "cd", "é", "1", "zz"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([12, 15, 30]))) for i in range(8)] + [(8, "ab"), (9, None), (10, ""), (11, say(5)), (None, "zz"), (3, say(11))]
    texts = [say(r.randint(0, 40)) + " " + (items[r.randint(0, 7)][1] if r.random() < 0.5 else "") for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (61, None), (0, texts[0])], "doc_id long, text string")
    for use in (items, [x for x in items if x[0] not in (8, 11)]):
        known = [x for x in use if x[0] is not None]
        bench = spark.createDataFrame(use, "item_id long, text string")
        want = collections.Counter((i, *map(str, brute_hits(t, known))) for i, t in by_id(docs))
        for block in (1 << 20, 60):
            got = decontamination.search(docs, bench, block_bytes=block).collect()
            assert collections.Counter((x.doc_id, str(x.n_words), str(x.n_hit), str(x.items)) for x in got) == want
    clean = decontamination.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontamination.search(odd, bench.limit(0)).filter("contaminated").count() == 0
    one = spark.createDataFrame([(1, "q " + items[0][1] + " q")], "doc_id long, text string")
    m = decontamination.matches(one, bench.filter("item_id = 0")).filter("doc_word = 1").collect()
    assert m[0].item_word == 0 and m[0].n_words == len(items[0][1].split())


def brute_print(text):
    w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(300)]
    texts = []
    for _ in range(80):
        w = list(base) if r.random() < 0.7 else [f"v{r.randint(0, 999)}" for _ in range(30)]
        w[r.randint(0, len(w) - 1)] = "changed"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([*enumerate(texts, 100), (None, texts[0])], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = by_id(docs)
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = collections.Counter((d, f"{prints[i]:016x}", min(x for x in groups[find(i)] if x is not None)) for i, (d, _) in enumerate(rows) if any(x is not None for x in groups[find(i)]))
    got = collections.Counter(tuple(x) for x in simhash.digests(docs).collect() if x.component_id is not None)
    assert got == want
    kept = simhash.one_of_each(docs)
    assert {x.doc_id for x in kept.filter("doc_id is not null").collect()} == {x[2] for x in want}
    assert simhash.digests(docs.limit(0)).count() == 0


def test_no_pair_within_three_bits_is_lost():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 62, 400, dtype=np.int64)
    for x in a:
        y = x
        for b in r.choice(64, 3, replace=False):
            y = np.int64(np.uint64(y) ^ (np.uint64(1) << np.uint64(b)))
        meet = False
        for n in (0, 1):
            sides = [set(simhash.anchors(np.array([(v >> (31 * n)) & ((1 << 31) - 1)]))[1].tolist()) for v in (x, y)]
            meet |= bool(sides[0] & sides[1])
        assert meet
    near = np.unique(np.concatenate([[np.uint64(v) ^ np.uint64(1 << int(b)) for b in range(40)] for v in a[:5]]).astype(np.uint64))
    whole = {frozenset(map(int, p)) for p in zip(*map(np.concatenate, zip(*simhash.forest(near))))}
    simhash_crowded, simhash.CROWDED = simhash.CROWDED, 10
    try:
        parts = {frozenset(map(int, p)) for p in zip(*map(np.concatenate, zip(*simhash.forest(near))))}
    finally:
        simhash.CROWDED = simhash_crowded
    label = lambda links: len(near) - len(_forest_size(links, near))
    assert label(whole) == label(parts)


def _forest_size(links, nodes):
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in links:
        x, y = pair
        root[find(x)] = find(y)
    return {find(int(n)) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    root = {n: n for n in nodes}
    for _ in range(len(nodes)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    """Texts by row after line dedup, in plain Python."""
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    long = lambda line: len(re.split("[ \t]+", line.strip(" \t"))) > 50
    passage = lambda part: len(part) > 1 or long(part[0])
    cut = []
    for i, t in rows:
        parts, part = [], []
        for k, line in enumerate(lines := t.split("\n") if t is not None else []):
            part.append(line)
            if k == len(lines) - 1 or long(line) or long(lines[k + 1]) or k and (h(lines[k - 1]) * 31 + h(line)) % 1000003 % 3 == 0:
                parts.append(part)
                part = []
        cut.append(parts)
    where = collections.defaultdict(list)
    body = lambda t: hashlib.md5(t.encode()).hexdigest()
    for (i, t), parts in zip(rows, cut):
        for k, p in enumerate(parts):
            if passage(p) and i is not None:
                where["\n".join(p)].append((i, body(t), k))
    out = []
    for (i, t), parts in zip(rows, cut):
        keep = [p for k, p in enumerate(parts) if i is None or not passage(p) or (i, body(t), k) == min(where["\n".join(p)])]
        out.append((i, None if t is None else "\n".join("\n".join(p) for p in keep)))
    return collections.Counter(out)


def texts_of(seed):
    r = random.Random(seed)
    return "\n".join(" ".join(f"w{seed}x{r.randint(0, 999)}" for _ in range(9)) for _ in range(12))


def test_line_dedup(spark, odd):
    r = random.Random(6)
    shared = [f"shared line {i}" for i in range(12)]
    passage, almost = " ".join(f"w{i}" for i in range(51)), " \t".join(f"w{i}" for i in range(50))
    texts = []
    for d in range(40):
        own = [f"line {r.randint(0, 200)}" for _ in range(r.randint(0, 8))]
        own += ([passage] if d % 3 == 0 else []) + ([f"alone {d}", almost] if d % 5 == 0 else [])
        texts.append("\n".join(own[:3] + (shared if r.random() < 0.6 else []) + own[3:] + (shared[:6] * 2 if r.random() < 0.2 else [])))
    docs = spark.createDataFrame([*enumerate(texts, 100), (None, texts[0])], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = line_dedup.dedup(docs)
    rows = [tuple(x) for x in docs.collect()]
    assert collections.Counter(tuple(x) for x in got.collect()) == brute_lines(rows)
    texts = dict(got.filter("doc_id >= 100").select("doc_id", "text").collect())
    assert [d for d, t in texts.items() if passage in t.split("\n")] == [100]
    both = spark.createDataFrame([(1, texts_of(1)), (2, texts_of(1)), (2, texts_of(2)), (3, texts_of(3)), (3, texts_of(4) + "\n" + texts_of(3))], "doc_id long, text string")
    rows = [tuple(x) for x in both.collect()]
    assert collections.Counter(tuple(x) for x in line_dedup.dedup(both).collect()) == brute_lines(rows)
    for way in (line_dedup.dedup, line_dedup.dedup_runs):  # what occurs in one text of a repeated id only is never lost
        left = way(both).collect()
        assert texts_of(2) in [x.text for x in left] and texts_of(1) in [x.text for x in left if x.doc_id == 1]
        assert {line for x in left for line in x.text.split("\n") if line} == {line for _, t in rows for line in t.split("\n")}
    wide = line_dedup.dedup(odd)
    assert wide.columns == odd.columns and wide.count() == odd.count()
    assert line_dedup.dedup(odd.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_neighbours(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(3000, 16)) + c for c in r.normal(size=(8, 16)) * 2]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 3000, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(50_000, None), (50_100, [0.0] * 16), (50_200, [None] * 16), (50_300, [float("nan")] * 16), (50_400, [1.0]), (None, [1.0] * 16), rows[0]]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    found, info = ann.search(table, F.pmod("vec_id", F.lit(100)) == 0)
    got = found.toPandas()
    exact, ids = x.astype(float), np.arange(len(x))
    hit = n = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((ids, d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=1e-12, atol=0)
        hit += len(set(mine.vec_id) & set(want))
        n += 10
    assert set(got.query_id) == set(range(0, len(x), 100)) and hit / n >= 0.9
    assert info["visits"] < info["leaves"]
    few = ann.search(spark.createDataFrame(rows[:4] + rows[:1], table.schema), F.lit(True))[0].collect()
    assert collections.Counter(f.query_id for f in few) == {0: 3, 1: 3, 2: 3, 3: 3}
    twin = [(0, [float(i), 1.0]) for i in range(12)] + [(i, [100.0 + i, 1.0]) for i in range(1, 40)] + [(5, [3.0, 1.0])]
    near = ann.search(spark.createDataFrame(twin, table.schema), F.col("vec_id").isin(0, 7))[0].collect()
    want = collections.Counter()
    for q, v in [t for t in twin if t[0] in (0, 7)]:
        order = sorted({(abs(w[0] - v[0]), i) for i, w in twin if i != q})[:10]
        want.update((q, r, i, d) for r, (d, i) in enumerate(order, 1))
    assert collections.Counter(tuple(r) for r in near) == want
    assert ann.search(table.limit(0), F.lit(True))[0].count() == 0
    assert ann.search(spark.createDataFrame(bad[:3], table.schema), F.lit(True))[0].count() == 0


def test_tiny_shares_find_rows(spark):
    """4,000 of nine thousand million: the share is not rounded away, and is met on a table of its own size."""
    keys = spark.range(3_000_000).withColumnRenamed("id", "k")
    for rate, least, most in ((4_000 / 9e9 * 1000, 400, 3000), (1e-6, 0, 20), (0.5, 1_490_000, 1_510_000), (1.0, 3_000_000, 3_000_000)):
        n = keys.filter(hash_share("k", 11, rate)).count()
        assert least <= n <= most, (rate, n)
    literal = hash_share("k", 11, 4_000 / 9e9)._jc.toString()
    assert "< 0" not in literal


def test_toxicity_rows_are_bounded(spark, documents):
    """One id with very many texts does not bring more rows than the bound into the training task."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs).unionByName(documents.select("doc_id", "text").filter("doc_id <> 1"))
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").unionByName(spark.read.parquet(f"{SF}/labels.parquet").filter("doc_id <> 1"))
    whole, toxicity.EPOCHS = toxicity.EPOCHS, 1
    try:
        model = toxicity.train(docs, labels, F.lit(True), max_train=200)
    finally:
        toxicity.EPOCHS = whole
    assert len(model.places)
    assert 0 <= toxicity.score(docs, model).agg(F.max("score")).first()[0] <= 1


def test_quotations(spark):
    turns = [
        (1, 0, "user", "How do I bake bread?\n\nAnd how long?"),
        (1, 1, "assistant", "> How do I bake bread?\n\nWith flour."),
        (1, 2, "user", "On Monday, B wrote:\n> > and  HOW long?\n> With flour.\nThanks"),
        (1, 3, "user", "> never said\nhm"), (1, 3, "user", "> never said\nhm"),
        (1, 4, "user", "How do I bake bread?\n\nAnd how long?"), (1, 5, "user", "> How do I bake bread?\n>\n> And how long?"),
        (2, 0, "user", None), (2, 1, None, "> With flour."), (None, 0, "user", "x"), (3, None, "user", "> x"), (4, 0, "user", ""),
    ]
    messages = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, content string, thread int")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(messages).collect()}
    assert quotes.conversations(messages).count() == len(turns)
    links = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert links == {(1, 1): 0, (1, 2): 1, (1, 5): 0}
    assert (got[1, 2].content, got[1, 2].thread, got[1, 2].steps, got[1, 2].depth, got[1, 2].n_quotes) == ("Thanks", 0, 2, 2, 2)
    assert got[1, 1].content == "With flour." and got[1, 3].thread == 3 and got[2, 0].content == ""
    chain = [(9, 0, "u", "m0")] + [(9, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    long = {r.turn: r for r in quotes.conversations(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()}
    assert all(long[i].thread == 0 and long[i].steps == i for i in long)
    assert quotes.conversations(messages.limit(0)).count() == 0


def test_pipeline_catches_what_was_planted(spark, tmp_path):
    import corpus_pipeline

    docs, labels, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    text = {r.doc_id: r.text for r in docs.collect()}
    item = bench.first().text
    planted = [(900_001, f"Some words before. {item} And after.", "en", "s", 1), (900_002, text[0], "en", "s", 1), (900_003, text[0], "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not left.keys() & {900_001, 900_002, 900_003} or all(left[i].n_tokens == 0 for i in left.keys() & {900_002, 900_003})
    assert 900_001 not in left and 800 < len(left) < 1003
    assert all(len(r.ids) == r.n_tokens for r in left.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
