"""Exact search in tiles against plain scores of all pairs."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from leadkin import fixed
from leadkin.operators import nearest, pairs


def side(rng, n, names, texts, first=0):
    pick = lambda values: [values[i] for i in rng.integers(len(values), size=n)]
    grams = {f: [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(texts)] + [(np.empty(0, dtype=np.int64), np.empty(0))] for f in pairs.TEXT_FIELDS}
    df = pd.DataFrame({
        "id": rng.permutation(n) + first, "company": [f"c{i}" for i in range(n)],
        "name_key": pick(["", None, *[f"n{i}" for i in range(names)]]), "cust_no": pick(["", *[f"k{i}" for i in range(names)]]),
        "flags": pick([0, 1, 3, 7, 1023]), "employees": pick([np.nan, -5.0, 0.0, 10.0, 300.0, np.inf, *rng.random(20) * 1000]),
        "capital": pick([np.nan, 7.0, *rng.random(20) * 1e6]), "city": pick(["", None, "a", "b"]), "district": pick(["", "x", "y", "z"]),
        "signal": pick([True, False]),
    })
    for f in pairs.TEXT_FIELDS:
        chosen = pick(grams[f])
        df[f"g_{f}"], df[f"w_{f}"] = [g for g, _ in chosen], [w / max(np.sqrt((w * w).sum()), 1e-9) for _, w in chosen]
    return df


def plain(p, c):
    """Scores of all pairs, component by component."""
    text = {f: pairs.GramIndex(c[f"g_{f}"].tolist(), c[f"w_{f}"].tolist()).products(p[f"g_{f}"].tolist(), p[f"w_{f}"].tolist()) for f in pairs.TEXT_FIELDS}
    parts = {
        "profile": text["profile"],
        "welfare": text["welfare"],
        "industry": 0.65 * pairs.jaccard(p["flags"].to_numpy(), c["flags"].to_numpy()) + 0.35 * text["industry"],
        "size": pairs.closeness(p[["employees", "capital"]].to_numpy(), c[["employees", "capital"]].to_numpy()),
        "location": 0.7 * pairs.same(p["city"], c["city"]) + 0.3 * pairs.same(p["district"], c["district"]),
        "snack_signal": pairs.signal(p["signal"].to_numpy(), c["signal"].to_numpy()),
    }
    twin = pairs.same(p["name_key"], c["name_key"]) | pairs.same(p["cust_no"], c["cust_no"])
    parts = {k: np.where(twin, 0.0, v) for k, v in parts.items()}
    total = np.round(sum(fixed.COMPONENT_WEIGHTS[k] * v for k, v in parts.items()) / sum(fixed.COMPONENT_WEIGHTS.values()), 12)
    return total, {k: np.round(v, 12) for k, v in parts.items()}, twin.any(axis=1)


@pytest.mark.parametrize("customers, names, texts", [(1, 3, 2), (4, 2, 2), (9, 50, 4), (300, 8, 3), (300, 400, 300), (700, 2000, 12)])
@pytest.mark.parametrize("cells", [500, 2_000_000])
def test_companies_against_all_pairs(monkeypatch, customers, names, texts, cells):
    monkeypatch.setattr(pairs, "_CELLS", cells)
    monkeypatch.setattr(nearest, "CELLS", cells)
    rng = np.random.default_rng(customers + names)
    c, p = side(rng, customers, names, texts), side(rng, 150, names, texts, 5000)
    total, parts, twin = plain(p, c)
    block = pairs._company_block(p, pairs.Companies(pairs.merged([pairs.packed(c[:100]), pairs.packed(c[100:])])))
    best = pairs.best_columns(total, c["id"].to_numpy())
    rows = np.arange(len(p))[:, None]
    assert block["duplicate"].tolist() == twin.tolist()
    assert np.allclose(block["v_total"], pairs.top_values(total), atol=2e-12, rtol=0)
    assert np.allclose(block["b_total"], total[rows, best], atol=2e-12, rtol=0)
    assert (block["b_id"] == c["id"].to_numpy()[best]).mean() > 0.999  # sums in another order may part a tie
    for k, scores in parts.items():
        assert np.allclose(block[f"v_{k}"], pairs.top_values(scores), atol=2e-12, rtol=0), k


def test_few_pairs_are_scored(monkeypatch):
    """Most pairs are ruled out by bounds: before, each of them was scored."""
    rng = np.random.default_rng(5)
    c, p = side(rng, 20_000, 10**6, 30), side(rng, 200, 10**6, 30, 10**6)
    seen = []
    best = nearest.best

    def counted(rows, tiles, place, bound, score, k):
        return best(rows, tiles, place, bound, lambda r, o: (seen.append(len(r)), score(r, o))[1], k)

    monkeypatch.setattr(nearest, "best", counted)
    pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    assert sum(seen) < 0.2 * 2 * len(p) * len(c)


def test_equal_totals_go_by_the_highest_id():
    rng = np.random.default_rng(6)
    c, p = (side(rng, n, 10**6, 1).assign(employees=np.nan, capital=np.nan, flags=0, city="", district="", signal=False) for n in (5000, 40))
    for f in pairs.TEXT_FIELDS:
        c[f"g_{f}"], c[f"w_{f}"] = [np.empty(0, dtype=np.int64)] * len(c), [np.empty(0)] * len(c)
    block = pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    assert block["b_id"].tolist() == [[4999, 4998, 4997, 4996, 4995]] * len(p)


def test_room_of_products_follows_their_grams():
    """Potentials with many grams are scored a few at a time: before, a whole batch was, whatever its grams."""
    rng = np.random.default_rng(7)
    texts = lambda n: pd.DataFrame({"id": np.arange(n), "company": "x", "g_text": [np.arange(700)] * n, "w_text": [rng.random(700)] * n})
    known, p = pairs.Texts(texts(200)), texts(4000)
    tracemalloc.start()
    got = pairs._scored(p, [known], pairs._text_block, ["id", "duplicate", "v_total", "b_total", "b_id", "b_company"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["id"].tolist() == list(range(4000))
    assert peak < 100 * 2**20, peak
