"""Potentials that no component tells apart are searched once."""

import numpy as np

from leadkin.operators import nearest, pairs
from tests.test_nearest import plain, side


def places(rng, n, first=0):
    """Companies that only have a place, as in `geo_match`; names are their own."""
    df = side(rng, n, 3, 1, first).assign(flags=0, employees=np.nan, capital=np.nan, signal=False, cust_no="")
    df["name_key"] = [f"n{first + i}" for i in range(n)]
    for f in pairs.TEXT_FIELDS:
        df[f"g_{f}"], df[f"w_{f}"] = [np.empty(0, dtype=np.int64)] * n, [np.empty(0)] * n
    return df


def test_alike_potentials_are_searched_once(monkeypatch):
    """Before, every row was searched, though there are twelve places only."""
    rng = np.random.default_rng(11)
    c, p = places(rng, 3000), places(rng, 500, 5000)
    p.loc[[7, 8], "name_key"] = ["n5", "n6"]  # two are customers themselves, so they are searched alone
    seen, best = [], nearest.best
    monkeypatch.setattr(nearest, "best", lambda rows, *rest: (seen.append(rows), best(rows, *rest))[1])
    block = pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    assert max(seen) <= 12 + 2
    total, parts, twin = plain(p, c)
    ids = c["id"].to_numpy()[pairs.best_columns(total, c["id"].to_numpy())]
    assert block["duplicate"].tolist() == twin.tolist() and twin.sum() == 2
    assert block["b_id"].tolist() == ids.tolist()
    assert np.allclose(block["v_total"], pairs.top_values(total), atol=2e-12, rtol=0)
    for k, scores in parts.items():
        assert np.allclose(block[f"v_{k}"], pairs.top_values(scores), atol=2e-12, rtol=0), k


def test_signals_are_searched_once(monkeypatch):
    """As in `signal_matrix`: two kinds of potentials, whatever their number."""
    rng = np.random.default_rng(12)
    c, p = (places(rng, n, first).assign(city="", district="") for n, first in ((3000, 0), (500, 5000)))
    for df in (c, p):
        df["signal"] = rng.random(len(df)) < 0.3
    seen, best = [], nearest.best
    monkeypatch.setattr(nearest, "best", lambda rows, *rest: (seen.append(rows), best(rows, *rest))[1])
    block = pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    assert max(seen) <= 2
    total, parts, _ = plain(p, c)
    assert block["b_id"].tolist() == c["id"].to_numpy()[pairs.best_columns(total, c["id"].to_numpy())].tolist()
    assert np.allclose(block["v_snack_signal"], pairs.top_values(parts["snack_signal"]), atol=2e-12, rtol=0)
