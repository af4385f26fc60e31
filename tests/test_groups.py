"""Bounds of groups of tiles, and scores handed over as Arrow lists."""

import numpy as np
import pyarrow as pa
import pytest

from leadkin.operators import nearest, pairs
from tests.test_nearest import side


def test_bounds_of_few_tiles_are_worked_out(monkeypatch):
    """Most tiles are ruled out with their group: before, each had a bound for every row."""
    rng = np.random.default_rng(8)
    c, p = side(rng, 20_000, 10**6, 30), side(rng, 200, 10**6, 30, 10**6)
    known, seen, bounds = pairs.Companies(pairs.packed(c)), [], nearest.Ranges.bounds

    def counted(self, *args):
        out = bounds(self, *args)
        seen.append(out.size)
        return out

    monkeypatch.setattr(nearest.Ranges, "bounds", counted)
    pairs._company_block(p, known)
    assert sum(seen) < 0.5 * len(p) * (len(known.by_total.members) + len(known.by_size.members))


@pytest.mark.parametrize("tile, group, groups", [(1, 1, 1), (2, 3, 2), (32, 8, 8)])
def test_any_tiles_and_groups_give_the_same(monkeypatch, tile, group, groups):
    rng = np.random.default_rng(9)
    c, p = side(rng, 700, 40, 12), side(rng, 90, 40, 12, 5000)
    want = pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    for name, value in (("TILE", tile), ("GROUP", group), ("GROUPS", groups)):
        monkeypatch.setattr(nearest, name, value)
    got = pairs._company_block(p, pairs.Companies(pairs.packed(c)))
    assert all((got[k] == want[k]).all() for k in want)


@pytest.mark.parametrize("customers", [0, 3, 50])
def test_lists_of_a_block(customers):
    """The record has what the frame has, also without customers, where lists are empty."""
    rng = np.random.default_rng(10)
    c, p = side(rng, max(customers, 1), 5, 3).iloc[:customers], side(rng, 20, 5, 3, 5000)
    c = c.assign(company=[None, *c["company"][1:]]) if customers else c
    names = [f.split(" ")[0] for f in pairs._schema(pairs.COMPONENTS).split(", ")]
    known = [pairs.Companies(pairs.packed(c))]
    record = pa.Table.from_batches([pairs._record(part, block, names) for part, block in pairs._blocks(p, known, pairs._company_block)])
    assert str(record.schema.field("b_company").type) == "list<item: string>" and str(record.schema.field("b_id").type) == "list<item: int64>"
    frame = pairs._scored(p, known, pairs._company_block, names)
    assert record.column_names == names
    for k in names:
        want = [list(v) if isinstance(v, np.ndarray) else v for v in frame[k]]
        assert record[k].to_pylist() == want
