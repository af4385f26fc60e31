"""Early stop and resumption of profile building, and marking of a stored run."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.checks.building import landed
from leadkin.operators.columns import col
from leadkin.plans import profiles, weekly
from leadkin.session import scratch_path
from leadkin.sources import history_store
from leadkin.sources.tables import write_run

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 10, 12, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def raw(spark):
    return landed(spark, SF)


def numbers(df):
    return [r[fixed.CUST_NO] for r in df.orderBy(fixed.ROW_ORD).collect()]


@pytest.fixture(scope="module")
def everything(raw):
    return numbers(profiles.build_profiles(raw, target=None, fuzzy=False))


def test_later_batches_are_not_resolved_and_finished_ones_are_kept(spark, raw, everything, monkeypatch):
    store, asked = scratch_path(spark, "building"), []
    real = profiles.Resolver.rows

    def counted(self, candidates):
        if asked:
            raise RuntimeError("lost")
        asked.append(candidates.count())
        return real(self, candidates)

    build = lambda: numbers(profiles.build_profiles(raw, target=20, max_candidates=1000, fuzzy=False, first_batch=10, store=store))
    with monkeypatch.context() as broken:
        broken.setattr(profiles.Resolver, "rows", counted)
        with pytest.raises(RuntimeError, match="lost"):
            build()
    assert asked == [20]  # the target is the first batch, as fewer candidates cannot be enough
    prepared = []
    again = profiles.prepared
    monkeypatch.setattr(profiles, "prepared", lambda registry: prepared.append(1) or again(registry))
    monkeypatch.setattr(profiles.Resolver, "rows", lambda self, c: asked.append(c.count()) or real(self, c))
    assert build() == everything[:20]
    assert asked == [20, 40] and prepared == [1]  # 90 of the 150 candidates are never resolved
    monkeypatch.setattr(profiles, "prepared", lambda registry: pytest.fail("the registry was read again"))
    assert build() == everything[:20] and asked == [20, 40]


def test_other_inputs_start_anew(spark, raw):
    some = spark.createDataFrame([("x",)], "company_key string")
    assert profiles.fingerprint(raw) == profiles.fingerprint(raw) != profiles.fingerprint(raw, some)
    assert profiles.fingerprint(profiles.Landed(some, raw.payloads, raw.registry, raw.items)) is None


def test_candidates_barred_when_collected_do_not_count(spark):
    """Three pages; the second candidate of page 0 is barred by the first but was collected with it, so it counts; the one on page 1 does not."""
    kept = spark.createDataFrame([(1, 0, "a"), (4, 1, "d")], "cand_ord long, page_ord long, matched_key string")
    rows = [(1, 0, "a"), (2, 0, "a"), (3, 1, "a"), (4, 1, "d"), (5, 1, "d"), (6, 2, "d"), (7, 2, "e"), (8, 2, "")]
    got, n = profiles.checked(spark.createDataFrame(rows, "cand_ord long, page_ord long, own_key string"), kept)
    assert dict(got.collect()) == {1: 1, 2: 2, 4: 3, 5: 4, 7: 5, 8: 6} and n == 6


def test_first_leads_of_a_stored_run_are_marked(spark):
    root = scratch_path(spark, "weekly")
    leads = spark.createDataFrame([(i, f"c{i}", str(i)) for i in range(1, 8)], f"outreach_rank long, `{fixed.NAME}` string, `{fixed.CUST_NO}` string")
    write_run(leads.repartition(3), f"{root}/top_leads", "r1")
    done = weekly.mark_run(spark, root, "r1", f"{root}/history", now=NOW, top_n=3, status="sent", source="post", outcome="won", outcome_at="2024-06-12")
    assert (done["marked_count"], done["history_rows"]) == (3, 3)
    rows = history_store.read(spark, f"{root}/history").select(col(fixed.CUST_NO), "status", "source", "outcome", "outcome_at", "run_id").collect()
    assert sorted(map(tuple, rows)) == [(str(i), "sent", "post", "won", "2024-06-12", "r1") for i in (1, 2, 3)]
    assert weekly.mark_run(spark, root, "r1", f"{root}/history", now=NOW)["marked_count"] == 7
    assert weekly.mark_run(spark, root, "r1", f"{root}/history", now=NOW, top_n=0)["marked_count"] == 0
    with pytest.raises(FileNotFoundError):
        weekly.mark_run(spark, root, "r2", f"{root}/history", now=NOW)
