"""Many customers are sent in blocks, and what a job has stored on its way goes once it is not needed."""

import os
from datetime import datetime, timezone
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import pairs
from leadkin.plans import weekly
from leadkin.plans.scoring import company_scores, score
from leadkin.session import cut, freed


def stored(spark):
    """Folders of all stored results."""
    cut(spark.range(1))  # the folder exists from now on
    root = urlparse(spark.sparkContext.getCheckpointDir()).path
    return {n for n in os.listdir(root) if n.startswith("rdd-")}


def test_many_customers_do_not_copy_the_potentials(spark, samples, monkeypatch):
    """Before, potentials were shuffled to each block of 2,048 customers once these took more than a limit."""
    customers, potentials = samples
    want = sorted(score(customers, potentials)[0].collect())
    sent, sends = [], pairs._sent_companies
    monkeypatch.setattr(pairs, "SENT_BLOCKS", 10**9)
    monkeypatch.setattr(pairs, "_sent_companies", lambda *a: (sent.append(sends(*a)), sent[-1])[1])
    monkeypatch.setattr(pairs, "_crossed", lambda *a: pytest.fail("potentials are shuffled"))
    ranking, matches = score(customers.repartition(3, fixed.ROW_ORD), potentials, broadcast_bytes=1)
    assert sorted(ranking.collect()) == want
    assert matches.count() == 40
    assert len(sent[0]) > 1


def test_equal_vectors_of_a_partition_are_packed_once(spark):
    """Before, they were there once for every 2,048 rows, and so counted against the limit."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: i.cast("bigint"))
    columns = {"company": F.lit("x"), "name_key": F.lit("x"), "cust_no": F.lit(""), "city": F.lit(""), "district": F.lit("")}
    numbers = {"flags": F.lit(0), "employees": F.lit(1.0), "capital": F.lit(1.0), "signal": F.lit(True)}
    texts = {f"{k}_{f}": vector if k == "g" else F.transform(vector, lambda i: i.cast("double")) for f in pairs.TEXT_FIELDS for k in "gw"}
    rows = spark.range(20_480).coalesce(1).withColumns(columns | numbers | texts)
    sent = pairs._sent_companies(rows.select(*pairs.BLOCK_COLUMNS), 2 * 2**20)
    assert len(sent) == 1
    assert [len(v[0]) for v in sent[0].value[2].values()] == [1, 1, 1] and len(sent[0].value[0]) == 20_480


def test_repeated_rows_have_every_coverage(samples):
    """A row number that comes twice has a row for each pair of its rows, as before coverage was carried along."""
    customers, potentials = samples
    twice = potentials.unionByName(potentials.filter(F.col(fixed.ROW_ORD) == potentials.first()[fixed.ROW_ORD]))
    found = company_scores(twice, customers)
    assert sorted(r["count"] for r in found.groupBy("id").count().collect()) == [1] * 7 + [4]


def test_freed_results_are_deleted(spark):
    before = stored(spark)
    kept = cut(spark.range(5))
    with freed(spark):
        gone = cut(spark.range(7))
        assert gone.count() == 7
        now = stored(spark) - before
    left = stored(spark) - before
    assert len(now - left) >= 1 and kept.count() == 5


def test_weekly_job_leaves_no_stored_results(spark, samples, tmp_path):
    """Before, those of the first run were still there in the second."""
    for name, df in zip(("customers", "potentials"), samples):
        df.write.parquet(f"{tmp_path}/{name}")
    options = weekly.Options(f"{tmp_path}/customers", f"{tmp_path}/potentials", f"{tmp_path}/out", f"{tmp_path}/history", datetime(2024, 6, 10, tzinfo=timezone.utc))
    before = stored(spark)
    found = weekly.run(spark, options)
    assert found["potential_count"] == 8 and spark.read.parquet(found["top_matches"]).count() == 40
    assert len(stored(spark) - before) <= 1  # its own
