import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import pairs, tfidf
from leadkin.operators.columns import col
from leadkin.operators.dedupe import duplicate_counts
from leadkin.operators.lookup import heavy_light_lookup
from leadkin.operators.ranking import number_rows, with_percentile
from leadkin.plans.scoring import score

# Expected values of the sample: rank, score, best pair, six components, nearest customer, percentile.
GOLDEN = [
    ("P001", 0.450177, 0.589432, 0.052834, 0.397005, 0.847969, 0.833117, 0.826000, 1.0, "星河雲端股份有限公司", 100.0),
    ("P005", 0.414293, 0.569120, 0.221258, 0.277406, 0.847969, 0.638366, 0.826000, 1.0, "北辰顧問股份有限公司", 87.5),
    ("P003", 0.387909, 0.507758, 0.059252, 0.308887, 0.728148, 0.841803, 0.606667, 1.0, "晨光生技股份有限公司", 75.0),
    ("P006", 0.387845, 0.505454, 0.042437, 0.311944, 0.724053, 0.802174, 0.606667, 1.0, "綠野生活股份有限公司", 62.5),
    ("P002", 0.369438, 0.455250, 0.119062, 0.237616, 0.806902, 0.783836, 0.826000, 1.0, "松果行銷有限公司", 50.0),
    ("P008", 0.309942, 0.348377, 0.036102, 0.325539, 0.420412, 0.764939, 0.000000, 1.0, "晨光生技股份有限公司", 37.5),
    ("P004", 0.292217, 0.368813, 0.000000, 0.224247, 0.403076, 0.801726, 0.644000, 1.0, "星河雲端股份有限公司", 25.0),
    ("P007", 0.257712, 0.295964, 0.007152, 0.225836, 0.487407, 0.778140, 0.424667, 1.0, "星河雲端股份有限公司", 12.5),
]


@pytest.fixture(scope="module")
def ranked(samples):
    return score(*samples)


def test_sample_ranking(ranked):
    rows = ranked[0].orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 9))
    for row, want in zip(rows, GOLDEN):
        assert row[fixed.CUST_NO] == f"SAMPLE-{want[0]}"
        got = [row["similarity_score"], row["max_pair_similarity"], *[row[f"{k}_similarity_component"] for k in pairs.COMPONENTS]]
        assert got == pytest.approx(want[1:9], abs=1e-6)
        assert row["top_existing_customer_names"].split(" | ")[0] == want[9]
        assert row["score_percentile"] == want[10]
        assert row["feature_coverage"] == 1.0 and row["is_existing_customer_duplicate"] is False
        assert float(row["top_existing_customer_scores"].split(" | ")[0]) == pytest.approx(row["top_existing_customer_score"], abs=1e-4)


def test_sample_matches(ranked):
    rows = ranked[1].orderBy("potential_row_ord", "match_rank").collect()
    assert len(rows) == 40
    assert [r["existing_customer"] for r in rows[:2]] == ["星河雲端股份有限公司", "晨光生技股份有限公司"]
    assert rows[0]["total_similarity"] == pytest.approx(0.589432, abs=1e-6)


@pytest.mark.parametrize("broadcast_bytes", [-1, pairs.BROADCAST_BYTES])
def test_blocks_and_partitions_do_not_change_the_result(samples, ranked, broadcast_bytes):
    customers, potentials = samples
    again, matches = score(customers.repartition(3), potentials.repartition(5), blocks=(3, 2), broadcast_bytes=broadcast_bytes)
    assert sorted(again.collect()) == sorted(ranked[0].collect())
    assert sorted(matches.collect()) == sorted(ranked[1].collect())


def test_many_blocks_are_merged_in_levels(samples, ranked, monkeypatch):
    monkeypatch.setattr(pairs, "MERGE_FAN_IN", 2)
    customers, potentials = samples
    again, _ = score(customers, potentials, blocks=(8, 1), broadcast_bytes=-1)
    assert sorted(again.collect()) == sorted(ranked[0].collect())


def test_existing_customer_scores_zero_against_itself(samples):
    customers, potentials = samples
    extra = customers.filter(col(fixed.CUST_NO) == "SAMPLE-C001").withColumn(fixed.ROW_ORD, F.lit(99).cast("long"))
    ranking, matches = score(customers, potentials.unionByName(extra, allowMissingColumns=True))
    row = ranking.filter(F.col(fixed.ROW_ORD) == 99).first()
    assert row["is_existing_customer_duplicate"] is True
    assert ranking.count() == 9
    own = matches.filter((F.col("potential_row_ord") == 99) & (F.col("existing_customer") == "星河雲端股份有限公司")).first()
    assert own["total_similarity"] == 0 and own["snack_signal_similarity"] == 0


def test_no_customers(samples):
    customers, potentials = samples
    ranking, matches = score(customers.limit(0), potentials)
    assert ranking.count() == 8 and matches.count() == 0
    assert ranking.filter("similarity_score <> 0").count() == 0


def test_missing_name_column(samples):
    customers, potentials = samples
    with pytest.raises(ValueError, match="customers"):
        score(customers.drop(fixed.NAME), potentials)


def test_kernel_against_plain_loops():
    rng = np.random.default_rng(7)
    n_p, n_c = 13, 9

    def side(n):
        grams = [rng.choice(40, size=rng.integers(0, 20), replace=False) for _ in range(n)]
        return grams, [rng.random(len(g)) for g in grams]

    (pg, pw), (cg, cw) = side(n_p), side(n_c)
    want = [[sum(a * dict(zip(cg[j], cw[j])).get(g, 0.0) for g, a in zip(pg[i], pw[i])) for j in range(n_c)] for i in range(n_p)]
    old, pairs._CELLS = pairs._CELLS, 7
    try:
        assert np.allclose(pairs.GramIndex(cg, cw).products(pg, pw), want)
    finally:
        pairs._CELLS = old
    total = np.round(rng.integers(0, 4, size=(n_p, n_c)) / 4, 12)
    order = rng.permutation(n_c) * 10
    best = pairs.best_columns(total, order)
    for i in range(n_p):
        assert list(best[i]) == sorted(range(n_c), key=lambda j: (-total[i, j], -order[j]))[:5]


@pytest.mark.parametrize("dense", [0, 3, 1000])
@pytest.mark.parametrize("cells", [5, 2_000_000])
def test_common_and_rare_grams(monkeypatch, dense, cells):
    """Full lines and lists give the same products, for rows without grams and a gram all rows have too."""
    monkeypatch.setattr(pairs, "DENSE", dense)
    monkeypatch.setattr(pairs, "_CELLS", cells)
    rng = np.random.default_rng(3)
    side = lambda n: [np.unique(np.concatenate([[7], (rng.zipf(1.3, 12) % 60)])) if i % 5 else np.empty(0, dtype=int) for i in range(n)]
    pg, cg = side(17), side(11)
    pw, cw = ([rng.random(len(g)) for g in grams] for grams in (pg, cg))
    want = [[sum(a * dict(zip(h, v)).get(g, 0.0) for g, a in zip(k, w)) for h, v in zip(cg, cw)] for k, w in zip(pg, pw)]
    assert np.allclose(pairs.GramIndex(cg, cw).products(pg, pw), want)


def test_closeness():
    nan = np.nan
    p, c = np.array([[99.0, nan], [99.0, 5.0], [nan, nan], [-1.0, nan]]), np.array([[99.0, 5.0]])
    assert pairs.closeness(p, c)[:, 0].tolist() == [1.0, 1.0, 0.0, 0.0]


def test_signal_and_place():
    assert pairs.signal(np.array([True, False]), np.array([True, False])).tolist() == [[1.0, 0.45], [0.10, 0.25]]
    assert pairs.same(pd.Series(["a", ""]), pd.Series(["a", ""])).tolist() == [[True, False], [False, False]]


def test_top_mix(spark):
    row = spark.createDataFrame([([0.9, 0.6, 0.3, 0.0],), ([],)], "v array<double>").select(pairs.top_mix("v")).collect()
    assert [round(r[0], 9) for r in row] == [0.705, 0.0]


def test_blocks_weigh_the_same(spark):
    """One text of 15,000 grams among short ones: no block is much over the limit in bytes, and rows and pairs stay whole."""
    grams = F.sequence(F.lit(1), F.when(F.col("id") == 77, 15_000).otherwise(20 + F.col("id") % 60)).cast("array<bigint>")
    rows = spark.range(3000).repartition(7).select("id", grams.alias("g_text")).withColumn("w_text", F.transform("g_text", lambda g: g.cast("double")))
    limit = 120_000
    found, n = pairs.dealt(rows, 500, limit, 1, "b")
    weight = F.sum(pairs._row_bytes(["g_text"]))
    blocks = {r.b: (r.rows, r.weight) for r in found.groupBy("b").agg(F.count("*").alias("rows"), weight.alias("weight")).collect()}
    weights = sorted(w for _, w in blocks.values())
    assert len(blocks) == n and sum(k for k, _ in blocks.values()) == 3000
    heaviest = 15_000 * 16 + 512
    assert weights[-1] <= heaviest + limit and weights[-2] <= 2 * weights[len(weights) // 2]
    few, n = pairs.dealt(rows, 50, 1 << 30, 1, "b")
    assert max(r[1] for r in few.groupBy("b").count().collect()) <= 51 and n == 60
    left, right, c_blocks = pairs._crossed(rows, rows, 3000, (500, 300), limit)
    met = left.groupBy("pb", "cb").count().join(right.groupBy("pb", "cb").agg(F.count("*").alias("m")), ["pb", "cb"])
    assert met.agg(F.sum(F.col("count") * F.col("m"))).first()[0] == 3000 * 3000


def test_large_vocabulary_takes_the_shuffle_join(samples, ranked, monkeypatch):
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tfidf.with_vectors, "__defaults__", (0,))
    again, _ = score(*samples)
    assert sorted(again.collect()) == sorted(ranked[0].collect())


def test_percentile_and_rank_with_ties(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, 1.0, 4.0, 2.0])], "id long, s double")
    numbered, total = number_rows(rows, [F.col("s").desc(), F.col("id").asc()], "rank")
    got = with_percentile(numbered, "s", "rank", total, "pct").orderBy("rank").collect()
    assert [(r.id, r["rank"], r.pct) for r in got] == [(2, 1, 100.0), (0, 2, 62.5), (3, 3, 62.5), (1, 4, 25.0)]


def test_percentile_with_a_third_of_rows_equal(spark):
    rng = random.Random(3)
    values = [0.5 if i % 3 == 0 else rng.random() for i in range(6000)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, s double")
    numbered, total = number_rows(rows, [F.col("s").desc(), F.col("id").asc()], "rank")
    got = with_percentile(numbered, "s", "rank", total, "pct").toPandas().set_index("id")["pct"].sort_index()
    want = pd.Series(values).rank(pct=True) * 100
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_heavy_and_light_keys_meet_the_same_rows(spark):
    probe = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(5000)], "i long, k long")
    table = probe.groupBy("k").agg(F.count("*").alias("n")).filter("k % 3 = 0")
    got = heavy_light_lookup(probe, table, ["k"], "n", 5000, F.col("i"))
    assert got.count() == 5000
    assert got.filter("k = 0").select("n").distinct().collect()[0][0] == 2501
    assert got.filter("k <> 0 and k % 3 = 0 and (n is null or n <> 1)").count() == 0
    assert got.filter("k % 3 <> 0 and n is not null").count() == 0


def test_duplicate_counts(spark):
    schema = "id long, n string, c string"
    p = spark.createDataFrame([(0, "a", "1"), (1, "", ""), (2, "b", None), (3, "x", "2")], schema)
    c = spark.createDataFrame([(0, "a", "1"), (1, "a", "9"), (2, "z", "1"), (3, "", ""), (4, "b", "2")], schema)
    got = {r.id: r.duplicate_customers for r in duplicate_counts(p, c, "n", "c", "id").collect()}
    assert got == {0: 3, 1: 0, 2: 1, 3: 1}


def test_scoring_plan_has_no_cross_join(samples):
    customers, potentials = samples
    ranking, matches = score(customers, potentials)
    for df in (ranking, matches):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
