"""Score queries with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.checks import roles
from leadkin.checks.roles import check, companies, duck, rounded, run, table
from leadkin.functions import text
from leadkin.operators import pairs
from leadkin.operators.companies import companies as company_columns
from leadkin.operators.dedupe import duplicate_counts
from leadkin.operators.ranking import first_rows, number_rows, with_percentile
from leadkin.plans import weekly
from leadkin.session import cut, scratch_path
from leadkin.plans.scoring import COMPONENT_COLUMNS, company_scores, match_rows, rank_companies, score, text_scores

TEXTS = "SELECT doc_id AS id, CAST(doc_id AS STRING) AS company, text FROM {documents}"
ITEMS = "SELECT item_id AS id, CAST(item_id AS STRING) AS company, text FROM {benchmark}"

SQL_KEY = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\([^)]*\\)', '', 'g'), '[-/|].*$', ''), "
    "'股份有限公司|有限公司', '', 'g'), '[^0-9a-z]+', '', 'g')"
)


def sql_grams(docs: str) -> str:
    """Gram counts of `docs` (side, id, field, t)."""
    sizes = " UNION ALL ".join(
        f"SELECT side, id, field, {' || '.join(f'c[i + {k}]' for k in range(n))} AS gram FROM "
        f"(SELECT side, id, field, c, unnest(range(1, len(c) - {n} + 2)) AS i FROM chars)"
        for n in fixed.GRAM_SIZES
    )
    return f"""chars AS (SELECT side, id, field, string_split(lower(t), '') AS c FROM {docs} WHERE length(t) >= 2),
tf AS (SELECT side, id, field, gram, count(*) AS tf FROM ({sizes}) GROUP BY ALL),
df AS (SELECT field, gram, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM c) AS n),
w AS (SELECT side, id, field, gram, (1e0 + ln(tf)) * (ln((1e0 + n) / (1e0 + df)) + 1e0) AS w
      FROM tf JOIN df USING (field, gram), n WHERE df <= 0.95e0 * n),
u AS (SELECT side, id, field, gram, w / sqrt(sum(w * w) OVER (PARTITION BY side, id, field)) AS w FROM w),
dots AS (SELECT a.id AS p, b.id AS c, a.field AS field, sum(a.w * b.w) AS s
         FROM u a JOIN u b ON a.field = b.field AND a.gram = b.gram AND a.side = 'p' AND b.side = 'c' GROUP BY ALL)"""


TEXT_SQL = f"""WITH p AS ({duck(TEXTS)}), c AS ({duck(ITEMS)}),
docs AS (SELECT 'p' AS side, id, 0 AS field, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM p
  UNION ALL SELECT 'c', id, 0, trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM c),
{sql_grams('docs')},
pair AS (SELECT p.id AS p, c.id AS c, round(coalesce(s, 0e0), 12) AS s FROM p CROSS JOIN c LEFT JOIN dots ON dots.p = p.id AND dots.c = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, c DESC) AS k FROM pair)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda df: df.withColumn("text", text.clean(F.col("text")))
    return text_scores(clean(run(spark, sf_dir, TEXTS)), clean(run(spark, sf_dir, ITEMS)))


@check(
    TEXT_SQL
    + """, m AS (SELECT p, max(s) AS best, avg(s) FILTER (k <= 3) AS top3, avg(s) FILTER (k <= 10) AS top10 FROM r GROUP BY p)
SELECT p AS doc_id, round(best, 6) AS best, round(top3, 6) AS top3, round(top10, 6) AS top10,
  round(0.45e0 * best + 0.35e0 * top3 + 0.2e0 * top10, 6) AS score FROM m"""
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against all benchmark items: best, top-3 and top-10 mean, mix."""
    scored = _texts(spark, sf_dir)
    return rounded(
        scored.select(
            F.col("id").alias("doc_id"),
            pairs.mean_of_top("v_total", 1).alias("best"),
            pairs.mean_of_top("v_total", 3).alias("top3"),
            pairs.mean_of_top("v_total", 10).alias("top10"),
            pairs.top_mix("v_total").alias("score"),
        )
    )


@check(
    TEXT_SQL
    + """ SELECT p AS doc_id, string_agg(CAST(c AS VARCHAR), ' | ' ORDER BY k) AS items, round(max(s), 6) AS best FROM r WHERE k <= 5 GROUP BY p"""
)
def top_text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best benchmark items of each document, joined in order."""
    scored = _texts(spark, sf_dir)
    return rounded(
        scored.select(F.col("id").alias("doc_id"), F.array_join("b_company", " | ").alias("items"), F.get("b_total", F.lit(0)).alias("best"))
    )


def _filled(template: str) -> str:
    """The role template with every column the company SQL reads."""
    have = {n for n in roles.HEADERS if f" AS {n}" in template}
    texts = ["cust_no", "profile", "w1", "w2", "w3", "w4", "city", "district", "industry", "signal"]
    extra = [f"'' AS {c}" for c in texts if c not in have]
    extra += [f"CAST(NULL AS DOUBLE) AS {c}" for c in ("employees", "capital") if c not in have]
    extra += [f"0 AS f{i}" for i in range(10) if f"f{i}" not in have]
    return f"SELECT *{''.join(', ' + e for e in extra)} FROM ({duck(template)})"


def company_sql(potentials: str, customers: str) -> str:
    names = ", ".join(f"CASE WHEN f{i} > 0 THEN '{c}' END" for i, c in enumerate(fixed.INDUSTRY_FLAGS))
    fields = {
        0: "profile",
        1: "regexp_replace(trim(w1 || ' ' || w2 || ' ' || w3 || ' ' || w4), '\\s+', ' ', 'g')",
        2: f"concat_ws(' ', nullif(industry, ''), {names})",
    }
    docs = " UNION ALL ".join(f"SELECT '{s}' AS side, id, {i} AS field, {t} AS t FROM {s}" for s in "pc" for i, t in fields.items())
    both = " + ".join(f"(p.f{i} > 0 AND c.f{i} > 0)::INT" for i in range(10))
    either = " + ".join(f"(p.f{i} > 0 OR c.f{i} > 0)::INT" for i in range(10))
    near = lambda x: f"exp(-abs(ln(1e0 + p.{x}) - ln(1e0 + c.{x})) / 1.5e0)"
    has = lambda x: f"(coalesce(p.{x}, -1) >= 0 AND coalesce(c.{x}, -1) >= 0)"
    part = lambda x: f"CASE WHEN {has(x)} THEN {near(x)} ELSE 0e0 END"
    seen = f"({has('employees')}::INT + {has('capital')}::INT)"
    true = lambda s: f"(lower({s}.signal) IN ('true', '1', 'yes', 'y', '是', '有', 't'))"
    weights = " + ".join(f"{w}e0 * {k}" for k, w in fixed.COMPONENT_WEIGHTS.items())
    comps = list(fixed.COMPONENT_WEIGHTS)
    zeroed = ", ".join(f"CASE WHEN dup THEN 0e0 ELSE {k} END AS {k}" for k in comps)
    stacked = " UNION ALL ".join(f"SELECT p, '{k}' AS comp, round({k}, 12) AS v FROM tot" for k in ["total", *comps])
    return f"""WITH p AS ({_filled(potentials)}), c AS ({_filled(customers)}),
docs AS ({docs}),
{sql_grams('docs')},
raw AS (SELECT p.id AS p, c.id AS c, c.name AS cname,
  coalesce(d0.s, 0e0) AS profile, coalesce(d1.s, 0e0) AS welfare,
  0.65e0 * CASE WHEN {either} > 0 THEN ({both})::DOUBLE / ({either}) ELSE 0e0 END + 0.35e0 * coalesce(d2.s, 0e0) AS industry,
  CASE WHEN {seen} > 0 THEN ({part('employees')} + {part('capital')}) / {seen} ELSE 0e0 END AS size,
  0.7e0 * (p.city <> '' AND p.city = c.city)::INT + 0.3e0 * (p.district <> '' AND p.district = c.district)::INT AS location,
  CASE WHEN {true('p')} THEN CASE WHEN {true('c')} THEN 1e0 ELSE 0.45e0 END ELSE CASE WHEN {true('c')} THEN 0.1e0 ELSE 0.25e0 END END AS snack_signal,
  ({SQL_KEY.format('p.name')} = {SQL_KEY.format('c.name')} OR (p.cust_no <> '' AND p.cust_no = c.cust_no)) AS dup
  FROM p CROSS JOIN c
  LEFT JOIN dots d0 ON d0.p = p.id AND d0.c = c.id AND d0.field = 0
  LEFT JOIN dots d1 ON d1.p = p.id AND d1.c = c.id AND d1.field = 1
  LEFT JOIN dots d2 ON d2.p = p.id AND d2.c = c.id AND d2.field = 2),
part AS (SELECT p, c, cname, dup, {zeroed} FROM raw),
tot AS (SELECT *, round({weights}, 12) AS total FROM part),
best AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY total DESC, c DESC) AS k FROM tot),
tops AS (SELECT p, comp, v, row_number() OVER (PARTITION BY p, comp ORDER BY v DESC) AS k FROM ({stacked})),
mix AS (SELECT p, comp, max(v) AS best, avg(v) FILTER (k <= 3) AS top3, avg(v) FILTER (k <= 10) AS top10 FROM tops GROUP BY ALL),
mixed AS (SELECT p, comp, best, top3, top10, round(0.45e0 * best + 0.35e0 * top3 + 0.2e0 * top10, 12) AS m FROM mix)"""


def _ranking_sql() -> str:
    columns = ", ".join(f"round(max(m) FILTER (comp = '{k}'), 6) AS {k}_component" for k in fixed.COMPONENT_WEIGHTS)
    return (
        company_sql(roles.POTENTIALS, roles.CUSTOMERS)
        + f""", wide AS (SELECT p, max(m) FILTER (comp = 'total') AS score, max(best) FILTER (comp = 'total') AS best,
  max(top3) FILTER (comp = 'total') AS top3, max(top10) FILTER (comp = 'total') AS top10,
  max(m) FILTER (comp = 'welfare') AS wf, max(m) FILTER (comp = 'industry') AS ind, {columns} FROM mixed GROUP BY p),
names AS (SELECT p, string_agg(cname, ' | ' ORDER BY k) AS top_names FROM best WHERE k <= 5 GROUP BY p),
dups AS (SELECT p, bool_or(dup) AS is_duplicate FROM tot GROUP BY p),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, wf DESC, ind DESC, p) AS rank,
  (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0) / count(*) OVER () * 100 AS pct FROM wide)
SELECT p AS id, rank, round(score, 6) AS score, round(best, 6) AS best, round(top3, 6) AS top3, round(top10, 6) AS top10,
  {', '.join(f'{k}_component' for k in fixed.COMPONENT_WEIGHTS)}, top_names, is_duplicate, round(pct, 6) AS percentile,
  1e0 AS coverage
FROM ranked JOIN names USING (p) JOIN dups USING (p)"""
    )


@check(_ranking_sql())
def lead_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers of the store ranked by their likeness to its suppliers, all six components."""
    ranking, _ = score(companies(spark, sf_dir, roles.CUSTOMERS), companies(spark, sf_dir, roles.POTENTIALS))
    return rounded(
        ranking.select(
            F.col(fixed.ROW_ORD).alias("id"),
            "rank",
            F.col("similarity_score").alias("score"),
            F.col("max_pair_similarity").alias("best"),
            F.col("top3_mean_similarity").alias("top3"),
            F.col("top10_mean_similarity").alias("top10"),
            *[F.col(name).alias(f"{k}_component") for k, name in COMPONENT_COLUMNS.items()],
            F.col("top_existing_customer_names").alias("top_names"),
            F.col("is_existing_customer_duplicate").alias("is_duplicate"),
            F.col("score_percentile").alias("percentile"),
            F.col("feature_coverage").alias("coverage"),
        )
    )


@check(
    company_sql(roles.POTENTIALS, roles.CUSTOMERS)
    + f""" SELECT p AS id, CAST(k AS INT) AS match_rank, cname AS existing_customer, round(total, 6) AS total,
  {', '.join(f'round({k}, 6) AS {k}' for k in fixed.COMPONENT_WEIGHTS)} FROM best WHERE k <= 5"""
)
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest suppliers of every customer with all component scores of the pair."""
    potentials = companies(spark, sf_dir, roles.POTENTIALS)
    matches = match_rows(potentials, company_scores(potentials, companies(spark, sf_dir, roles.CUSTOMERS)))
    return rounded(
        matches.select(
            F.col("potential_row_ord").alias("id"),
            "match_rank",
            "existing_customer",
            F.col("total_similarity").alias("total"),
            *[F.col(f"{k}_similarity").alias(k) for k in fixed.COMPONENT_WEIGHTS],
        )
    )


def _component(spark: SparkSession, sf_dir: str, potentials: str, customers: str, component: str) -> DataFrame:
    # the roles are joins and aggregates here; scoring reads its inputs several times
    scored = company_scores(*[cut(companies(spark, sf_dir, side)) for side in (potentials, customers)])
    return rounded(scored.select("id", pairs.mean_of_top(f"v_{component}", 1).alias("best"), pairs.top_mix(f"v_{component}").alias("mix")))


def _component_sql(potentials: str, customers: str, component: str) -> str:
    return (
        company_sql(potentials, customers)
        + f" SELECT p AS id, round(best, 6) AS best, round(m, 6) AS mix FROM mixed WHERE comp = '{component}'"
    )


@check(_component_sql(roles.SIZE_POTENTIALS, roles.SIZE_CUSTOMERS, "size"))
def size_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component(spark, sf_dir, roles.SIZE_POTENTIALS, roles.SIZE_CUSTOMERS, "size")


@check(_component_sql(roles.GEO_POTENTIALS, roles.GEO_CUSTOMERS, "location"))
def geo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component(spark, sf_dir, roles.GEO_POTENTIALS, roles.GEO_CUSTOMERS, "location")


@check(_component_sql(roles.SIGNAL_POTENTIALS, roles.SIGNAL_CUSTOMERS, "snack_signal"))
def signal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component(spark, sf_dir, roles.SIGNAL_POTENTIALS, roles.SIGNAL_CUSTOMERS, "snack_signal")


@check(_component_sql(roles.JACCARD_POTENTIALS, roles.JACCARD_CUSTOMERS, "industry"))
def jaccard_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag sets from the sizes of parts bought in bulk, per buyer and per supplier."""
    return _component(spark, sf_dir, roles.JACCARD_POTENTIALS, roles.JACCARD_CUSTOMERS, "industry")


@check(
    f"""WITH p AS ({duck(roles.POTENTIALS)}), c AS ({duck(roles.CUSTOMERS)})
SELECT p.id AS id, CAST(count(c.id) AS BIGINT) AS duplicate_customers FROM p LEFT JOIN c
  ON {SQL_KEY.format('p.name')} = {SQL_KEY.format('c.name')} OR p.cust_no = c.cust_no GROUP BY p.id"""
)
def duplicate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are the same company by name key or by number, counted without pairs."""
    p, c = (company_columns(companies(spark, sf_dir, t), "x").select("id", "name_key", "cust_no") for t in (roles.POTENTIALS, roles.CUSTOMERS))
    return duplicate_counts(p, c, "name_key", "cust_no", "id").select("id", "duplicate_customers")


@check(
    f"""WITH p AS ({duck(roles.GEO_POTENTIALS)}), n AS (SELECT *, '' AS profile FROM p)
SELECT id, round(((city <> '' OR district <> '')::INT) / 5e0, 6) AS coverage FROM n"""
)
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(company_columns(companies(spark, sf_dir, roles.GEO_POTENTIALS), "x").select("id", "coverage"))


# Every part of the coverage is there or not by itself.
COVERED = """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'about' ELSE ' ' END AS profile,
  CASE WHEN c_custkey % 3 = 0 THEN 'food' ELSE '' END AS w1, CASE WHEN c_custkey % 5 = 0 THEN 'trade' END AS industry,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS DOUBLE) END AS employees, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE '' END AS city FROM {customer}"""


@check("SELECT c_custkey AS id, round((" + " + ".join(f"(c_custkey % {n} = 0)::INT" for n in (2, 3, 5, 7, 11)) + ") / 5e0, 6) AS coverage FROM customer")
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of companies that lack any of the five parts, as the ranking carries it."""
    rows = cut(companies(spark, sf_dir, COVERED))
    ranking, _ = score(rows.filter(F.col(fixed.ROW_ORD) <= 20), rows)
    return rounded(ranking.select(F.col(fixed.ROW_ORD).alias("id"), F.col("feature_coverage").alias("coverage")))


@check(
    """WITH b AS (SELECT c_custkey AS id, floor(c_acctbal / 100) AS bucket FROM customer)
SELECT id, row_number() OVER (ORDER BY bucket DESC, id) AS rank,
  round((rank() OVER (ORDER BY bucket) + (count(*) OVER (PARTITION BY bucket) - 1) / 2e0) / count(*) OVER () * 100, 6) AS percentile FROM b"""
)
def rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of all customers by balance in hundreds, with the average rank of ties as percentile."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 100).cast("double").alias("bucket"))
    ranked, total = number_rows(rows, [F.col("bucket").desc(), F.col("id").asc()], "rank")
    return rounded(with_percentile(ranked, "bucket", "rank", total, "percentile").select("id", "rank", "percentile"))


@check("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred dearest order lines: a report of fixed length, kept by heap in every task."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return first_rows(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 100)


@check(
    """SELECT p_partkey, trim(trim(p_name) || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END || ' ' || p_type) AS combined,
  concat_ws('、', CASE WHEN p_size > 25 THEN 'big' END, p_type) AS tags FROM part"""
)
def text_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts joined by single spaces, and joined lists without blanks."""
    part = table(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    tags = F.array(F.when(F.col("p_size") > 25, " big ").otherwise("  "), F.col("p_type"))
    return part.select(
        "p_partkey",
        text.joined_text(F.concat(F.lit(" "), F.col("p_name")), brand, F.col("p_type")).alias("combined"),
        text.joined_values(tags).alias("tags"),
    )


@check(
    f"""WITH ranking AS ({_ranking_sql()}), fit AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM ranking WHERE NOT is_duplicate)
SELECT id, n - {fixed.TOP_LEADS} AS outreach_rank, rank, score, n - {fixed.TOP_LEADS} <= {fixed.LETTER_RANK_LIMIT} AS letter FROM fit
WHERE n > {fixed.TOP_LEADS} AND n <= 2 * {fixed.TOP_LEADS}"""
)
def weekly_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job twice: the leads of the first run are marked in the history, so the second one gets the next best."""
    root = scratch_path(spark, "weekly")
    for side, role in (("customers", roles.CUSTOMERS), ("potentials", roles.POTENTIALS)):
        companies(spark, sf_dir, role).write.parquet(f"{root}/{side}")
    options = dict(customers=f"{root}/customers", potentials=f"{root}/potentials", output=f"{root}/out", history=f"{root}/history")
    monday = datetime(2024, 6, 10, tzinfo=timezone.utc)
    first = weekly.run(spark, weekly.Options(**options, now=monday))
    weekly.mark_run(spark, first["output"], first["run_id"], first["history"], now=monday)
    second = weekly.run(spark, weekly.Options(**options, now=monday + timedelta(days=1)))
    leads = spark.read.parquet(second["top_leads"])
    return rounded(
        leads.select(F.col(fixed.ROW_ORD).alias("id"), "outreach_rank", "rank", F.col("similarity_score").alias("score"), F.col("manual_physical_letter").alias("letter"))
    )
