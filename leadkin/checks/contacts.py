"""Contact history queries with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.checks.roles import check, rounded, table
from leadkin.functions import text
from leadkin.operators import history as rules
from leadkin.operators.columns import as_json, col, compact_leads, fixed_layout, json_safe
from leadkin.operators.dedupe import first_wins
from leadkin.operators.ranking import last_rows, number_rows
from leadkin.plans.weekly import email_count, minimum_rows, summary_row
from leadkin.session import scratch_path
from leadkin.sources import history_store
from leadkin.sources.landed import fields, lead_rows
from leadkin.sources.tables import Files, latest_run, read_leads, read_table, write_csv, write_run
from leadkin.streaming import latest as latest_stream
from leadkin.streaming.history import ingest

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
STATUS = "CASE event_type WHEN 'purchase' THEN 'Closed_Won' WHEN 'error' THEN 'queued' ELSE event_type END"

# Events as a contact history: every 17th time cannot be read, every 5th user has no number.
HISTORY_SQL = f"""h AS (SELECT event_id, user_id, date_trunc('second', ts) AS at,
  CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS developed_at,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE date_trunc('second', ts) END AS known,
  printf('customer%09d', user_id) AS company_key,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS cust_no, {STATUS} AS status FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = events.select(
        F.when(F.col("event_id") % 17 == 0, "soon").otherwise(at).alias("developed_at"),
        F.format_string("Customer#%09d 有限公司", F.col("user_id")).alias("company_name"),
        F.lit("").alias("company_key"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias(fixed.CUST_NO),
        F.lit("n8n").alias("source"),
        F.expr(STATUS).alias("status"),
        F.lit(1).cast("long").alias("batch"),
        F.col("event_id").alias("row_ord"),
    )
    return rules.layout(rows)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a ranking."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias(fixed.NAME),
        F.col("c_custkey").cast("string").alias(fixed.CUST_NO),
        F.col("c_custkey").alias(fixed.ROW_ORD),
        F.col("c_acctbal").alias("similarity_score"),
        (F.col("c_custkey") % 10 == 0).alias("is_existing_customer_duplicate"),
    )


@check(f"WITH {HISTORY_SQL} SELECT event_id, developed_at, status FROM h WHERE known >= TIMESTAMP '2024-01-24' OR status = 'Closed_Won'")
def recent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of the last seven days, or won for good."""
    return rules.recent(history(spark, sf_dir), NOW, 7).select(F.col("row_ord").alias("event_id"), "developed_at", "status")


LATEST_SQL = f"""WITH {HISTORY_SQL},
recent AS (SELECT * FROM h WHERE known >= TIMESTAMP '2024-01-24' OR status = 'Closed_Won'),
names AS (SELECT company_key, max(known) AS at, arg_max(developed_at, known) AS text FROM h WHERE known IS NOT NULL GROUP BY 1),
numbers AS (SELECT cust_no, max(known) AS at, arg_max(developed_at, known) AS text FROM h WHERE known IS NOT NULL AND cust_no <> '' GROUP BY 1),
flagged AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS company_key, coalesce(n.text, m.text) AS last_developed_at,
  (lower(replace(c_name, '#', '')) IN (SELECT company_key FROM recent)
   OR CAST(c_custkey AS VARCHAR) IN (SELECT cust_no FROM recent WHERE cust_no <> '')) AS recently_developed, c_acctbal, c_custkey % 10 = 0 AS dup
  FROM customer LEFT JOIN numbers n ON n.cust_no = CAST(c_custkey AS VARCHAR)
  LEFT JOIN names m ON m.company_key = lower(replace(c_name, '#', '')))"""


@check(LATEST_SQL + " SELECT id, company_key, last_developed_at, recently_developed FROM flagged")
def latest_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest contact by number, else by name, and whether it is recent."""
    out = rules.with_history(people(spark, sf_dir), history(spark, sf_dir), NOW, 7)
    return out.select(F.col(fixed.ROW_ORD).alias("id"), "company_key", "last_developed_at", "recently_developed")


def _leads(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    ranked = rules.with_history(people(spark, sf_dir), history(spark, sf_dir), NOW, 7)
    ranked, _ = number_rows(ranked, [F.col("similarity_score").desc(), F.col(fixed.ROW_ORD)], "rank")
    return rules.top_leads(ranked, n)


LEADS_SQL = (
    LATEST_SQL
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, id) AS rank FROM flagged),
leads AS (SELECT row_number() OVER (ORDER BY rank) AS outreach_rank, * FROM
  (SELECT * FROM ranked WHERE NOT dup AND NOT recently_developed ORDER BY rank LIMIT 100))"""
)


@check(
    LEADS_SQL
    + " SELECT outreach_rank, rank, id, true AS n8n_should_email, outreach_rank <= 10 AS manual_physical_letter FROM leads"
)
def eligible_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best customers that are neither duplicates nor recently contacted."""
    return _leads(spark, sf_dir).select(
        "outreach_rank", "rank", F.col(fixed.ROW_ORD).alias("id"), "n8n_should_email", "manual_physical_letter"
    )


@check(
    LEADS_SQL
    + """ SELECT outreach_rank AS rank, c_name AS company, printf('%.4f', leads.c_acctbal) AS score, '' AS city, '' AS snack_signals
  FROM leads JOIN customer ON c_custkey = id WHERE outreach_rank <= 20"""
)
def lead_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First twenty leads in the short public form."""
    return rules.demo_rows(rules.lead_page(_leads(spark, sf_dir), limit=20))


@check(
    f"""WITH {HISTORY_SQL}, again AS (SELECT *, event_id + 1000000000 AS seq, 2 AS batch FROM h WHERE event_id % 3 = 0
  UNION ALL SELECT *, event_id, 1 FROM h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY developed_at, company_key, cust_no, status ORDER BY batch DESC, seq DESC) AS k FROM again)
SELECT developed_at, company_key, cust_no, status, batch::BIGINT AS batch, seq AS row_ord FROM ranked WHERE k = 1"""
)
def history_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History merged with a third of its rows stored once more; the last row per key stays."""
    old = history(spark, sf_dir).withColumn("company_key", text.company_key(F.col("company_name")))
    again = old.filter(F.col("row_ord") % 3 == 0).withColumn("row_ord", F.col("row_ord") + 1000000000).withColumn("batch", F.lit(2).cast("long"))
    return rules.merged(old, again).select("developed_at", "company_key", col(fixed.CUST_NO).alias("cust_no"), "status", "batch", "row_ord")


@check("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per user."""
    return first_wins(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@check(
    f"""WITH {HISTORY_SQL} SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN '2024-01-31T00:00:00+00:00' WHEN event_id % 3 = 1 THEN strftime(e.ts, '%Y-%m-%dT%H:%M:%S') ELSE '2024-01-02' END AS developed_at,
  company_key, CASE WHEN event_id % 2 = 0 THEN 'developed' ELSE event_type END AS status, 'shop' AS source,
  CASE WHEN event_id % 7 = 0 THEN event_type END AS outcome,
  CASE WHEN event_id % 3 = 2 THEN '2024-01-02' END AS outcome_at, 'r1' AS run_id, CAST(event_id AS VARCHAR) AS rank
FROM h JOIN events e USING (event_id)"""
)
def history_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact rows with gaps turned into history rows."""
    events = table(spark, sf_dir, "events")
    rest = F.col("event_id") % 3
    leads = events.select(
        F.col("event_id").alias(fixed.ROW_ORD),
        F.when(rest == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("  ").alias("developed_at"),
        F.when(rest == 2, "2024-01-02").alias("outcome_at"),
        F.format_string("Customer#%09d 有限公司", "user_id").alias("company_name"),
        F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("outcome"),
        F.col("event_id").alias("rank"),
    )
    rows = rules.records(leads, now=NOW, run_id="r1", source="shop")
    return rows.select(F.col("row_ord").alias("event_id"), "developed_at", "company_key", "status", "source", "outcome", "outcome_at", "run_id", "rank")


@check("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fields(F.col("props"))["k"].cast("long").alias("k"))


@check(
    """SELECT 'c' || user_id AS company_name, event_type AS status, count(*) AS n FROM events GROUP BY ALL"""
)
def json_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads from JSON payloads: lists and objects with a list, mixed with entries that are no leads."""
    lead = F.format_string('{"company_name": "c%d", "status": "%s"}', "user_id", "event_type")
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[7, "), lead, F.lit("]"))).otherwise(
        F.concat(F.lit('{"leads": ['), lead, F.lit("]}"))
    )
    payloads = table(spark, sf_dir, "events").select(payload.alias("payload"))
    return lead_rows(payloads, "payload", "company_name string, status string").groupBy("company_name", "status").agg(F.count("*").alias("n"))


@check(
    """SELECT event_id, CASE WHEN event_id % 10 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type FROM events"""
)
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made safe for JSON and read back from it."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    rows = events.select("event_id", value.alias("value"), "ts", "event_type")
    back = as_json(rows).select(F.from_json("json", json_safe(rows).schema).alias("r")).select("r.*")
    return back.select("event_id", "value", "ts", "event_type")


@check("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred events, in stored order: a page of fixed length."""
    return last_rows(table(spark, sf_dir, "events"), ["ts", "event_id"], 100).select("event_id", "user_id", "event_type")


@check("SELECT c_custkey AS rank, c_name AS name, c_acctbal AS similarity_score, NULL::VARCHAR AS matched, c_custkey::VARCHAR AS number FROM customer")
def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed layouts over a table that has only some of the columns."""
    rows = people(spark, sf_dir).withColumn("rank", F.col(fixed.ROW_ORD))
    compact = compact_leads(rows)
    wanted = ["rank", fixed.NAME, "similarity_score", fixed.CUST_NO]
    if compact.columns != wanted:
        raise ValueError(compact.columns)
    full = fixed_layout(compact, [*wanted, "104_matched_company_name"])
    return full.select("rank", col(fixed.NAME).alias("name"), "similarity_score", col("104_matched_company_name").cast("string").alias("matched"), col(fixed.CUST_NO).alias("number"))


@check(
    LATEST_SQL
    + """ SELECT count(*) AS potential_count, round(min(c_acctbal), 4) AS score_min, round(max(c_acctbal), 4) AS score_max,
  round(avg(c_acctbal), 4) AS score_mean, count_if(dup)::BIGINT AS duplicate_count, count_if(recently_developed)::BIGINT AS recently_developed_in_ranking,
  count_if(id % 4 = 1)::BIGINT AS email_found_count FROM flagged"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = rules.with_history(people(spark, sf_dir), history(spark, sf_dir), NOW, 7)
    leads = ranking.withColumn("Email", F.when(F.col(fixed.ROW_ORD) % 4 == 1, "a@b.com").when(F.col(fixed.ROW_ORD) % 4 == 2, " "))
    one = rounded(summary_row(ranking), 4).withColumn("one", F.lit(1))
    return one.join(email_count(leads).withColumn("one", F.lit(1)), "one").drop("one")


@check(
    """SELECT c_nationkey, count(*) AS rows, greatest(1, CAST(floor(100 * 0.5e0) AS BIGINT)) AS needed, count(*) >= 50 AS passes FROM customer GROUP BY 1"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nation yields at least half of a hundred companies."""
    needed = minimum_rows(100, 0.5)
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rows"))
    return rows.select("c_nationkey", "rows", F.lit(needed).cast("long").alias("needed"), (F.col("rows") >= needed).alias("passes"))


@check("SELECT c_custkey::VARCHAR AS number, c_name AS name, c_acctbal AS similarity_score FROM customer")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking written as a run and as CSV, and read back from both."""
    root = scratch_path(spark, "ranking")
    rows = people(spark, sf_dir)
    write_run(rows.limit(0), root, "20240101_000000")
    write_run(rows, root, "20240131_000000")
    stored = latest_run(spark, root)
    csv = read_leads(spark, write_csv(stored.select(col(fixed.NAME), col(fixed.CUST_NO), "similarity_score", fixed.ROW_ORD), f"{root}.csv"))
    both = stored.select(col(fixed.CUST_NO)).join(csv, fixed.CUST_NO)
    return both.select(col(fixed.CUST_NO).alias("number"), col(fixed.NAME).alias("name"), F.col("similarity_score").cast("double").alias("similarity_score"))


STREAM_SQL = f"""WITH {HISTORY_SQL}, k AS (SELECT DISTINCT developed_at, company_key, status FROM h)
SELECT developed_at, company_key, status FROM k"""


@check(STREAM_SQL.replace("k AS (SELECT DISTINCT developed_at,", "k AS (SELECT DISTINCT CASE WHEN developed_at = 'soon' THEN '2024-01-31T00:00:00+00:00' ELSE developed_at END AS developed_at,"))
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream of contacts into the stored history, then compacted and read back."""
    root = scratch_path(spark, "history")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    contacts = events.select(
        F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("developed_at"),
        F.format_string("Customer#%09d 有限公司", "user_id").alias("company_name"),
        F.expr(STATUS).alias("status"),
        F.col("event_id").alias(fixed.ROW_ORD),
    )
    query = ingest(contacts, root, f"{root}-progress", now=NOW, run_id="stream")
    query.awaitTermination()
    history_store.compact(spark, root)
    if [c.level for c in history_store.commits(spark, root)] != [1]:
        raise RuntimeError("the history was not compacted")
    return history_store.read(spark, root).select("developed_at", "company_key", "status")


@check(STREAM_SQL.replace("k AS (SELECT DISTINCT developed_at,", "k AS (SELECT DISTINCT CASE WHEN developed_at = 'soon' THEN '2024-01-31T00:00:00+00:00' ELSE developed_at END AS developed_at,"))
def history_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history from an append, a stream, a merge, the stream gone on, another append, and a new stream whose checkpoint lies where the first one's was: no row is lost."""
    root = scratch_path(spark, "history")
    arrivals = f"{root}-arrivals"
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 17 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("developed_at"),
        F.format_string("Customer#%09d 有限公司", "user_id").alias("company_name"),
        F.expr(STATUS).alias("status"),
        F.col("event_id").alias(fixed.ROW_ORD),
    )
    part = lambda n: events.filter(F.col(fixed.ROW_ORD) % 5 == n)

    def arrive(n: int, place: str = arrivals) -> None:
        part(n).write.mode("append").parquet(place)
        stream = spark.readStream.schema(events.schema).parquet(place)
        ingest(stream, root, f"{root}-progress", now=NOW, run_id="stream").awaitTermination()

    history_store.add(part(0), root, now=NOW, run_id="first")
    arrive(1)
    history_store.compact(spark, root)
    arrive(2)
    history_store.add(part(3), root, now=NOW, run_id="last")
    history_store.compact(spark, root)
    Files(spark).delete(f"{root}-progress", whole=True)
    arrive(4, f"{root}-later")
    return history_store.read(spark, root).select("developed_at", "company_key", "status")


@check("SELECT doc_id::VARCHAR AS doc_id, text FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks and quotes through a CSV file."""
    path = write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{scratch_path(spark, 'texts')}.csv")
    return read_table(spark, path).select("doc_id", "text")


@check("SELECT c_custkey AS id, concat('Customer#', lpad(c_custkey::VARCHAR, 9, '0')) AS name FROM customer")
def read_parquet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table through the reader that adds a row number."""
    rows = read_table(spark, f"{sf_dir}/customer.parquet")
    if fixed.ROW_ORD not in rows.columns:
        raise ValueError(rows.columns)
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@check(LATEST_SQL + " SELECT id, company_key, last_developed_at, recently_developed FROM flagged")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest contact and recent flag from what a stream keeps of every key: late and repeated rows, a merge in between, a second stream."""
    root = scratch_path(spark, "latest")
    rows = history(spark, sf_dir)

    def arrive(n: int, stream: int) -> None:
        place = f"{root}-arrivals-{stream}"
        rows.filter(F.col("row_ord") % 3 == n).write.mode("append").parquet(place)
        events = spark.readStream.schema(rows.schema).parquet(place)
        latest_stream.ingest(events, root, f"{root}-progress-{stream}").awaitTermination()

    for n, stream in ((1, 0), (0, 0), (1, 0)):
        arrive(n, stream)
    latest_stream.compact(spark, root)
    arrive(2, 1)
    out = rules.with_history(people(spark, sf_dir), None, NOW, 7, known=latest_stream.read(spark, root))
    return out.select(F.col(fixed.ROW_ORD).alias("id"), "company_key", "last_developed_at", "recently_developed")
