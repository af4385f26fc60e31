"""Contact history: defaults, recent contacts, latest contact per company."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.operators.columns import col, compact_leads, conform, fixed_layout
from leadkin.operators.dedupe import keep_last
from leadkin.operators.lookup import left_lookup
from leadkin.session import cut

# Order in which rows came into the history.
ORDER = ["batch", "row_ord"]
LAYOUT = [*fixed.HISTORY_COLUMNS, *ORDER]
SCHEMA = ", ".join([f"`{c}` string" for c in fixed.HISTORY_COLUMNS] + [f"{c} bigint" for c in ORDER])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def layout(df: DataFrame) -> DataFrame:
    """The eleven history columns as text plus the stored order; absent columns are null."""
    df = fixed_layout(conform(df, dict.fromkeys(ORDER, 0)), LAYOUT)
    return df.select(*[col(c).cast("string").alias(c) for c in fixed.HISTORY_COLUMNS], *[F.col(c).cast("long") for c in ORDER])


def iso(moment: datetime) -> str:
    return moment.replace(microsecond=0).isoformat()


def run_id_of(moment: datetime) -> str:
    return moment.strftime("%Y%m%d_%H%M%S")


def records(
    leads: DataFrame,
    *,
    now: datetime,
    run_id: str,
    batch: int = 0,
    source: str = "n8n",
    status: str = "developed",
    outcome: str | None = None,
    outcome_at: str | None = None,
) -> DataFrame:
    """History rows of contacted leads; what a lead says itself goes before the arguments."""
    has = lambda name: text.clean(col(name)) if name in leads.columns else F.lit("")
    raw = lambda name: col(name).cast("string") if name in leads.columns else F.lit(None).cast("string")
    name = F.coalesce(F.nullif(raw(fixed.NAME), F.lit("")), raw("company_name"))
    values = {
        "developed_at": text.first_present(has("developed_at"), has("manual_outreach_at"), has("outcome_at"), F.lit(iso(now))),
        "company_name": text.clean(name),
        "company_key": text.company_key(name),
        fixed.CUST_NO: has(fixed.CUST_NO),
        "rank": raw("rank"),
        "similarity_score": raw("similarity_score"),
        "source": text.first_present(has("source"), F.lit(source)),
        "status": text.first_present(has("status"), F.lit(status)),
        "outcome": text.first_present(has("outcome"), F.lit(outcome).cast("string")),
        "outcome_at": text.first_present(has("outcome_at"), has("manual_outreach_at"), F.lit(outcome_at).cast("string")),
        "run_id": F.lit(run_id),
    }
    order = F.col(fixed.ROW_ORD) if fixed.ROW_ORD in leads.columns else F.monotonically_increasing_id()
    return leads.select(
        *[v.alias(k) for k, v in values.items()], F.lit(batch).cast("long").alias("batch"), order.cast("long").alias("row_ord")
    )


def merged(history: DataFrame, new: DataFrame) -> DataFrame:
    return keep_last(layout(history).unionByName(layout(new)), fixed.HISTORY_DEDUPE_KEYS, ORDER)


def is_recent(now: datetime, days: int, whole_words: bool = False) -> Column:
    """Contacted within the window or won for good; a date that cannot be read is not recent."""
    in_window = text.instant(F.col("developed_at")) >= F.lit(now) - F.make_interval(days=F.lit(days))
    won = text.is_won(F.col("status"), F.col("outcome"), F.col("source"), whole_words=whole_words)
    return F.coalesce(in_window, F.lit(False)) | won


def recent(history: DataFrame, now: datetime, days: int, whole_words: bool = False) -> DataFrame:
    return history.filter(is_recent(now, days, whole_words))


CONTACTS = "kind string, key string, latest struct<ts: timestamp, batch_down: bigint, row_down: bigint, at: string>, won boolean"


def contacts(history: DataFrame) -> DataFrame:
    """kind ('name' or 'number'), key, latest, won: what is known of every key, from one pass over the history.

    `latest` is the latest readable contact, of which the earlier row wins a tie; `won` says
    whether any contact was won for good. Each row gives its name keys and its number; the
    aggregate combines on the map side, so a key with a third of all rows costs a row per task.
    """
    latest = F.struct(
        text.instant(F.col("developed_at")).alias("ts"), (-F.col("batch")).alias("batch_down"), (-F.col("row_ord")).alias("row_down"),
        text.clean(F.col("developed_at")).alias("at"),
    )
    names = F.array_distinct(F.array(text.clean(F.col("company_key")), text.company_key(F.col("company_name"))))
    key = lambda kind: lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    keys = F.concat(F.transform(names, key("name")), F.array(key("number")(text.clean(col(fixed.CUST_NO)))))
    won = F.coalesce(text.is_won(F.col("status"), F.col("outcome"), F.col("source")), F.lit(False))
    rows = history.select(keys.alias("keys"), latest.alias("latest"), won.alias("won"))
    each = rows.select(F.explode("keys").alias("k"), F.when(F.col("latest.ts").isNotNull(), F.col("latest")).alias("latest"), "won")
    return folded(each.filter("k.key <> ''").select("k.kind", "k.key", "latest", "won"))


def folded(found: DataFrame) -> DataFrame:
    """One row per key of contacts, or of earlier results of this; order and repetition do not matter."""
    return found.groupBy("kind", "key").agg(F.max("latest").alias("latest"), F.bool_or("won").alias("won"))


def as_of(found: DataFrame, now: datetime, days: int) -> DataFrame:
    """kind, key, at, recent: the latest contact as text, and whether the key was contacted within the window or won for good."""
    in_window = F.col("latest.ts") >= F.lit(now) - F.make_interval(days=F.lit(days))
    return found.select("kind", "key", F.col("latest.at").alias("at"), (F.coalesce(in_window, F.lit(False)) | F.col("won")).alias("recent"))


def summary(history: DataFrame, now: datetime, days: int) -> DataFrame:
    return as_of(contacts(history), now, days)


def _of(found: DataFrame, kind: str, name: str) -> DataFrame:
    return found.filter(F.col("kind") == kind).select(F.col("key").alias(name), "at", "recent")


def recent_keys(history: DataFrame, now: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """(company_key, recent) and (cust_no, recent), one row per key."""
    found = cut(summary(history, now, days).filter("recent"))
    return _of(found, "name", "company_key").drop("at"), _of(found, "number", "cust_no").drop("at")


def with_history(ranking: DataFrame, history: DataFrame | None, now: datetime, days: int, known: DataFrame | None = None) -> DataFrame:
    """Ranking plus company_key, last_developed_at and recently_developed.

    `known`, if given, is what a stream keeps of every key; the history is not read then.
    """
    number = text.clean(col(fixed.CUST_NO)) if fixed.CUST_NO in ranking.columns else F.lit("")
    found = cut(as_of(contacts(history) if known is None else known, now, days))
    names = _of(found, "name", "company_key").withColumnsRenamed({"at": "_name_at", "recent": "_name_recent"})
    numbers = _of(found, "number", "cust_no").withColumnsRenamed({"at": "_number_at", "recent": "_number_recent"})
    spread = F.col(fixed.ROW_ORD)
    out = ranking.withColumn("company_key", text.company_key(col(fixed.NAME))).withColumn("cust_no", number)
    out = left_lookup(out, names, ["company_key"], spread)
    out = left_lookup(out, numbers, ["cust_no"], spread)
    flag = F.coalesce("_name_recent", F.lit(False)) | F.coalesce("_number_recent", F.lit(False))
    return out.select(
        *[col(c) for c in ranking.columns],
        "company_key",
        F.coalesce("_number_at", "_name_at").alias("last_developed_at"),
        flag.alias("recently_developed"),
    )


def is_eligible(df: DataFrame) -> Column:
    flag = lambda c: F.coalesce(col(c).cast("boolean"), F.lit(False)) if c in df.columns else F.lit(False)
    return ~flag("is_existing_customer_duplicate") & ~flag("recently_developed")


def top_leads(ranking: DataFrame, n: int = fixed.TOP_LEADS) -> DataFrame:
    """The n best companies that are neither customers nor recently contacted."""
    # the window only ever sees the n rows of the report
    leads = ranking.filter(is_eligible(ranking)).orderBy("rank").limit(n)
    if "outreach_rank" not in leads.columns:
        leads = leads.select(F.row_number().over(Window.orderBy("rank")).cast("long").alias("outreach_rank"), "*")
    return leads.withColumn("n8n_should_email", F.lit(True)).withColumn(
        "manual_physical_letter", F.col("outreach_rank") <= fixed.LETTER_RANK_LIMIT
    )


def lead_page(leads: DataFrame, limit: int = 0, compact: bool = False) -> DataFrame:
    """The first leads for serving; zero means all of them."""
    page = leads.orderBy("outreach_rank").limit(limit) if limit > 0 else leads
    return compact_leads(page) if compact else page


def demo_rows(leads: DataFrame) -> DataFrame:
    value = lambda c: col(c) if c in leads.columns else F.lit(None)
    shown = lambda c: F.coalesce(value(c).cast("string"), F.lit(""))
    return leads.select(
        F.coalesce(F.nullif(value("outreach_rank").cast("long"), F.lit(0)), value("rank").cast("long")).alias("rank"),
        value(fixed.NAME).alias("company"),
        F.replace(F.format_number(F.coalesce(value("similarity_score").cast("double"), F.lit(0.0)), 4), F.lit(","), F.lit("")).alias("score"),
        shown(fixed.CITY).alias("city"),
        shown(fixed.SIGNAL_WORDS).alias("snack_signals"),
    )
