"""The whole weekly job: score, mark recent contacts, pick leads, write, record."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import history as rules
from leadkin.plans.scoring import score
from leadkin.session import freed
from leadkin.sources import history_store
from leadkin.sources.tables import exists, read_table, write_csv, write_run


@dataclass(frozen=True)
class Options:
    customers: str
    potentials: str
    output: str
    history: str
    now: datetime
    run_id: str | None = None
    build_potentials: bool = False
    target_leads: int = fixed.CRAWL_TARGET
    max_candidates: int | None = None
    recent_days: int = fixed.RECENT_DAYS
    top_n: int = fixed.TOP_LEADS
    mark_top_n: bool = False
    enrich_emails: bool = False
    min_success_ratio: float = fixed.MIN_SUCCESS_RATIO


def minimum_rows(target: int, ratio: float) -> int:
    return max(1, int(target * ratio))


def check_count(rows: int, target: int, ratio: float, label: str) -> None:
    needed = minimum_rows(target, ratio)
    if rows < needed:
        raise RuntimeError(f"{label}: {rows} usable companies, at least {needed} are needed ({ratio:.0%} of {target})")


def summary_row(ranking: DataFrame, score: str = "similarity_score", recent: str = "recently_developed") -> DataFrame:
    """Row count, score range and mean, duplicates and recent contacts in one row."""
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in ranking.columns else F.lit(0).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranking.agg(
        F.count("*").alias("potential_count"),
        zero(F.min(score)).alias("score_min"),
        zero(F.max(score)).alias("score_max"),
        zero(F.avg(score)).alias("score_mean"),
        count("is_existing_customer_duplicate").alias("duplicate_count"),
        count(recent).alias("recently_developed_in_ranking"),
    )


def email_count(leads: DataFrame, column: str = "Email") -> DataFrame:
    return leads.agg(F.count_if(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").alias("email_found_count"))


def run(spark: SparkSession, options: Options, raw=None, pages: DataFrame | None = None, payloads: DataFrame | None = None) -> dict:
    """Run the job and return its summary.

    `raw` holds the landed tables for building the potentials, `pages` and
    `payloads` those for looking up addresses; they stand in for a live crawl.
    """
    run_id = options.run_id or rules.run_id_of(options.now)
    out = options.output
    known = history_store.read(spark, options.history)
    potentials_path = options.potentials
    if options.build_potentials:
        from leadkin.plans.profiles import build_profiles

        names, numbers = rules.recent_keys(known, options.now, options.recent_days)
        built = build_profiles(
            raw,
            excluded_keys=names.select("company_key"),
            excluded_numbers=numbers.select("cust_no"),
            target=options.target_leads,
            max_candidates=options.max_candidates or max(5 * options.target_leads, options.target_leads),
            store=f"{out}/building/{run_id}",
        )
        potentials_path = write_run(built, f"{out}/profiles", run_id)
    customers, potentials = read_table(spark, options.customers), read_table(spark, potentials_path)
    if options.build_potentials:
        check_count(potentials.count(), options.target_leads, options.min_success_ratio, potentials_path)

    with freed(spark):
        ranking, matches = score(customers, potentials)
        ranking = rules.with_history(ranking, known, options.now, options.recent_days)
        ranking_path = write_run(ranking, f"{out}/ranking", run_id)
        matches_path = write_run(matches, f"{out}/top_matches", run_id)
        ranking = matches = None  # so that nothing refers to their shuffles
    ranking, matches = spark.read.parquet(ranking_path), spark.read.parquet(matches_path)

    leads = rules.top_leads(ranking, options.top_n)
    if options.enrich_emails:
        from leadkin.plans.enrich import enrich_emails

        leads = enrich_emails(leads, pages, payloads)
    leads_path = write_run(leads, f"{out}/top_leads", run_id)
    leads = spark.read.parquet(leads_path)
    csv = {name: write_csv(df, f"{out}/{name}_csv") for name, df in (("ranking", ranking.orderBy("rank")), ("top_matches", matches), ("top_leads", leads.orderBy("outreach_rank").coalesce(1)))}

    history_rows = None
    if options.mark_top_n:
        history_rows = history_store.append(
            leads, options.history, now=options.now, run_id=run_id, source="weekly", status="queued"
        ).count()
    totals = summary_row(ranking).first().asDict()
    return {
        "run_id": run_id,
        "built_before_score": options.build_potentials,
        "customers": options.customers,
        "potentials": potentials_path,
        "output": out,
        "history": options.history,
        **{f"{name}_csv": path for name, path in csv.items()},
        "ranking": ranking_path,
        "top_matches": matches_path,
        "top_leads": leads_path,
        **totals,
        "top_leads_count": leads.count(),
        "email_enrichment": options.enrich_emails,
        "email_found_count": email_count(leads).first()[0] if options.enrich_emails else None,
        "history_rows": history_rows,
    }


def mark_run(
    spark: SparkSession,
    output: str,
    run_id: str,
    history: str,
    *,
    now: datetime,
    top_n: int | None = None,
    status: str = "developed",
    source: str = "n8n",
    outcome: str | None = None,
    outcome_at: str | None = None,
) -> dict:
    """Put the first leads of a stored run into the history; all of them without `top_n`."""
    path = f"{output}/top_leads/run_id={run_id}"
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(path)
    leads = spark.read.parquet(path)
    if top_n is not None:
        leads = leads.orderBy("outreach_rank").limit(max(0, top_n))
    rows = history_store.append(leads, history, now=now, run_id=run_id, status=status, source=source, outcome=outcome, outcome_at=outcome_at).count()
    return {"run_id": run_id, "marked_count": leads.count(), "history": history, "history_rows": rows}


def print_summary(ranking: DataFrame) -> None:
    row = summary_row(ranking).first()
    print(f"companies {row['potential_count']}, score {row['score_min']:.4f} to {row['score_max']:.4f}, mean {row['score_mean']:.4f}")
    print(f"existing customers {row['duplicate_count']}")
    shown = ["rank", fixed.NAME, "similarity_score", "welfare_similarity_component", "industry_similarity_component", "top_existing_customer_names"]
    ranking.orderBy("rank").select(*[f"`{c}`" for c in shown]).show(20, truncate=False)
