"""Company profiles from landed postings, payloads and registry responses."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.operators.columns import fixed_layout
from leadkin.operators.dedupe import first_wins, keep_in_turn
from leadkin.operators.industries import company_industries
from leadkin.operators.lookup import left_lookup
from leadkin.operators.ranking import number_rows
from leadkin.operators.resolve import prepared, resolve
from leadkin.session import cut
from leadkin.sources.tables import Files

FIRST_BATCH = 1000


@dataclass(frozen=True)
class Landed:
    """Rows a crawl would have fetched.

    candidates: page_ord, place, name, cust_no
    payloads: cust_no and the fields of `sources.landed.payload_records`
    registry: unique reg_ord and the five registry fields
    items:    Business_Accounting_NO, item (a text that may hold codes)
    """

    candidates: DataFrame
    payloads: DataFrame
    registry: DataFrame
    items: DataFrame


def fresh_candidates(candidates: DataFrame, excluded_keys: DataFrame | None, excluded_numbers: DataFrame | None) -> DataFrame:
    """Candidates that are not excluded, the first one per customer number, numbered in order."""
    rows = candidates.withColumn("own_key", text.squeezed_company_key(F.col("name")))
    if excluded_numbers is not None:
        rows = rows.join(excluded_numbers.select(F.col("cust_no")).distinct(), "cust_no", "left_anti")
    if excluded_keys is not None:
        rows = rows.join(excluded_keys.select(F.col("company_key").alias("own_key")).distinct(), "own_key", "left_anti")
    first = first_wins(rows, ["cust_no"], ["page_ord", "place"])
    return number_rows(first, [F.col("page_ord"), F.col("place")], "cand_ord")[0].drop("place")


def final_records(rows: DataFrame) -> DataFrame:
    """The fixed layout; registry name and capital go before those of the job board."""
    out = rows.withColumns(
        {
            fixed.NAME: F.coalesce(text.present(F.col("Company_Name")), F.col("name")),
            fixed.CUST_NO: F.col("cust_no"),
            "104_matched_company_name": F.col("name"),
            "104_profile_status": F.when(text.blank(F.col(fixed.PROFILE)) != "", "ok").otherwise("empty_profile"),
            fixed.PROFILE: F.coalesce(fixed.PROFILE, F.lit("")),
            fixed.WELFARE: F.coalesce(fixed.WELFARE, F.lit("")),
            fixed.SIGNAL: F.coalesce(fixed.SIGNAL, F.lit(False)),
            fixed.EMPLOYEES: F.col("104_employee_count_number"),
            fixed.CAPITAL: F.coalesce(text.first_number(F.col("Capital_Stock_Amount")), F.col("104_capital_ntd")),
            fixed.ROW_ORD: F.col("cand_ord"),
        }
    )
    return fixed_layout(out, [*fixed.PROFILE_COLUMNS, fixed.ROW_ORD])


def fingerprint(raw: Landed, *more: DataFrame | None) -> str | None:
    """Changes when a file behind the inputs does; None if an input does not come from files. `more` are small and read."""
    spark = raw.candidates.sparkSession
    stamps = []
    for df in (raw.candidates, raw.payloads, raw.registry, raw.items):
        files = sorted(df.inputFiles())
        if not files:
            return None
        stamps += [Files(spark).stamp(f) for f in files]
    for df in more:
        stamps.append("" if df is None else str(tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())))
    return hashlib.md5("\n".join(stamps).encode()).hexdigest()


class Resolver:
    """Candidates with their payload, registry company and industries. The registry is prepared once, when first needed."""

    def __init__(self, raw: Landed, excluded_keys: DataFrame | None, fuzzy: bool):
        self.raw, self.excluded_keys, self.fuzzy = raw, excluded_keys, fuzzy
        self.known: DataFrame | None = None
        self.payloads = first_wins(raw.payloads, ["cust_no"], raw.payloads.columns)
        industries = company_industries(raw.items.withColumn("_number", text.blank(F.col("Business_Accounting_NO"))), "_number")
        self.industries = industries.filter(F.col(fixed.INDUSTRY) != "")

    def rows(self, candidates: DataFrame) -> DataFrame:
        if self.known is None:
            self.known = prepared(self.raw.registry)
        rows = left_lookup(candidates, self.payloads, ["cust_no"], F.col("cand_ord"))
        names = rows.select("cand_ord", F.coalesce("104_official_company_name", F.lit("")).alias("official"), "name")
        match = resolve(names, None, "cand_ord", ["official", "name"], self.fuzzy, self.known)
        registry = self.raw.registry.select("reg_ord", "Company_Name", text.blank(F.col("Business_Accounting_NO")).alias("_number"), "Capital_Stock_Amount")
        rows = rows.join(match, "cand_ord").join(registry, "reg_ord")
        rows = rows.withColumn("matched_key", text.squeezed_company_key(text.first_present(text.blank(F.col("Company_Name")), F.col("name"))))
        if self.excluded_keys is not None:
            barred = self.excluded_keys.select(F.col("company_key").alias("matched_key")).distinct()
            rows = rows.join(barred, "matched_key", "left_anti")
        return rows.join(self.industries, "_number")


def checked(candidates: DataFrame, kept: DataFrame) -> tuple[DataFrame, int]:
    """(cand_ord, checked): the candidates that are looked at, numbered; and how many.

    One whose own key a kept company of an earlier page has is left out when its page is collected.
    """
    bars = kept.filter("matched_key <> ''").select(F.col("matched_key").alias("own_key"), F.col("page_ord").alias("_page"))
    seen = left_lookup(candidates.select("cand_ord", "page_ord", "own_key"), bars, ["own_key"], F.col("cand_ord"))
    return number_rows(seen.filter(F.col("_page").isNull() | (F.col("_page") >= F.col("page_ord"))).select("cand_ord"), [F.col("cand_ord")], "checked")


def build_profiles(
    raw: Landed,
    excluded_keys: DataFrame | None = None,
    excluded_numbers: DataFrame | None = None,
    target: int | None = fixed.CRAWL_TARGET,
    max_candidates: int | None = None,
    fuzzy: bool = True,
    first_batch: int = FIRST_BATCH,
    store: str | None = None,
) -> DataFrame:
    """At most `target` profiles out of the first `max_candidates` candidates that are looked at, with `row_ord`.

    No target means all of them. A kept row depends on earlier ones only, so
    candidates are taken in batches, each twice as large as the one before,
    until enough are kept or looked at; later ones are never resolved. Each
    batch is stored when it is resolved. With `store`, a folder, and inputs
    that come from files, that is where it is kept: a run that starts again
    with the same inputs goes on behind its last finished batch.
    """
    rows = cut(fresh_candidates(raw.candidates, excluded_keys, excluded_numbers))
    total = rows.count()
    if max_candidates is None and target is not None:
        max_candidates = max(5 * target, target)
    resolver = Resolver(raw, excluded_keys, fuzzy)
    mark = fingerprint(raw, excluded_keys, excluded_numbers) if store else None
    spark = raw.candidates.sparkSession
    found: DataFrame | None = None
    done, step = 0, max(first_batch, target or 0)
    while True:
        upto = total if target is None and max_candidates is None else min(total, done + step)
        batch = rows.filter((F.col("cand_ord") > done) & (F.col("cand_ord") <= upto))
        if mark:
            path = f"{store}/{mark}-{int(fuzzy)}/{done}-{upto}"
            if not Files(spark).exists(f"{path}/_SUCCESS"):
                resolver.rows(batch).write.mode("overwrite").parquet(path)
            resolved = spark.read.parquet(path)
        else:
            resolved = cut(resolver.rows(batch))
        found = resolved if found is None else found.unionByName(resolved)
        done, step = upto, 2 * step
        kept = keep_in_turn(found, "cand_ord", "own_key", "matched_key")
        if max_candidates is None:
            looked_at = 0
        else:
            kept = cut(kept)
            numbered, looked_at = checked(rows.filter(F.col("cand_ord") <= done), kept)
            kept = cut(kept.join(numbered.filter(F.col("checked") <= max_candidates).select("cand_ord"), "cand_ord"))
        enough = (max_candidates is not None and looked_at >= max_candidates) or (target is not None and done < total and kept.limit(target).count() >= target)
        if done >= total or enough:
            return final_records(kept if target is None else kept.orderBy("cand_ord").limit(target))
