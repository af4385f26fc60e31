"""Contact addresses for leads from a corpus of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.operators.columns import col, conform
from leadkin.operators.emails import bare_host, best_email, emails_in, existing_email, page_key, page_links, pages_to_read, website
from leadkin.operators.lookup import left_lookup, may_match
from leadkin.session import cut


def pages_at(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, url, html) of the corpus for the wanted addresses, the first page of each.

    Addresses are compared by host, path and query: scheme, `www.`, a last
    slash and what follows # do not decide which page a site returns. Pages
    without a page_id are not read.
    """
    # chosen by the narrow columns, so that the texts are read once; pages nobody asks for are dropped
    # by a bitmap on the workers, so neither their names nor their texts are moved
    keyed = pages.filter("page_id is not null").withColumn("key", page_key(F.col("url")))
    wanted = urls.select(page_key(F.col("url")).alias("key")).distinct()
    first = may_match(keyed, wanted, ["key"]).join(wanted, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("page_id", "url"), F.struct("page_id", "url")).alias("page"))
    first = first.select("key", "page.page_id", "page.url")
    first = cut(first)
    return may_match(keyed, first, ["key", "page_id", "url"]).join(first, ["key", "page_id", "url"]).select("key", "url", "html")


def site_emails(sites: DataFrame, pages: DataFrame, max_pages: int = fixed.PAGES_PER_SITE, gmail_only: bool = False) -> DataFrame:
    """(site, reached, email, url, candidates) for distinct home page addresses.

    Each site and each page is worked on once, however many leads share it; the
    corpus is read for home pages and once more for the other pages of the sites.
    """
    homes = sites.select("site").distinct()
    front = homes.withColumn("key", page_key(F.col("site"))).join(pages_at(homes.withColumnRenamed("site", "url"), pages), "key")
    reached = cut(front.select("site", page_links(F.col("site"), F.col("html")).alias("links")))
    wanted = reached.select(
        "site", F.posexplode(pages_to_read(F.col("site"), F.col("links"), max_pages)).alias("page_ord", "url")
    ).withColumn("key", page_key(F.col("url")))
    found = emails_in(pages_at(wanted, pages), "key", "html", gmail_only)
    best = best_email(wanted.join(found, "key"), "site", bare_host(F.col("site")))
    out = homes.join(reached.select("site", F.lit(True).alias("reached")), "site", "left").join(best, "site", "left")
    return cut(out)  # a few values per site, which the caller reads several times


def enrich_emails(
    leads: DataFrame,
    pages: DataFrame,
    payloads: DataFrame | None = None,
    *,
    max_pages: int = fixed.PAGES_PER_SITE,
    gmail_only: bool = False,
) -> DataFrame:
    """Leads with Email, website, email_source_url, email_status and email_candidates.

    `pages` is (page_id, url, html); a page that is not in it counts as a failed
    request. `payloads` is (cust_no, website) and fills in missing websites.
    """
    key = fixed.ROW_ORD
    leads = conform(leads, dict.fromkeys(["Email", fixed.WEBSITE, "email_source_url", "email_status", "email_candidates"], ""))
    number = text.blank(col(fixed.CUST_NO)) if fixed.CUST_NO in leads.columns else F.lit("")
    state = leads.select(key, number.alias("cust_no"), website(col(fixed.WEBSITE)).alias("own"))
    state = left_lookup(state, _websites(payloads, leads), ["cust_no"], F.col(key))
    state = state.join(existing_email(leads, key, gmail_only), key, "left")
    state = state.withColumn("site", F.coalesce(F.nullif("own", F.lit("")), "landed", F.lit("")))
    open_sites = state.filter(F.col("existing").isNull() & (F.col("site") != "")).select("site")
    state = left_lookup(state, site_emails(open_sites, pages, max_pages, gmail_only), ["site"], F.col(key))

    is_open = F.col("existing").isNull()
    visited = is_open & (F.col("site") != "")
    status = (
        F.when(~is_open, "existing_email")
        .when(~visited, "missing_website")
        .when(F.col("reached").isNull(), "homepage_request_failed")
        .when(F.col("email").isNull(), "email_not_found")
        .otherwise("found")
    )
    new = state.select(
        key,
        F.struct(
            F.when(~is_open, F.col("existing")).when(visited, F.coalesce("email", F.lit(""))).alias("Email"),
            F.when(is_open & (F.col("own") == ""), F.col("site")).alias(fixed.WEBSITE),
            F.when(visited, F.coalesce("url", F.lit(""))).alias("email_source_url"),
            status.alias("email_status"),
            F.when(visited, F.coalesce("candidates", F.lit(""))).alias("email_candidates"),
        ).alias("_new"),
    )
    changed = ["Email", fixed.WEBSITE, "email_source_url", "email_status", "email_candidates"]
    value = lambda c: F.coalesce(F.col(f"_new.`{c}`"), col(c)).alias(c) if c in changed else col(c)
    return leads.join(new, key).select(*[value(c) for c in leads.columns])


def _websites(payloads: DataFrame | None, leads: DataFrame) -> DataFrame:
    spark = leads.sparkSession
    if payloads is None:
        return spark.createDataFrame([], "cust_no string, landed string")
    rows = payloads.select(text.blank(F.col("cust_no")).alias("cust_no"), F.nullif(website(F.col("website")), F.lit("")).alias("landed"))
    return rows.groupBy("cust_no").agg(F.min("landed").alias("landed"))
