"""Contact addresses in texts and on websites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.functions.udfs import absolute_links, find_emails
from leadkin.operators.columns import col



def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, fixed.HOST, 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def page_key(url: Column) -> Column:
    """What an address asks a site for: host without www., path without a last slash, query."""
    path = F.regexp_extract(url, "^[^/?#]*//[^/?#]*([^?#]*)", 1)
    return F.concat(bare_host(url), F.regexp_replace(path, "/+$", ""), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def website(value: Column) -> Column:
    """First link or domain in a text as a web address; blank for hosts that are no company site."""
    raw = text.blank(value)
    link, domain = F.regexp_extract(raw, fixed.LINK, 0), F.regexp_extract(raw, fixed.DOMAIN, 0)
    found = F.when(link != "", link).otherwise(domain)
    url = F.when(found.rlike("(?i)^https?://"), found).otherwise(F.concat(F.lit("https://"), found))
    host = host_of(url)
    skipped = reduce(lambda a, b: a | b, [F.contains(host, F.lit(d)) for d in fixed.SKIPPED_HOSTS])
    whole = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return F.when((found != "") & F.contains(host, F.lit(".")) & ~skipped & whole, url).otherwise("")


def page_links(base: Column, html: Column) -> Column:
    return absolute_links(base, F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(fixed.HREF), F.lit(1)))


def is_contact_link(link: Column, home: Column) -> Column:
    return (bare_host(link) == bare_host(home)) & text.contains_any(F.lower(link), fixed.CONTACT_WORDS)


def pages_to_read(home: Column, links: Column, limit: int) -> Column:
    """Home page, fixed contact paths, then contact links of the home page; the first `limit`, each once."""
    base = F.regexp_extract(home, "^[^/?#]*//[^/?#]*", 0)
    fixed_pages = [F.concat(base, F.lit(p)) for p in fixed.CONTACT_PATHS]
    found = F.filter(links, lambda link: is_contact_link(link, home))
    return F.slice(F.array_distinct(F.concat(F.array(home, *fixed_pages), found)), 1, limit)


def emails_in(df: DataFrame, id: str, value: str, gmail_only: bool = False) -> DataFrame:
    """(id, ord, email, context): valid addresses of each text, each once."""
    # find_emails needs an @; any escape might be one, other texts stay in the JVM
    maybe = F.col(value).rlike("@|%[0-9A-Fa-f]|u0040|&[#a-zA-Z]")
    found = df.filter(maybe).select(id, F.explode(find_emails(F.col(value))).alias("e")).select(id, "e.ord", "e.email", "e.context")
    return found.filter(F.col("email").endswith("@gmail.com")) if gmail_only else found


def email_points(email: Column, site_host: Column, context: Column) -> Column:
    """Context plus points for role words, the site's own domain and plain role names."""
    local, domain = F.split_part(email, F.lit("@"), F.lit(1)), F.regexp_extract(email, "@(.*)$", 1)
    role = text.contains_any(local, fixed.ROLE_WORDS)
    own = F.contains(site_host, domain) | F.endswith(domain, site_host)
    named = local.isin(fixed.ROLE_NAMES)
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        F.coalesce(context, F.lit(0))
        + points(role, fixed.ROLE_WORD_POINTS)
        + points(own, fixed.OWN_DOMAIN_POINTS)
        + points(named, fixed.ROLE_NAME_POINTS)
    )


def best_email(found: DataFrame, site: str, host: Column) -> DataFrame:
    """Per site: the best address, its first page, and all addresses in order of discovery.

    `found` has (site, page_ord, url, ord, email, context); at most one row per
    site, page and address.
    """
    place = F.struct("page_ord", "ord")
    per_email = found.groupBy(site, "email").agg(
        F.max("context").alias("context"), F.min(place).alias("place"), F.min_by("url", "page_ord").alias("url")
    )
    rated = per_email.withColumn("points", email_points(F.col("email"), host, F.col("context")))
    first = F.struct(-F.col("place.page_ord"), -F.col("place.ord"))
    return rated.groupBy(site).agg(
        F.max_by(F.struct("email", "url"), F.struct("points", first.alias("first"))).alias("best"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "email"))), lambda x: x.email), " | ").alias("candidates"),
    ).select(site, F.col("best.email").alias("email"), F.col("best.url").alias("url"), "candidates")


def existing_email(df: DataFrame, key: str, gmail_only: bool = False) -> DataFrame:
    """(key, existing): the first valid address a row already has, by column, then by position."""
    columns = [c for c in fixed.EMAIL_COLUMNS if c in df.columns]
    if not columns:
        return df.select(key, F.lit(None).cast("string").alias("existing")).limit(0)
    cells = df.select(key, F.posexplode(F.array(*[col(c).cast("string") for c in columns])).alias("place", "cell"))
    cells = cells.withColumn("at", F.struct(key, "place"))
    found = emails_in(cells, "at", "cell", gmail_only)
    return found.groupBy(F.col(f"at.{key}").alias(key)).agg(F.min_by("email", F.struct("at.place", "ord")).alias("existing"))
