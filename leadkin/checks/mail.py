"""Website and address queries with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.checks.roles import check, duck, run, table
from leadkin.operators.columns import col
from leadkin.operators.emails import best_email, email_points, emails_in, page_key, page_links, pages_to_read, website
from leadkin.plans.enrich import enrich_emails, pages_at

# Words of the test pages stand beside the real ones, which do not occur in them.
LINKS_SQL = """base AS (SELECT page_id, url, html, regexp_extract(url, '^[^/?#]*//[^/?#]*') AS base FROM pages),
hrefs AS (SELECT page_id, url, base, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM
  (SELECT page_id, url, base, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=["'']([^"'']+)["''][^>]*>', 1) AS l FROM base)),
links AS (SELECT page_id, url, base, i, base || href AS link FROM hrefs WHERE starts_with(href, '/'))"""
CONTACT_SQL = "(" + " OR ".join(f"contains(lower(link), '{w}')" for w in fixed.CONTACT_WORDS) + ")"


@check(f"WITH {LINKS_SQL} SELECT page_id, link, count(*) AS n FROM links GROUP BY ALL")
def page_links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, resolved against the page."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(page_links(F.col("url"), F.col("html"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@check(
    f"""WITH {LINKS_SQL}, all_pages AS (SELECT page_id, url AS link, 0 AS o FROM base
  UNION ALL SELECT page_id, base || p, o FROM base, (VALUES {', '.join(f"('{p}', {i + 1})" for i, p in enumerate(fixed.CONTACT_PATHS))}) v(p, o)
  UNION ALL SELECT page_id, link, 100 + i FROM links WHERE {CONTACT_SQL}),
once AS (SELECT page_id, link, min(o) AS o FROM all_pages GROUP BY ALL),
budget AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) AS k FROM once)
SELECT page_id, string_agg(link, ' ' ORDER BY k) AS pages FROM budget WHERE k <= 12 GROUP BY 1"""
)
def pages_of_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve pages to read for each home page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", page_links(F.col("url"), F.col("html")).alias("links"))
    return pages.select("page_id", F.array_join(pages_to_read(F.col("url"), F.col("links"), 12), " ").alias("pages"))


SITE = """CASE WHEN c_custkey % 8 = 0 THEN concat('www.firm', CAST(c_custkey AS STRING), '.com/x y') WHEN c_custkey % 8 = 1 THEN concat(' see HTTP://Firm', CAST(c_custkey AS STRING), '.com.tw/a,b')
  WHEN c_custkey % 8 = 2 THEN 'https://www.facebook.com/x' WHEN c_custkey % 8 = 3 THEN 'none' WHEN c_custkey % 8 = 4 THEN 'https://localhost/x'
  WHEN c_custkey % 8 = 5 THEN '' WHEN c_custkey % 8 = 6 THEN 'online.media.tw' ELSE concat('firm', CAST(c_custkey AS STRING), '.example.org') END"""


@check(
    """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'https://www.firm' || c_custkey || '.com/x' WHEN 1 THEN 'HTTP://Firm' || c_custkey || '.com.tw/a'
  WHEN 7 THEN 'https://firm' || c_custkey || '.example.org' ELSE '' END AS site FROM customer"""
)
def website_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web address of a company from free text, blank for sites that are not its own."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), website(F.expr(SITE)).alias("site"))


FOUND = """SELECT o_custkey AS site, o_orderkey % 5 AS page_ord, concat('https://firm', CAST(o_custkey AS STRING), '.com/', CAST(o_orderkey % 5 AS STRING)) AS url,
  CAST(o_orderkey % 4 + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END AS INT) AS ord, concat(CASE o_orderkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'team.sales' WHEN 2 THEN 'bob' ELSE 'contact' END,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('@firm', CAST(o_custkey AS STRING), '.com') ELSE '@mail.net' END) AS email,
  max(CAST(o_orderkey % 7 * 5 AS INT)) AS context FROM {orders} GROUP BY ALL"""


@check(
    f"""WITH f AS ({duck(FOUND)}),
e AS (SELECT site, email, max(context) AS context, min(page_ord * 10 + ord) AS place, arg_min(url, page_ord) AS url FROM f GROUP BY ALL),
s AS (SELECT *, context + CASE WHEN regexp_matches(split_part(email, '@', 1), 'info|contact|service|sales|support|business|marketing|hr|admin') THEN 30 ELSE 0 END
  + CASE WHEN split_part(email, '@', 2) = 'firm' || site || '.com' THEN 20 ELSE 0 END
  + CASE WHEN split_part(email, '@', 1) IN ('info', 'contact', 'service', 'sales') THEN 10 ELSE 0 END AS points FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY points DESC, place) AS k FROM s)
SELECT site, max(email) FILTER (k = 1) AS email, max(url) FILTER (k = 1) AS url, string_agg(email, ' | ' ORDER BY place, email) AS candidates FROM p GROUP BY 1"""
)
def best_email_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best address of each site, its page, and all addresses in order of discovery."""
    host = F.concat(F.lit("firm"), F.col("site").cast("string"), F.lit(".com"))
    return best_email(run(spark, sf_dir, FOUND), "site", host)


@check(
    """WITH e AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'hr.team' WHEN 2 THEN 'bob' ELSE 'sales' END AS local,
  CASE c_custkey % 3 WHEN 0 THEN 'firm.com' WHEN 1 THEN 'shop.firm.com' ELSE 'b.org' END AS domain FROM customer)
SELECT c_custkey AS id, CAST((c_custkey % 50) + CASE WHEN local = 'bob' THEN 0 ELSE 30 END + CASE WHEN domain = 'b.org' THEN 0 ELSE 20 END
  + CASE WHEN local IN ('info', 'sales') THEN 10 ELSE 0 END AS INT) AS points FROM e"""
)
def address_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of given addresses for a given site."""
    local = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'hr.team' WHEN 2 THEN 'bob' ELSE 'sales' END")
    domain = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'firm.com' WHEN 1 THEN 'shop.firm.com' ELSE 'b.org' END")
    points = email_points(F.concat(local, F.lit("@"), domain), F.lit("firm.com"), (F.col("c_custkey") % 50).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), points.cast("int").alias("points"))


def _any_of(values: list[str]) -> str:
    return "(" + "|".join(re.escape(v) for v in values) + ")"


def emails_sql(source: str, id: str, gmail_only: bool = False) -> str:
    """Addresses in the texts of `source` (id, text); named entities are the only escapes that it decodes.

    Addresses are put between guard characters, in two steps because two of
    them may share the character between them; the text between is the context.
    """
    email, edge = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\p{L}\\p{N}_.+\\-"
    guarded = f"regexp_replace(text, '(^|[^{edge}])({email})($|[^{edge}])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    again = f"regexp_replace(t, '([^{edge}\\x01])({email})($|[^{edge}\\x02])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    points = " + ".join(
        f"CASE WHEN regexp_matches(shown, '{_any_of(words)}') THEN {fixed.CONTEXT_POINTS[kind]} ELSE 0 END"
        for kind, words in (("strong", fixed.STRONG_CONTEXTS), ("weak", fixed.WEAK_CONTEXTS), ("negative", fixed.NEGATIVE_CONTEXTS))
    )
    return f"""WITH plain AS (SELECT {id}, replace(replace(replace(replace(text, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS text FROM ({source})),
marked AS (SELECT {id}, {again} AS t FROM (SELECT {id}, {guarded} AS t FROM plain)),
parts AS (SELECT {id}, string_split(t, chr(1)) AS p FROM marked WHERE contains(t, chr(1))),
each AS (SELECT {id}, unnest(range(2, len(p) + 1)) AS k, p FROM parts),
cut AS (SELECT {id}, k, lower(trim(split_part(p[k], chr(2), 1), '.,;:()[]{{}}<>"''')) AS email,
  lower(right(CASE WHEN k = 2 THEN p[1] ELSE split_part(p[k - 1], chr(2), 2) END, {fixed.CONTEXT_CHARS})) AS low FROM each),
valid AS (SELECT *, regexp_replace(regexp_replace(low, '<[^>]+>|\\s+', ' ', 'g'), ' +', ' ', 'g') AS shown FROM cut
  WHERE NOT regexp_matches(email, '^{_any_of(fixed.BAD_LOCAL_PREFIXES)}') AND NOT regexp_matches(split_part(email, '@', 1), '(%|u00)[0-9a-f]{{2}}|{_any_of(fixed.BAD_LOCAL_PARTS)}')
  AND NOT regexp_matches(split_part(email, '@', 2), '(^|\\.){_any_of(fixed.BAD_TLDS)}$|{_any_of(fixed.BAD_DOMAIN_ENDS)}$') AND NOT starts_with(email, '@')),
rated AS (SELECT {id}, email, min(k) AS k, max({points} + CASE WHEN contains(right(low, {fixed.MAILTO_CHARS}), 'mailto:') THEN {fixed.CONTEXT_POINTS["mailto"]} ELSE 0 END) AS context FROM valid GROUP BY ALL),
placed AS (SELECT {id}, CAST(row_number() OVER (PARTITION BY {id} ORDER BY k) - 1 AS INT) AS ord, email, CAST(context AS INT) AS context FROM rated)
SELECT * FROM placed{" WHERE ends_with(email, '@gmail.com')" if gmail_only else ""}"""


@check(emails_sql("SELECT doc_id, text FROM documents", "doc_id"))
def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid addresses in all documents with the points of their context."""
    return emails_in(table(spark, sf_dir, "documents"), "doc_id", "text")


@check(emails_sql("SELECT page_id, html AS text FROM pages", "page_id"))
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all pages."""
    return emails_in(table(spark, sf_dir, "pages"), "page_id", "html")


# Every document with addresses of many forms put into it, by its number.
MIXED = """SELECT doc_id, concat(coalesce(text, ''), CASE doc_id % 8 WHEN 0 THEN ' contact email: a.b@gmail.com c@gmail.com' WHEN 1 THEN ' <a href="mailto:Info@Gmail.com">mail</a> 退訂 info@gmail.com'
  WHEN 2 THEN ' noreply@gmail.com x@shop.test, y@img.png; z%2f@b.com' WHEN 3 THEN ' 客服信箱 <b>help@firm.com.tw</b>' WHEN 4 THEN ' (.dot@gmail.com) end@gmail.com.'
  WHEN 5 THEN ' 公司聯絡信箱me@gmail.com' WHEN 6 THEN concat(' mail u', CAST(doc_id AS STRING), '@gmail.com,u', CAST(doc_id AS STRING), '@gmail.com;v@other.org') ELSE ' a@b a@@gmail.com' END) AS text FROM {documents}"""


@check(emails_sql(duck(MIXED), "doc_id"))
def mixed_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents that all have some: valid and refused, with and without words before them."""
    return emails_in(run(spark, sf_dir, MIXED), "doc_id", "text")


@check(emails_sql(duck(MIXED), "doc_id", gmail_only=True))
def gmail_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only addresses at Gmail."""
    return emails_in(run(spark, sf_dir, MIXED), "doc_id", "text", gmail_only=True)


# The address of every page as a lead might write it.
ASKED = """SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^http://', 'https://') WHEN 2 THEN concat(url, '#contact')
  WHEN 3 THEN CASE WHEN contains(url, 'www.') THEN replace(url, 'www.', '') ELSE replace(url, '//', '//www.') END
  ELSE CASE WHEN contains(url, '?') OR contains(url, '#') THEN url ELSE concat(url, '/') END END AS asked FROM {pages}"""
_KEY = """regexp_replace(regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/+$', ''), '$',
  regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1))"""


@check(
    f"""WITH asked AS ({duck(ASKED)}), k AS (SELECT page_id, html, {_KEY} AS key FROM pages), a AS (SELECT id, {_KEY.replace("url", "asked")} AS key FROM asked),
first AS (SELECT key, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM k GROUP BY key)
SELECT id, length(html) AS size FROM a JOIN first USING (key)"""
)
def site_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page found by another spelling of its address: scheme, www., last slash, fragment."""
    asked = run(spark, sf_dir, ASKED)
    found = pages_at(asked.select(F.col("asked").alias("url")), table(spark, sf_dir, "pages"))
    sizes = found.select("key", F.length("html").cast("long").alias("size"))
    return asked.select("id", page_key(F.col("asked")).alias("key")).join(sizes, "key").select("id", "size")


@check(
    f"""WITH k AS (SELECT page_id, url, html, {_KEY} AS key FROM pages), hits AS (SELECT key FROM k WHERE page_id IN (SELECT c_custkey % (SELECT count(*) FROM pages) FROM customer)),
first AS (SELECT arg_min(url, page_id) AS url, arg_min(html, page_id) AS html FROM k WHERE key IN (SELECT key FROM hits) GROUP BY key)
SELECT url, length(html) AS size FROM first"""
)
def pages_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the corpus for the addresses many leads ask for, each page once."""
    pages = table(spark, sf_dir, "pages")
    number = pages.agg(F.count("*").alias("n"))  # one row
    ask = table(spark, sf_dir, "customer").crossJoin(number).select((F.col("c_custkey") % F.col("n")).alias("page_id")).join(pages.select("page_id", "url"), "page_id")
    return pages_at(ask, pages).select("url", F.length("html").cast("long").alias("size"))


@check(
    """WITH l AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'own' WHEN 1 THEN 'corpus' WHEN 2 THEN 'absent' WHEN 3 THEN 'blank' WHEN 4 THEN 'landed' ELSE 'bad' END AS kind FROM customer)
SELECT id, CASE kind WHEN 'own' THEN 'existing_email' WHEN 'corpus' THEN 'found' WHEN 'landed' THEN 'found' WHEN 'absent' THEN 'homepage_request_failed' ELSE 'missing_website' END AS email_status,
  CASE WHEN kind = 'own' THEN 'me@own.com' WHEN kind IN ('corpus', 'landed') THEN 'info@site' || (id // 6) || '.com' ELSE '' END AS email,
  CASE WHEN kind IN ('corpus', 'landed') THEN 'https://site' || (id // 6) || '.com' ELSE '' END AS source,
  CASE WHEN kind = 'corpus' OR kind = 'landed' THEN 'https://site' || (id // 6) || '.com' WHEN kind = 'absent' THEN 'gone.com' WHEN kind = 'bad' THEN '' ELSE '' END AS site FROM l"""
)
def email_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with an address of their own, with a site in the corpus, with a missing or blank site."""
    key = F.col("c_custkey")
    kind = key % 6
    site = F.concat(F.lit("https://site"), F.floor(key / 6).cast("string"), F.lit(".com"))
    customers = table(spark, sf_dir, "customer")
    leads = customers.select(
        key.alias(fixed.ROW_ORD),
        F.format_string("k%d", key).alias(fixed.CUST_NO),
        F.when(kind == 0, "call me@own.com ").when(kind == 3, "not an address").alias("contact_email"),
        F.when(kind == 1, site).when(kind == 2, "gone.com").when(kind == 5, "facebook.com/x").otherwise("").alias(fixed.WEBSITE),
    )
    payloads = customers.filter(kind == 4).select(F.format_string("k%d", key).alias("cust_no"), site.alias("website"))
    homes = customers.select(F.floor(key / 6).alias("page_id"), site.alias("url")).distinct()
    local = F.concat(F.lit("info@site"), F.col("page_id").cast("string"), F.lit(".com"))
    corpus = homes.select("page_id", "url", F.concat(F.lit("<p>boss@other.org 聯絡信箱: "), local, F.lit("</p>")).alias("html"))
    out = enrich_emails(leads, corpus, payloads)
    return out.select(
        F.col(fixed.ROW_ORD).alias("id"),
        "email_status",
        F.col("Email").alias("email"),
        F.col("email_source_url").alias("source"),
        col(fixed.WEBSITE).alias("site"),
    )
