"""Profile building and name resolution queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.checks.roles import check, duck, run, table
from leadkin.functions import text
from leadkin.operators.columns import col
from leadkin.operators.industries import codes_in, one_hot
from leadkin.operators.resolve import keywords, resolve
from leadkin.session import fill_cores
from leadkin.plans.profiles import Landed, build_profiles, fresh_candidates
from leadkin.sources.landed import business_items, candidates, payload_records, posting_rows, registry_rows

LETTERS = "ABCDE"


@check(
    "SELECT o_custkey AS id, "
    + ", ".join(f"max((substr(o_orderpriority, 1, 1) = '{i + 1}')::INT) AS l{i}" for i in range(5))
    + ", concat_ws(',', "
    + ", ".join(f"max(CASE WHEN substr(o_orderpriority, 1, 1) = '{i + 1}' THEN '{fixed.INDUSTRY_FLAGS[i]}' END)" for i in range(5))
    + ") AS industry FROM orders GROUP BY 1"
)
def one_hot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as letters, one 0/1 column each, with the names in letter order."""
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", LETTERS)
    wide = one_hot(table(spark, sf_dir, "orders"), "o_custkey", letter)
    return wide.select(
        F.col("o_custkey").alias("id"), *[col(fixed.INDUSTRY_FLAGS[i]).alias(f"l{i}") for i in range(5)], F.col(fixed.INDUSTRY).alias("industry")
    )


ITEM = "concat('f', lpad(CAST(p_partkey % 50 AS STRING), 6, '0'), ' or I', lpad(CAST(p_size AS STRING), 5, '0'), ' ', p_name, ' F', lpad(CAST(p_size AS STRING), 6, '0'))"


@check(
    duck(
        f"""WITH c AS (SELECT p_partkey, unnest(regexp_extract_all(upper({ITEM}), '[A-Z]{{1,2}}[0-9]{{5,6}}')) AS code,
  generate_subscripts(regexp_extract_all(upper({ITEM}), '[A-Z]{{1,2}}[0-9]{{5,6}}'), 1) AS i FROM part),
d AS (SELECT p_partkey, code, min(i) AS i FROM c GROUP BY ALL)
SELECT p_partkey, string_agg(code, ',' ORDER BY i) AS codes FROM d GROUP BY 1""".replace("{1,2}", "@").replace("{5,6}", "&")
    ).replace("@", "{1,2}").replace("&", "{5,6}")
)
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct business codes of a text in order of appearance."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(codes_in(F.expr(ITEM))), ",").alias("codes"))


@check(
    """SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) AS brand, p_partkey * 1000e0 + 0.5e0 AS amount,
  NULL::DOUBLE AS none FROM part"""
)
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number of a text, thousands separators left out."""
    amount = F.concat(F.lit("about $"), F.col("p_partkey"), F.when(F.col("p_partkey") > 0, ",000.5").otherwise("0.50"), F.lit(" each"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.first_number(F.col("p_brand")).alias("brand"),
        text.first_number(amount).alias("amount"),
        text.first_number(F.col("p_type")).alias("none"),
    )


WORDS = ["the", "tion", "eau", "und", "email", "http", "zzzz"]


@check(
    "SELECT doc_id, concat_ws('、', "
    + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in WORDS)
    + ") AS words FROM documents"
)
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a list of words a whole document contains, in list order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.found_words(F.lower("text"), WORDS), "、").alias("words"))


CAPITAL = """CASE WHEN c_custkey % 7 = 0 THEN '暫不提供' WHEN c_custkey % 7 = 1 THEN concat('新台幣 ', CAST(c_custkey AS STRING), ',000 元')
  WHEN c_custkey % 7 = 2 THEN concat(CAST(c_custkey AS STRING), '億') WHEN c_custkey % 7 = 3 THEN concat(CAST(c_custkey AS STRING), '億2000萬')
  WHEN c_custkey % 7 = 4 THEN concat(CAST(c_custkey AS STRING), '.5 萬元') WHEN c_custkey % 7 = 5 THEN '' ELSE CAST(c_custkey AS STRING) END"""


@check(
    """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 1 THEN c_custkey * 1000e0 WHEN 2 THEN c_custkey * 1e8 WHEN 3 THEN c_custkey * 1e8 + 2e7
  WHEN 4 THEN (c_custkey + 0.5e0) * 1e4 WHEN 6 THEN c_custkey::DOUBLE END AS amount FROM customer"""
)
def capital_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.capital_amount(F.expr(CAPITAL)).alias("amount"))


CITY = "CASE c_custkey % 22 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fixed.CITIES)) + " END"
ADDRESS = f"""CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN concat({CITY}, '大安區路', CAST(c_custkey AS STRING), '號')
  WHEN c_custkey % 5 = 2 THEN concat({CITY}, '第一路5號') WHEN c_custkey % 5 = 3 THEN '東京' ELSE concat('(100)', {CITY}, '竹北鄉西路') END"""
AREA = f"CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat({CITY}, '信義區') END"


@check(
    f"""WITH a AS (SELECT c_custkey, {CITY} AS city, c_custkey % 5 AS k, c_custkey % 3 <> 0 AS area FROM customer)
SELECT c_custkey AS id, CASE WHEN k = 3 OR (k = 0 AND NOT area) THEN NULL ELSE city END AS city,
  CASE WHEN k = 3 OR (k = 0 AND NOT area) THEN NULL WHEN k = 1 THEN '大安區' WHEN k = 4 THEN '竹北鄉' WHEN area THEN '信義區' END AS district FROM a"""
)
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and district of an address, helped by the area text."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(ADDRESS).alias("address"), F.expr(AREA).alias("area"))
    return text.with_address_parts(rows, F.col("address"), F.col("area"), "city", "district").select("id", "city", "district")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result page per customer with two postings and one entry that is none."""
    key = F.col("c_custkey")
    linked = F.format_string('{"custName": " %s ", "link": {"cust": "https://x/company/k%d?a=1"}}', "c_name", key)
    plain = F.format_string('{"custName": "%s 有限公司", "custUrl": "", "companyUrl": "/company/k%d#b", "custNo": "n%d"}', "c_name", F.floor(key / 2).cast("long"), key)
    bare = F.format_string('{"custName": "%s", "custNo": " n%d ", "link": null}', F.when(key % 4 == 0, "").otherwise(F.col("c_name")), key)
    jobs = F.concat_ws(", ", F.lit("3"), linked, F.when(key % 2 == 0, plain).otherwise(bare))
    payload = F.when(key % 3 == 0, F.concat(F.lit('{"data": ['), jobs, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"data": {"list": ['), jobs, F.lit("]}}"))
    )
    return posting_rows(table(spark, sf_dir, "customer").select(key, payload.alias("payload")), "payload", "c_custkey")


@check(
    """WITH j AS (SELECT c_custkey AS page, 1 AS place, c_name AS name, 'k' || c_custkey AS no, lower(replace(c_name, '#', '')) AS key FROM customer
UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' 有限公司' WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END,
  CASE WHEN c_custkey % 2 = 0 THEN 'k' || (c_custkey // 2) ELSE 'n' || c_custkey END, lower(replace(c_name, '#', '')) FROM customer),
k AS (SELECT * FROM j WHERE name <> '' AND no NOT IN (SELECT 'k' || s_suppkey FROM supplier)
  AND key NOT IN (SELECT printf('customer%09d', s_suppkey * 2) FROM supplier)),
f AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY page, place) AS r FROM k)
SELECT row_number() OVER (ORDER BY page, place) AS cand_ord, name, no AS cust_no FROM f WHERE r = 1"""
)
def posting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of raw search pages, less the excluded ones, the first per number, in order."""
    key = F.col("s_suppkey")
    keys = table(spark, sf_dir, "supplier").select(F.format_string("customer%09d", key * 2).alias("company_key"))
    numbers = table(spark, sf_dir, "supplier").select(F.format_string("k%d", key).alias("cust_no"))
    return fresh_candidates(candidates(_postings(spark, sf_dir)), keys, numbers).select("cand_ord", "name", "cust_no")


@check(
    """WITH v AS (SELECT p_partkey AS id, p_name AS shown FROM part)
SELECT id, concat_ws('|', shown || ' (old)-x', CASE WHEN shown || '-x' <> shown || ' (old)-x' THEN shown || ' -x' END, shown || ' ',
  replace(shown, ' ', '')) AS keywords FROM v"""
)
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search keywords of a name with a bracket and a branch; those below three characters go."""
    name = F.concat(F.col("p_name"), F.lit(" (old)-x")).alias("name")
    rows = text.with_spellings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name), "name", "")
    return rows.select("id", F.array_join(keywords(F.col("words")), "|").alias("keywords"))


REGISTRY = """SELECT c_custkey AS reg_ord, concat(lower(c_mktsegment), ' works ', CAST(c_custkey AS STRING), ' 有限公司') AS Company_Name,
  CASE WHEN c_custkey % 13 = 5 THEN '' ELSE CAST(c_custkey AS STRING) END AS Business_Accounting_NO,
  CASE WHEN c_custkey % 10 = 9 THEN '02' WHEN c_custkey % 10 = 8 THEN '' ELSE '01' END AS Company_Status,
  CASE WHEN c_custkey % 11 = 3 THEN '解散' ELSE '核准設立' END AS Company_Status_Desc,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey * 10 AS STRING) END AS Capital_Stock_Amount FROM {customer}"""
TARGETS = """SELECT s.s_suppkey AS id, CASE WHEN s.s_suppkey % 6 = 0 THEN '' WHEN s.s_suppkey % 6 = 1 THEN concat('Other shop ', CAST(s.s_suppkey * 3 AS STRING), ' 股份有限公司')
  ELSE concat(lower(c.c_mktsegment), ' works ', CAST(c.c_custkey AS STRING), ' 有限公司') END AS official,
  CASE WHEN s.s_suppkey % 4 = 0 THEN concat(upper(c.c_mktsegment), ' works ', CAST(c.c_custkey AS STRING)) WHEN s.s_suppkey % 4 = 1 THEN concat('zz', CAST(s.s_suppkey AS STRING))
  ELSE concat(lower(c.c_mktsegment), ' works ', CAST(c.c_custkey AS STRING), ' 股份有限公司') END AS posted
  FROM {supplier} s CROSS JOIN (SELECT count(*) AS n FROM {customer}) m JOIN {customer} c ON c.c_custkey = s.s_suppkey * 13 % m.n"""

# These names hold no brackets, underscores or separators; an ideographic ending keeps
# only digits once Latin letters go, other names keep all their letters.
_NO_LATIN = "CASE WHEN contains({0}, '有限公司') THEN regexp_replace({0}, '[A-Za-z ]+', '', 'g') ELSE {0} END"
_CORE = f"regexp_replace(replace(lower({_NO_LATIN}), ' ', ''), '(股份有限公司|有限公司)$', '')"


def _resolved_sql(targets: str, registry: str) -> str:
    plain = lambda x: f"replace(lower({x}), ' ', '')"
    core, bare = (lambda x: _CORE.format(x)), (lambda x: _NO_LATIN.format(x))
    tier = lambda t: (
        f"CASE WHEN {t} = '' THEN NULL WHEN {plain(t)} = {plain('name')} THEN 0 "
        f"WHEN {core(t)} <> '' AND {core(t)} = {core('name')} THEN 1 "
        f"WHEN contains({plain(t)}, {plain('name')}) OR contains({plain('name')}, {plain(t)}) THEN 2 "
        f"WHEN {core(t)} <> '' AND {core('name')} <> '' AND (contains({core(t)}, {core('name')}) OR contains({core('name')}, {core(t)})) THEN 3 END"
    )
    words = " UNION ALL ".join(
        f"SELECT id, {i * 10 + j} AS o, {w} AS kw FROM t WHERE {n} <> ''"
        for i, n in enumerate(("official", "posted"))
        for j, w in enumerate((n, bare(n), core(n)))
    )
    return f"""t AS ({targets}), reg AS ({registry}),
usable AS (SELECT reg_ord, Company_Name AS name FROM reg WHERE Business_Accounting_NO <> '' AND Company_Status IN ('', '01') AND contains(Company_Status_Desc, '核准設立')),
kws AS (SELECT id, kw, min(o) AS o FROM ({words}) WHERE length(replace(kw, ' ', '')) >= 3 GROUP BY ALL),
cand AS (SELECT k.id, k.o, (k.kw <> u.name)::INT AS op, u.reg_ord, coalesce({tier('official')}, {tier('posted')}) AS tier
  FROM kws k JOIN usable u ON contains(u.name, k.kw) JOIN t ON t.id = k.id),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, op, tier, reg_ord) AS r FROM cand WHERE tier IS NOT NULL)"""


@check(
    f"""WITH {_resolved_sql(duck(TARGETS), duck(REGISTRY))}
SELECT id, reg_ord, ['exact', 'core_exact', 'partial', 'core_partial'][tier + 1] AS match_tier FROM best WHERE r = 1"""
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under varied names found in a registry of customers, without the fuzzy tier."""
    return resolve(run(spark, sf_dir, TARGETS), run(spark, sf_dir, REGISTRY), "id", ["official", "posted"], fuzzy=False)


# Names without an ideographic ending, one of two spellings with swapped letters.
PLAIN_REGISTRY = REGISTRY.replace(", ' 有限公司') AS Company_Name", ") AS Company_Name")
SWAPPED = """SELECT s_suppkey AS id, concat(lower(c_mktsegment), ' wroks ', CAST(c_custkey AS STRING)) AS official,
  concat(lower(c_mktsegment), ' works ', CAST(c_custkey AS STRING)) AS posted FROM {supplier} CROSS JOIN (SELECT count(*) AS n FROM {customer}) m JOIN {customer} ON c_custkey = s_suppkey * 13 % m.n"""


@check(
    duck(
        f"""WITH t AS ({SWAPPED}), reg AS ({PLAIN_REGISTRY}) SELECT id, reg_ord, 'core_fuzzy' AS match_tier FROM t JOIN reg ON Company_Name = posted
WHERE Business_Accounting_NO <> '' AND Company_Status <> '02' AND contains(Company_Status_Desc, '核准設立')
UNION ALL SELECT id, m.reg_ord, 'core_fuzzy' FROM t JOIN reg r ON r.Company_Name = posted, LATERAL (SELECT min(reg_ord) AS reg_ord FROM reg u
  WHERE starts_with(u.Company_Name, posted) AND Business_Accounting_NO <> '' AND Company_Status <> '02' AND contains(Company_Status_Desc, '核准設立')) m
WHERE NOT (r.Business_Accounting_NO <> '' AND r.Company_Status <> '02' AND contains(r.Company_Status_Desc, '核准設立')) AND m.reg_ord IS NOT NULL"""
    )
)
def name_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found by one spelling, judged by the first, which differs by two swapped letters."""
    return resolve(run(spark, sf_dir, SWAPPED), run(spark, sf_dir, PLAIN_REGISTRY), "id", ["official", "posted"])


def landed(spark: SparkSession, sf_dir: str) -> Landed:
    customers = fill_cores(table(spark, sf_dir, "customer"), "c_custkey")
    key = F.col("c_custkey")
    payload = F.format_string(
        '{"data": {"custName": "", "profile": "%s", "welfare": "零食 %s", "tagNames": ["a", " ", "咖啡"], "legalTagNames": "b", '
        '"address": "臺北市信義區路%d號", "capital": "%d萬", "empNo": "約 %d 人", "custLink": " http://s%d.com "}}',
        F.when(key % 4 == 0, "").otherwise("about"), "c_mktsegment", key, key, key, key,
    )
    payloads = payload_records(customers.filter("c_custkey % 9 <> 1").select(F.format_string("k%d", key).alias("cust_no"), payload.alias("payload")), "payload", "cust_no")
    rows = fill_cores(run(spark, sf_dir, REGISTRY), "reg_ord")
    fields = [c for c in rows.columns if c != "reg_ord"]
    shapes = [F.to_json(F.array(F.struct(*fields))), F.to_json(F.struct(F.array(F.struct(*fields)).alias("records"))), F.to_json(F.struct(*fields))]
    response = F.when(F.col("reg_ord") % 3 == 0, shapes[0]).when(F.col("reg_ord") % 3 == 1, shapes[1]).otherwise(shapes[2])
    registry = registry_rows(rows.select("reg_ord", response.alias("payload")), "payload", "reg_ord").drop("place")
    no = F.col("c_custkey").cast("string").alias("Business_Accounting_NO")
    code = F.concat(F.substring(F.lit("ABFIZ"), (key % 5 + 1).cast("int"), F.lit(1)), F.lpad(key.cast("string"), 6, "0"))
    item = F.format_string('[{"Cmp_Business": [{"Business_Item": "%s", "Business_Item_Desc": "x"}, "F203010 y"], "Business_Item": ""}]', code)
    lone = F.format_string('{"Cmp_Business": {"Business_Item": "", "Business_Item_Desc": "%s"}}', code)
    responses = customers.select(no, F.when(key % 2 == 0, item).otherwise(lone).alias("payload"))
    items = business_items(responses, "payload", "Business_Accounting_NO")
    jobs = customers.select(key.alias("page_ord"), F.lit(0).alias("place"), F.concat(F.lower("c_mktsegment"), F.lit(" works "), key.cast("string"), F.lit(" 有限公司")).alias("name"), F.format_string("k%d", key).alias("cust_no"))
    return Landed(jobs, payloads, registry, items)


_NAMED = "SELECT reg_ord AS id, '' AS official, Company_Name AS posted FROM (" + duck(REGISTRY) + ")"
_SQUEEZED = "regexp_replace(regexp_replace(lower({0}), '股份有限公司|有限公司', '', 'g'), '[^0-9a-z]+', '', 'g')"


@check(
    f"""WITH RECURSIVE {_resolved_sql(_NAMED, duck(REGISTRY))},
open AS (SELECT b.id, {_SQUEEZED.format('t.posted')} AS own, {_SQUEEZED.format('r.Company_Name')} AS matched, t.posted, r.Company_Name AS name,
    r.Capital_Stock_Amount AS cap, r.reg_ord AS reg, substr('ABFIZ', CAST(r.reg_ord % 5 + 1 AS INT), 1) AS l
  FROM best b JOIN t ON t.id = b.id JOIN reg r ON r.reg_ord = b.reg_ord WHERE b.r = 1),
rows AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM open WHERE reg % 2 = 0 OR l <> 'Z'),
turn AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS barred, false AS kept UNION ALL
  SELECT rows.i, CASE WHEN list_contains(barred, own) OR list_contains(barred, matched) THEN barred ELSE list_append(barred, matched) END,
    NOT (list_contains(barred, own) OR list_contains(barred, matched)) FROM turn JOIN rows ON rows.i = turn.i + 1),
kept AS (SELECT rows.*, id % 9 <> 1 AS has FROM rows JOIN turn USING (i) WHERE kept)
SELECT id AS cand, name, posted, concat('k', id) AS cust_no, CASE WHEN NOT has OR id % 4 = 0 THEN 'empty_profile' ELSE 'ok' END AS status,
  CASE WHEN has THEN concat('零食 ', c_mktsegment) ELSE '' END AS welfare, CASE WHEN has THEN 'a、咖啡' END AS tags, has AS has_signal,
  CASE WHEN has THEN '零食、咖啡' END AS words, CASE WHEN has THEN '台北市' END AS city, CASE WHEN has THEN '信義區' END AS district,
  CASE WHEN has THEN id::DOUBLE END AS employees, CASE WHEN cap IS NOT NULL THEN cap::DOUBLE WHEN has THEN id * 1e4 END AS capital,
  concat_ws(',', CASE WHEN l = 'A' THEN '{fixed.INDUSTRY_FLAGS[0]}' END, CASE WHEN l = 'B' THEN '{fixed.INDUSTRY_FLAGS[1]}' END,
    CASE WHEN l = 'F' OR reg % 2 = 0 THEN '{fixed.INDUSTRY_FLAGS[5]}' END, CASE WHEN l = 'I' THEN '{fixed.INDUSTRY_FLAGS[8]}' END) AS industry
FROM kept JOIN customer ON c_custkey = id"""
)
def profile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings, payloads and registry responses of the whole table to profiles."""
    built = build_profiles(landed(spark, sf_dir), target=None, fuzzy=False)
    return built.select(
        F.regexp_replace(col(fixed.CUST_NO), "^k", "").cast("long").alias("cand"),
        col(fixed.NAME).alias("name"),
        col("104_matched_company_name").alias("posted"),
        col(fixed.CUST_NO).alias("cust_no"),
        col("104_profile_status").alias("status"),
        col(fixed.WELFARE).alias("welfare"),
        col(fixed.WELFARE_TAGS).alias("tags"),
        col(fixed.SIGNAL).alias("has_signal"),
        col(fixed.SIGNAL_WORDS).alias("words"),
        col(fixed.CITY).alias("city"),
        col(fixed.DISTRICT).alias("district"),
        col(fixed.EMPLOYEES).alias("employees"),
        col(fixed.CAPITAL).alias("capital"),
        col(fixed.INDUSTRY).alias("industry"),
    )


_LIMITED = f"""WITH RECURSIVE {_resolved_sql(_NAMED, duck(REGISTRY))},
size AS (SELECT count(*) AS n FROM customer),
all_rows AS (SELECT t.id, {_SQUEEZED.format('t.posted')} AS own, {_SQUEEZED.format('r.Company_Name')} AS matched, r.Company_Name AS name,
    b.id IS NOT NULL AND (r.reg_ord % 2 = 0 OR r.reg_ord % 5 <> 4) AS usable, row_number() OVER (ORDER BY t.id) AS i
  FROM t LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.id = t.id LEFT JOIN reg r ON r.reg_ord = b.reg_ord),
turn AS (SELECT part, 0::BIGINT AS i, []::VARCHAR[] AS barred, 0::BIGINT AS looked, 0::BIGINT AS held, false AS kept, false AS counts,
    CASE part WHEN 'target' THEN n // 6 ELSE n END AS target, CASE part WHEN 'checked' THEN n // 3 ELSE n END AS most FROM size, (VALUES ('target'), ('checked')) v(part)
  UNION ALL
  SELECT part, x.i, CASE WHEN keep THEN list_append(barred, matched) ELSE barred END, looked + counts::BIGINT, held + keep::BIGINT, keep, x.counts, target, most
  FROM (SELECT turn.part, rows.i, turn.barred, turn.looked, turn.held, turn.target, turn.most, rows.matched,
      NOT list_contains(turn.barred, rows.own) AND turn.looked < turn.most AND turn.held < turn.target AS counts,
      NOT list_contains(turn.barred, rows.own) AND turn.looked < turn.most AND turn.held < turn.target AND rows.usable AND NOT list_contains(turn.barred, rows.matched) AS keep
    FROM turn JOIN all_rows rows ON rows.i = turn.i + 1) x)
SELECT part, r.id AS cand, r.name FROM turn JOIN all_rows r USING (i) WHERE kept"""


@check(_LIMITED)
def profile_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles until a sixth of the companies is kept, and until a third of them is looked at; batches from 50 on."""
    raw, n = landed(spark, sf_dir), table(spark, sf_dir, "customer").count()
    parts = [
        build_profiles(raw, target=target, max_candidates=most, fuzzy=False, first_batch=50).select(
            F.lit(part).alias("part"), F.regexp_replace(col(fixed.CUST_NO), "^k", "").cast("long").alias("cand"), col(fixed.NAME).alias("name")
        )
        for part, target, most in (("target", n // 6, n), ("checked", n, n // 3))
    ]
    return parts[0].unionByName(parts[1])
