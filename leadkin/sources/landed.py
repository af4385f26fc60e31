"""Raw JSON as it was landed, turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text

POSTING = "custName string, custUrl string, companyUrl string, custNo string, link string"
REGISTRY_FIELDS = [
    "Company_Name",
    "Business_Accounting_NO",
    "Company_Status",
    "Company_Status_Desc",
    "Capital_Stock_Amount",
]
PAYLOAD_FIELDS = [
    "custName", "profile", "welfare", "tagNames", "legalTagNames", "address", "addrNoDesc", "capital",
    "industryDesc", "industryNo", "indcat", "empNo", "custLink", "phone", "hrName", "news",
]
COMPANY_LINK = r"/company/([^/?#'\" ]+)"


def is_object(json: Column) -> Column:
    return F.ltrim(json).startswith("{")


def is_list(json: Column) -> Column:
    return F.ltrim(json).startswith("[")


def members(json: Column) -> Column:
    """Members of a JSON list, each as JSON text; null if it is no list."""
    return F.when(is_list(json), F.from_json(json, "array<string>"))


def fields(json: Column) -> Column:
    return F.from_json(F.when(is_object(json), json), "map<string,string>")


def posting_rows(pages: DataFrame, payload: str, order: str) -> DataFrame:
    """One row per posting of search result pages; `data` is a list or holds one under `list`."""
    pages = pages.select(F.col(order).alias("page_ord"), fields(F.col(payload))["data"].alias("_data"))
    pages = pages.select("page_ord", "_data", fields(F.col("_data"))["list"].alias("_list"))
    found = F.coalesce(members(F.col("_data")), members(F.col("_list")))
    rows = pages.select("page_ord", F.posexplode(found).alias("place", "json"))
    return rows.filter(is_object(F.col("json"))).select("page_ord", "place", F.from_json("json", POSTING).alias("job")).select(
        "page_ord", "place", "job.*"
    )


def posted_number() -> Column:
    """Customer number from the company link of a posting, else from its number field."""
    in_link = lambda url: F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), COMPANY_LINK, 1), F.lit(""))
    linked = fields(F.col("link"))["cust"]
    return F.coalesce(in_link(linked), in_link(F.col("custUrl")), in_link(F.col("companyUrl")), text.present(F.col("custNo")))


def candidates(postings: DataFrame) -> DataFrame:
    """(page_ord, place, name, cust_no) of the postings that have both."""
    rows = postings.select("page_ord", "place", text.blank(F.col("custName")).alias("name"), posted_number().alias("cust_no"))
    return rows.filter((F.col("name") != "") & F.col("cust_no").isNotNull())


def response_rows(responses: DataFrame, payload: str, *keep: str) -> DataFrame:
    """One row per object of a registry response: a list, a list under a known key, or one object."""
    json = F.col(payload)
    responses = responses.select(*keep, payload, fields(json).alias("_fields"))
    inner = [members(F.col("_fields")[key]) for key in ("data", "records", "result", "results")]
    found = F.coalesce(members(json), *inner, F.when(is_object(json), F.array(json)))
    rows = responses.select(*keep, F.posexplode(found).alias("place", "json"))
    return rows.filter(is_object(F.col("json")))


def registry_rows(responses: DataFrame, payload: str, *keep: str) -> DataFrame:
    rows = response_rows(responses, payload, *keep).select(*keep, "place", fields(F.col("json")).alias("_fields"))
    return rows.select(*keep, "place", *[F.col("_fields")[f].alias(f) for f in REGISTRY_FIELDS])


def business_items(responses: DataFrame, payload: str, *keep: str) -> DataFrame:
    """(keep…, place, item): every text that may hold business codes, in reading order."""
    rows = response_rows(responses, payload, *keep).select(*keep, "place", fields(F.col("json")).alias("_fields"))
    rows = rows.select(*keep, "place", F.col("_fields")["Cmp_Business"].alias("_listed"), F.col("_fields")["Business_Item"].alias("_own"))
    listed = F.col("_listed")
    entries = F.coalesce(members(listed), F.when(is_object(listed), F.array(listed)), F.expr("cast(array() as array<string>)"))
    texts = F.transform(
        entries,
        lambda e: F.when(is_object(e), F.concat_ws("\n", fields(e)["Business_Item"], fields(e)["Business_Item_Desc"])).otherwise(e),
    )
    whole = F.concat(texts, F.array(F.coalesce("_own", F.lit(""))))
    return rows.select(*keep, "place", F.posexplode(whole).alias("item_place", "item"))


def payload_records(payloads: DataFrame, payload: str, *keep: str) -> DataFrame:
    """The 22 fields of a raw company payload; blanks are null except in the two long texts."""
    rows = payloads.select(*keep, fields(F.col(payload)).alias("_outer"))
    rows = rows.select(*keep, "_outer", F.col("_outer")["data"].alias("_data"))
    body = F.when(is_object(F.col("_data")), fields(F.col("_data"))).otherwise(F.col("_outer"))
    rows = rows.select(*keep, body.alias("_v"))
    return flat_payload(rows.select(*keep, *[F.col("_v")[f].alias(f) for f in PAYLOAD_FIELDS]), *keep)


def _tags(name: str) -> Column:
    """A list joined to text, or the text itself."""
    return F.when(is_list(F.col(name)), text.joined_values(members(F.col(name)))).otherwise(text.blank(F.col(name)))


def flat_payload(values: DataFrame, *keep: str) -> DataFrame:
    values = text.with_address_parts(values, F.col("address"), F.col("addrNoDesc"), fixed.CITY, fixed.DISTRICT)
    values = values.select("*", _tags("tagNames").alias("_tags"), _tags("legalTagNames").alias("_legal"), text.blank(F.col("welfare")).alias("_welfare"))
    values = values.withColumn("_told", F.concat_ws("\n", F.lower("_welfare"), F.lower("_tags")))
    values = values.withColumn("_words", F.array_join(text.found_words(F.col("_told"), fixed.SNACK_WORDS), "、"))
    words = F.col("_words")
    none = lambda c: F.nullif(c, F.lit(""))
    return values.select(
        *keep,
        text.present(F.col("custName")).alias("104_official_company_name"),
        text.blank(F.col("profile")).alias(fixed.PROFILE),
        F.col("_welfare").alias(fixed.WELFARE),
        none(F.col("_tags")).alias(fixed.WELFARE_TAGS),
        none(F.col("_legal")).alias(fixed.LEGAL_TAGS),
        (words != "").alias(fixed.SIGNAL),
        none(words).alias(fixed.SIGNAL_WORDS),
        text.present(F.col("capital")).alias("104_capital"),
        text.capital_amount(F.col("capital")).alias("104_capital_ntd"),
        text.present(F.col("industryDesc")).alias("104_industry"),
        F.col("industryNo").alias("104_industry_no"),
        text.present(F.col("indcat")).alias("104_indcat"),
        text.present(F.col("empNo")).alias("104_employee_count"),
        text.first_number(F.col("empNo")).alias("104_employee_count_number"),
        text.present(F.col("address")).alias("104_address"),
        fixed.CITY,
        fixed.DISTRICT,
        text.present(F.col("addrNoDesc")).alias("104_addr_no_desc"),
        text.present(F.col("custLink")).alias(fixed.WEBSITE),
        text.present(F.col("phone")).alias("104_phone"),
        text.present(F.col("hrName")).alias("104_hr_name"),
        text.present(F.col("news")).alias("104_news"),
    )


def lead_rows(payloads: DataFrame, payload: str, schema: str, order: str | None = None) -> DataFrame:
    """Leads given as a JSON list or as an object with a `leads` list.

    `row_ord` follows the place in the payload, and across payloads the unique whole
    numbers (below 2^31) in column `order`; one payload needs none.
    """
    json = F.col(payload)
    found = F.coalesce(members(json), members(fields(json)["leads"]))
    before = F.lit(0).cast("long") if order is None else F.shiftleft(F.col(order).cast("long"), 32)
    rows = payloads.select(before.alias("_before"), F.posexplode(found).alias("_place", "json")).filter(is_object(F.col("json")))
    number = (F.col("_before") + F.col("_place")).alias(fixed.ROW_ORD)
    return rows.select(number, F.from_json("json", schema).alias("lead")).select(fixed.ROW_ORD, "lead.*")
