import os
import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, name):
    assert re.match("ok|rows-only", compare(spark, SF_DIR, name))


def test_document_emails_against_plain_python(spark):
    import html as markup
    from urllib.parse import unquote

    from leadkin import fixed
    from leadkin.functions.udfs import valid_email

    pattern = re.compile(fixed.EMAIL_PATTERN, re.I)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, e.lower()) for d in documents for e in pattern.findall(unquote(markup.unescape(d.text))) if valid_email(e.lower())}
    got = {(r.doc_id, r.email) for r in entry.queries()["document_emails"](spark, SF_DIR).collect()}
    assert got == want


def test_profile_limits_cut_without_changing_what_is_kept(spark):
    from leadkin.checks.building import landed
    from leadkin.plans.profiles import build_profiles

    raw = landed(spark, SF_DIR)
    whole = build_profiles(raw, target=None, max_candidates=60).orderBy("row_ord").collect()
    some = build_profiles(raw, target=7, max_candidates=60).orderBy("row_ord").collect()
    assert len(whole) > 7 and some == whole[:7]
    assert all(r["row_ord"] <= 60 for r in whole)
    names = spark.createDataFrame([(whole[0]["企業名稱"].replace(" ", "").replace("有限公司", ""),)], "company_key string")
    barred = build_profiles(raw, excluded_keys=names, target=None, max_candidates=60)
    assert whole[0]["企業名稱"] not in {r["企業名稱"] for r in barred.collect()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
