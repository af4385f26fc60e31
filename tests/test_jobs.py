from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.operators import history as rules
from leadkin.operators.columns import as_json, col
from leadkin.operators.dedupe import keep_in_turn, keep_last
from leadkin.operators.resolve import resolve
from leadkin.plans import weekly
from leadkin.plans.enrich import enrich_emails
from leadkin.session import scratch_path
from leadkin.sources import history_store
from leadkin.sources.tables import Files, read_table
from leadkin.sources.landed import lead_rows, payload_records, posted_number, posting_rows, registry_rows
from leadkin.streaming.history import ingest

NOW = datetime(2024, 6, 10, 12, 0, tzinfo=timezone.utc)


def contacts(spark, rows):
    names = ["developed_at", "company_name", "`104_custNo`", "status", "outcome"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return df.withColumn(fixed.ROW_ORD, F.monotonically_increasing_id())


def test_recent_filter(spark):
    days = lambda n: (NOW - timedelta(days=n)).isoformat()
    rows = [(days(6), "a", "1", "", ""), (days(8), "b", "2", "", ""), (days(80), "c", "3", "Signed", ""), ("soon", "d", "4", "", ""),
            ("2024-06-04T23:00:00+08:00", "e", "5", "", "")]
    history = rules.records(contacts(spark, rows), now=NOW, run_id="r")
    assert {r.company_name for r in rules.recent(history, NOW, 7).collect()} == {"a", "c", "e"}


def test_latest_prefers_number_and_first_on_ties(spark):
    rows = [("2024-06-01T00:00:00Z", "甲有限公司", "1", "", ""), ("2024-06-03T00:00:00Z", "甲", "", "", ""), ("2024-06-01 00:00:00", "乙", "1", "", "")]
    history = rules.records(contacts(spark, rows), now=NOW, run_id="r")
    ranking = spark.createDataFrame([(0, "甲", "1"), (1, "甲股份有限公司", ""), (2, "", "")], f"{fixed.ROW_ORD} long, `{fixed.NAME}` string, `{fixed.CUST_NO}` string")
    got = {r[fixed.ROW_ORD]: r for r in rules.with_history(ranking, history, NOW, 8).collect()}
    assert [got[i]["last_developed_at"] for i in range(3)] == ["2024-06-01T00:00:00Z", "2024-06-03T00:00:00Z", None]
    assert [got[i]["recently_developed"] for i in range(3)] == [True, True, False]


def test_keep_last_treats_null_and_blank_alike_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "", 2), ("b", "x", 3)], "k string, v string, o long")
    once = keep_last(df, ["k", "v"], ["o"])
    assert sorted((r.k, r.o) for r in once.collect()) == [("a", 2), ("b", 3)]
    assert sorted(keep_last(once, ["k", "v"], ["o"]).collect()) == sorted(once.collect())


def test_store_append_replay_and_compaction(spark):
    path = scratch_path(spark, "history")
    assert history_store.read(spark, path).count() == 0
    first = contacts(spark, [("2024-06-01", "a", "1", "", ""), ("2024-06-01", "b", "2", "", "")])
    assert history_store.append(first, path, now=NOW).count() == 2
    again = contacts(spark, [("2024-06-01", "a", "1", "", ""), ("2024-06-02", "c", "3", "", "")])
    assert history_store.append(again, path, now=NOW, run_id="x").count() == 3
    assert history_store.append(again, path, now=NOW, run_id="x", key="again").count() == 3
    assert history_store.append(again, path, now=NOW, run_id="x", key="again").count() == 3
    before = sorted(history_store.read(spark, path).collect(), key=str)
    history_store.compact(spark, path)
    assert sorted(history_store.read(spark, path).collect(), key=str) == before
    assert {r.run_id for r in before if r.company_name == "a"} == {"x"}


def test_appends_and_streams_share_a_history(spark):
    path, source = scratch_path(spark, "history"), scratch_path(spark, "in")
    row = lambda i: contacts(spark, [(f"2024-06-{i:02d}", f"c{i}", str(i), "", "")])
    history_store.append(row(1), path, now=NOW)
    rows = row(2)
    rows.write.parquet(source)

    def go():
        ingest(spark.readStream.schema(rows.schema).parquet(source), path, f"{path}-progress", now=NOW, run_id="r").awaitTermination()
        return history_store.read(spark, path).count()

    assert go() == 2
    history_store.compact(spark, path)
    history_store.compact(spark, path)
    row(3).write.mode("append").parquet(source)
    assert go() == 3
    assert history_store.append(row(4), path, now=NOW).count() == 4
    history_store.compact(spark, path)
    assert go() == 4
    assert [(c.level > 0, c.rows) for c in history_store.commits(spark, path)] == [(True, 4)]


def test_a_new_checkpoint_at_an_old_place_loses_nothing(spark):
    path = scratch_path(spark, "history")
    row = lambda i: contacts(spark, [(f"2024-06-{i:02d}", f"c{i}", str(i), "", "")])

    def go(i, merge):
        source = scratch_path(spark, "in")
        row(i).write.parquet(source)
        ingest(spark.readStream.schema(row(i).schema).parquet(source), path, f"{path}-progress", now=NOW, run_id="r").awaitTermination()
        if merge:
            history_store.compact(spark, path)
        Files(spark).delete(f"{path}-progress", whole=True)
        return sorted(r.company_name for r in history_store.read(spark, path).collect())

    assert go(1, False) == ["c1"] and go(2, True) == ["c1", "c2"] and go(3, False) == ["c1", "c2", "c3"]


def test_keys_hold_their_rows(spark):
    path = scratch_path(spark, "history")
    row = lambda *names: contacts(spark, [("2024-06-01", n, n, "", "") for n in names])
    history_store.add(row("a", "b"), path, now=NOW, key="k")
    for _ in range(2):
        history_store.add(row("b", "a"), path, now=NOW, key="k")
        with pytest.raises(ValueError, match="taken"):
            history_store.add(row("c", "d"), path, now=NOW, key="k")
        history_store.compact(spark, path)
    history_store.add(row("e"), path, now=NOW, key=history_store.stream_key("s", 3))
    history_store.compact(spark, path)
    history_store.add(row("e"), path, now=NOW, key=history_store.stream_key("s", 3))
    history_store.add(row("f"), path, now=NOW, key=history_store.stream_key("s", 4))
    history_store.add(row("g"), path, now=NOW, key=history_store.stream_key("t", 3))
    assert sorted(r.company_name for r in history_store.read(spark, path).collect()) == ["a", "b", "e", "f", "g"]


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, monkeypatch):
    path = scratch_path(spark, "history")
    row = contacts(spark, [("2024-06-01", "a", "1", "", "")])

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as broken:
        broken.setattr(history_store, "_commit", dies)
        with pytest.raises(OSError):
            history_store.add(row, path, now=NOW, key="k")
    assert history_store.read(spark, path).count() == 0
    assert history_store.append(row, path, now=NOW, key="k").count() == 1


def test_requests_for_a_batch_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(history_store, "FAN", 4)
    path, spent, longest = scratch_path(spark, "history"), [], 0
    for i in range(36):
        before = Files.calls
        history_store.add(contacts(spark, [(f"2024-06-{1 + i % 28:02d}", f"c{i}", str(i), "", "")]), path, now=NOW, key=history_store.stream_key("s", i))
        spent.append(Files.calls - before)
        longest = max(longest, len(history_store.commits(spark, path)))
    assert history_store.read(spark, path).count() == 36
    assert longest <= 3 * 4
    assert max(spent[18:]) <= max(spent[:18]) + 8 and sum(spent[18:]) <= 1.5 * sum(spent[:18])
    levels = [c.level for c in history_store.commits(spark, path)]
    assert sum(4**level for level in levels) == 36


def test_csv_history_is_taken_over(spark):
    path = f"{scratch_path(spark, 'history')}.csv"
    contacts(spark, [("2024-06-01", "a", "1", "", "line\nbreak")]).drop(fixed.ROW_ORD).coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    assert history_store.read(spark, path).count() == 1
    assert history_store.append(contacts(spark, [("2024-06-02", "b", "2", "", "")]), path, now=NOW).count() == 2
    assert history_store.append(contacts(spark, [("2024-06-03", "c", "3", "", "")]), path, now=NOW).count() == 3


def test_row_numbers_outlive_other_splits(spark):
    path = f"{scratch_path(spark, 'many')}.csv"
    spark.range(5000).select(F.col("id"), F.lit("two\nlines").alias("t")).repartition(6).write.option("header", True).csv(path)
    table = read_table(spark, path)
    first = {r.id: r[fixed.ROW_ORD] for r in table.collect()}
    settings = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "3"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        again = {r.id: r[fixed.ROW_ORD] for r in table.select("id", fixed.ROW_ORD).collect()}
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert first == again and len(first) == 5000 == len(set(first.values()))


def test_stream_equals_batch(spark):
    source, path, batch_path = (scratch_path(spark, n) for n in ("in", "stream", "batch"))
    rows = contacts(spark, [("2024-06-01", f"c{i % 7}", str(i % 5), "x" if i % 2 else "", "") for i in range(60)])
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest(stream, path, f"{path}-progress", now=NOW, run_id="r").awaitTermination()
    history_store.append(spark.read.parquet(source), batch_path, now=NOW, run_id="r")
    keys = ["developed_at", "company_key", fixed.CUST_NO, "source", "status", "outcome"]
    seen = lambda p: sorted(map(str, history_store.read(spark, p).select(*[col(k) for k in keys]).collect()))
    assert seen(path) == seen(batch_path)


def test_weekly_job_closes_the_loop(spark, samples):
    root = scratch_path(spark, "weekly")
    here = {side: df.inputFiles()[0] for side, df in zip(("customers", "potentials"), samples)}
    options = dict(**here, output=f"{root}/out", history=f"{root}/history", top_n=5, mark_top_n=True)
    first = weekly.run(spark, weekly.Options(now=NOW, **options))
    assert (first["potential_count"], first["top_leads_count"], first["history_rows"]) == (8, 5, 5)
    leads = spark.read.parquet(first["top_leads"]).orderBy("outreach_rank")
    assert [r[fixed.CUST_NO] for r in leads.collect()] == [f"SAMPLE-P00{i}" for i in (1, 5, 3, 6, 2)]
    assert leads.filter("manual_physical_letter and n8n_should_email").count() == 5
    second = weekly.run(spark, weekly.Options(now=NOW + timedelta(days=1), **options))
    assert second["recently_developed_in_ranking"] == 5 and second["top_leads_count"] == 3
    third = weekly.run(spark, weekly.Options(now=NOW + timedelta(days=30), **options))
    assert third["recently_developed_in_ranking"] == 0 and third["top_leads_count"] == 5
    csv = spark.read.option("header", True).csv(f"{root}/out/top_leads_csv")
    assert csv.count() == 5


def test_quality_gate():
    weekly.check_count(250, 500, 0.5, "x")
    with pytest.raises(RuntimeError, match="249"):
        weekly.check_count(249, 500, 0.5, "x")
    assert weekly.minimum_rows(1, 0.5) == 1


def test_json_is_safe(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), None), (1.5, "b")], "v double, s string")
    assert [r.json for r in as_json(df).collect()] == ['{"v":null,"s":"a"}', '{"v":null,"s":null}', '{"v":1.5,"s":"b"}']


def test_postings_of_both_shapes(spark):
    pages = [
        (0, '{"data": {"list": [{"custName": "a", "link": {"cust": "//x/company/abc?q"}}, 5, "x"]}}'),
        (1, '{"data": [{"custName": "b", "link": "", "custUrl": "", "companyUrl": "/company/def#x"}, {"custName": "c", "custNo": 12}]}'),
        (2, '{"data": "none"}'),
        (3, "no json"),
    ]
    df = spark.createDataFrame(pages, "o long, p string")
    got = posting_rows(df, "p", "o").select("custName", posted_number().alias("no")).collect()
    assert sorted(map(tuple, got)) == [("a", "abc"), ("b", "def"), ("c", "12")]


def test_registry_responses_of_all_shapes(spark):
    row = '{"Company_Name": "a", "Business_Accounting_NO": "1"}'
    shapes = [f"[{row}, 3]", f'{{"records": [{row}]}}', f'{{"data": 3, "result": [{row}]}}', row, "3", ""]
    df = spark.createDataFrame(list(enumerate(shapes)), "i long, p string")
    assert [r.i for r in registry_rows(df, "p", "i").orderBy("i").collect()] == [0, 1, 2, 3]


def test_payload_fields(spark):
    raw = '{"profile": " p ", "tagNames": ["下午茶", ""], "legalTagNames": "x", "welfare": "Happy Hour", "empNo": "80人", "capital": "1億", "address": "臺北市信義區a", "custLink": " "}'
    r = payload_records(spark.createDataFrame([("k", raw), ("e", "{}")], "no string, p string"), "p", "no").filter("no = 'k'").first()
    assert (r[fixed.PROFILE], r[fixed.WELFARE_TAGS], r[fixed.LEGAL_TAGS], r[fixed.SIGNAL_WORDS]) == ("p", "下午茶", "x", "下午茶、happy hour")
    assert (r[fixed.SIGNAL], r["104_employee_count_number"], r["104_capital_ntd"], r[fixed.CITY], r[fixed.DISTRICT], r[fixed.WEBSITE]) == (True, 80.0, 1e8, "台北市", "信義區", None)


def in_turn(rows):
    barred, want = set(), []
    for i, own, matched in rows:
        if (own or None) not in barred and (matched or None) not in barred:
            want.append(i)
            if matched:
                barred.add(matched)
    return want


@pytest.mark.parametrize("at_once", [200_000, 5, 0])
def test_keep_in_turn_against_a_loop(spark, at_once):
    """All at once, by components, and round by round."""
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice("abcdefgh"), rng.choice("abcdefgh")) for i in range(60)] + [(100 + i, f"k{i - 1}", f"k{i}") for i in range(6)]
    rows += [(200 + i, rng.choice(["", None, "x", "k1"]), rng.choice(["", None, "x", "y"])) for i in range(20)]
    rows += [(300 + i, f"s{i}", f"s{i // 2}") for i in range(20)]
    got = keep_in_turn(spark.createDataFrame(rows, "o long, own string, matched string"), "o", "own", "matched", at_once)
    assert sorted(r.o for r in got.collect()) == in_turn(rows)


def test_a_long_chain_takes_a_fixed_number_of_jobs(spark):
    """Ten thousand links, each row barred or not by the one before it, among rows that are not linked."""
    rows = [(i, f"k{i - 1}", f"k{i}") for i in range(10_000)] + [(20_000 + i, f"a{i % 700}", f"a{i % 700}") for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, own string, matched string")
    jobs = []
    for part in (df.filter("o < 100 or o >= 20000"), df):
        spark.sparkContext.setJobGroup(f"turn{len(jobs)}", "")
        got = sorted(r.o for r in keep_in_turn(part, "o", "own", "matched").collect())
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"turn{len(jobs)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == in_turn(rows)
    assert jobs[1] <= jobs[0] + 2


def test_history_is_read_once(spark):
    """The summary has one scan of the history, and equals latest contact and recent flag worked out one by one."""
    path = scratch_path(spark, "rows")
    days = lambda n: (NOW - timedelta(days=n)).isoformat()
    rows = [(days(i % 30) if i % 7 else "soon", f"c{i % 13}股份有限公司", str(i % 11) if i % 3 else "", "won" if i % 29 == 0 else "", "") for i in range(400)]
    rules.records(contacts(spark, rows), now=NOW, run_id="r").write.parquet(path)
    found = rules.summary(spark.read.parquet(path), NOW, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    got = {(r.kind, r.key): (r.at, r.recent) for r in found.collect()}
    assert {k for k, _ in got} == {"name", "number"} and len(got) == 13 + 11
    stored = spark.read.parquet(path).collect()
    for (kind, key), (at, recent) in got.items():
        mine = [r for r in stored if (r.company_key == key if kind == "name" else r["104_custNo"] == key)]
        dated = [r for r in mine if r.developed_at != "soon"]
        assert at == max(r.developed_at for r in dated)
        assert recent == any(r.status == "won" or r.developed_at != "soon" and datetime.fromisoformat(r.developed_at) >= NOW - timedelta(days=7) for r in mine)


REGISTRY = [
    (0, "星河雲端股份有限公司", "1", "01", "核准設立"),
    (1, "星河雲端科技股份有限公司", "2", "01", "核准設立"),
    (2, "松果行銷有限公司", "3", "02", "核准設立"),
    (3, "松果行銷股份有限公司", "4", "01", "核准設立"),
    (4, "大大大松果行銷有限公司", "5", "", ""),
    (5, "Northern Light Works", "6", "01", None),
]


def test_resolution_tiers(spark):
    registry = spark.createDataFrame(REGISTRY, "reg_ord long, Company_Name string, Business_Accounting_NO string, Company_Status string, Company_Status_Desc string")
    targets = [
        (0, "", "星河雲端股份有限公司"),
        (1, "松果行銷有限公司", "松果"),
        (2, "無名", "什麼"),
        (3, "Northern Lihgt Works", "Northern Light Works"),
        (4, "", "星河雲端"),
        (5, "", "星河雲端（台北）"),
        (6, "", ""),
    ]
    got = resolve(spark.createDataFrame(targets, "id long, a string, b string"), registry, "id", ["a", "b"])
    assert {r.id: (r.reg_ord, r.match_tier) for r in got.collect()} == {
        0: (0, "exact"), 1: (4, "partial"), 3: (5, "core_fuzzy"), 4: (0, "core_exact"), 5: (0, "core_exact"),
    }


def test_resolution_plan_has_no_cross_join(spark):
    registry = spark.createDataFrame(REGISTRY, "reg_ord long, Company_Name string, Business_Accounting_NO string, Company_Status string, Company_Status_Desc string")
    got = resolve(spark.createDataFrame([(0, "a", "b")], "id long, a string, b string"), registry, "id", ["a", "b"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_lead_emails(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.com", "<a href='/x'>q</a> 聯絡信箱: info@a.com "), (2, "https://a.com/contact", "boss@b.org sales@a.com"),
         (3, "https://nn.com", "nothing"), (4, "https://a.com/about", "too@late.com")],
        "page_id long, url string, html string",
    )
    leads = spark.createDataFrame(
        [(0, "c0", "https://a.com", ""), (1, "c1", "", ""), (2, "c2", "https://b.com", ""), (3, "c3", "", "x y me@z.com "), (4, "c4", None, None), (5, "", "nn.com", "")],
        f"{fixed.ROW_ORD} long, `{fixed.CUST_NO}` string, `{fixed.WEBSITE}` string, Email string",
    )
    landed = spark.createDataFrame([("c4", "see https://a.com"), ("c1", None)], "cust_no string, website string")
    got = enrich_emails(leads, pages, landed).orderBy(fixed.ROW_ORD).collect()
    assert [r["email_status"] for r in got] == ["found", "missing_website", "homepage_request_failed", "existing_email", "found", "email_not_found"]
    assert [r["Email"] for r in got] == ["info@a.com", "", "", "me@z.com", "info@a.com", ""]
    assert got[0]["email_candidates"] == "info@a.com | boss@b.org | sales@a.com"
    assert got[0]["email_source_url"] == "https://a.com" and got[4][fixed.WEBSITE] == "https://a.com"
    gmail = enrich_emails(leads, pages, landed, gmail_only=True)
    assert gmail.filter("email_status = 'found'").count() == 0
    assert enrich_emails(leads, pages, max_pages=5).filter("email_candidates like '%too@late.com%'").count() == 1


def test_pages_are_found_by_host_path_and_query(spark):
    sites = ["https://a.com", "http://A.com/", "https://www.a.com#top", "https://a.com/x?y=1", "https://b.com", "https://c.com/?q"]
    leads = spark.createDataFrame([(i, "", s) for i, s in enumerate(sites)], f"{fixed.ROW_ORD} long, Email string, {fixed.WEBSITE} string")
    pages = spark.createDataFrame(
        [(2, "https://www.a.com/", "mail info@a.com ."), (1, "http://a.com", "mail first@a.com . <a href='http://[x'>bad</a>"), (3, "http://a.com/x/?y=1", "sales@a.com"), (4, None, "x@y.com"), (5, "https://b.com:8080/", "b@b.com")],
        "page_id long, url string, html string",
    )
    got = enrich_emails(leads, pages).orderBy(fixed.ROW_ORD).collect()
    assert [r["Email"] for r in got] == ["first@a.com"] * 3 + ["sales@a.com", "", ""]
    assert [r["email_status"] for r in got] == ["found"] * 4 + ["homepage_request_failed"] * 2


def test_leads_of_several_payloads_have_numbers_of_their_own(spark):
    payloads = [(2, '{"leads": [{"company_name": "c"}, 5, {"company_name": "d"}]}'), (1, '[{"company_name": "a"}, {"company_name": "b"}]'), (3, "none")]
    rows = lead_rows(spark.createDataFrame(payloads, "o long, p string").repartition(3), "p", "company_name string", "o")
    found = rows.orderBy(fixed.ROW_ORD).collect()
    assert [r.company_name for r in found] == ["a", "b", "c", "d"]
    assert len({r[fixed.ROW_ORD] for r in found}) == 4
