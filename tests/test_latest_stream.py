"""What a stream keeps of every key against the same rows as one table."""

from datetime import datetime, timezone

from leadkin.operators import history as rules
from leadkin.sources.tables import Files
from leadkin.streaming import latest

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SCHEMA = "developed_at string, company_name string, company_key string, `客戶編號` string, status string, batch long, row_ord long"


def _schema():
    from leadkin import fixed

    return SCHEMA.replace("客戶編號", fixed.CUST_NO)


def _rows():
    rows = [
        ("2024-01-30T10:00:00", "A 有限公司", "", "1", "developed", 1, 1),
        ("2023-01-01T10:00:00", "A 有限公司", "", "1", "closed_won", 1, 2),
        ("soon", "B", None, "2", "developed", 1, 3),
        ("2023-05-05", "B", "b", "", "developed", 1, 4),
        ("2023-05-05T00:00:00", "B", "b", None, "developed", 1, 5),
        (None, None, None, None, None, 1, 6),
    ]
    return rows + [(f"2023-{1 + i % 12:02d}-01T00:00:00", "hot", "", "9", "developed", 2, i) for i in range(300)]


def test_stream_keeps_the_same_as_a_batch(spark, tmp_path):
    rows = spark.createDataFrame(_rows(), _schema()).cache()
    store = f"{tmp_path}/latest"

    def arrive(part, stream, every=latest.MERGE):
        place = f"{tmp_path}/in-{stream}"
        part.write.mode("append").parquet(place)
        latest.ingest(spark.readStream.schema(rows.schema).parquet(place), store, f"{tmp_path}/progress-{stream}", merge_every=every).awaitTermination()

    assert latest.read(spark, store).count() == 0
    arrive(rows.filter("row_ord % 2 = 0"), 0)
    arrive(rows.filter("row_ord % 2 = 1 and row_ord > 4"), 0, every=1)
    assert len(Files(spark).names(store)) == 1  # merged by the stream itself
    arrive(rows.filter("row_ord % 3 = 0"), 0)  # repeated rows
    arrive(rows.filter("row_ord % 2 = 1 and row_ord <= 4"), 1)  # late rows, in another stream
    want = {(r.kind, r.key): (r.latest and r.latest.at, r.won) for r in rules.contacts(rules.layout(rows)).collect()}
    assert {(r.kind, r.key): (r.latest and r.latest.at, r.won) for r in latest.read(spark, store).collect()} == want
    assert want["name", "b"] == ("2023-05-05", False) and want["number", "1"] == ("2024-01-30T10:00:00", True)
    latest.compact(spark, store)
    assert len(Files(spark).names(store)) == 1 and spark.read.parquet(f"{store}/*").count() == len(want)
    seen = {(r.kind, r.key): (r["at"], r.recent) for r in rules.as_of(latest.read(spark, store), NOW, 7).collect()}
    assert seen == {(r.kind, r.key): (r["at"], r.recent) for r in rules.summary(rules.layout(rows), NOW, 7).collect()}


def test_a_repeated_micro_batch_and_an_unfinished_folder_do_no_harm(spark, tmp_path):
    rows = spark.createDataFrame(_rows(), _schema())
    store = f"{tmp_path}/latest"
    found = rules.contacts(rules.layout(rows))
    found.write.parquet(f"{store}/s-000000000000")
    found.filter("kind = 'name'").write.parquet(f"{store}/s-000000000001")
    Files(spark).delete(f"{store}/s-000000000001/_SUCCESS")
    want = sorted(map(str, found.collect()))
    assert sorted(map(str, latest.read(spark, store).collect())) == want
    latest.compact(spark, store)
    assert len(Files(spark).names(store)) == 2
    assert sorted(map(str, latest.read(spark, store).collect())) == want
