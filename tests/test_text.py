import unicodedata

import pytest
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text, udfs
from leadkin.operators.emails import email_points, website
from leadkin.operators.industries import codes_in, company_industries


def apply(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[1] for r in rows.select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()]


NAMES = ["星河雲端股份有限公司", "臺北雲（測試）有限公司", "ABC_股份有限公司－台北店", "甲 有限 公司"]


def test_company_key(spark):
    assert apply(spark, NAMES, text.company_key) == ["星河雲端", "台北雲", "abc", "甲有限公司"]


def test_squeezed_company_key(spark):
    assert apply(spark, NAMES, text.squeezed_company_key) == ["星河雲端", "台北雲", "abc", "甲"]


def test_clean(spark):
    values = [None, " ａ　b\n\tc ", "臺北 ①", "ﬁ\x1fx"]
    assert apply(spark, values, text.clean) == ["", "a b c", "台北 1", "fi x"]


def test_stable_ranges_never_change_under_nfkc():
    import re

    stable = re.compile(udfs.NFKC_STABLE)
    for code in range(0x110000):
        char = chr(code)
        if not 0xD800 <= code <= 0xDFFF and stable.match(char) and char != "\n":
            assert unicodedata.normalize("NFKC", char) == char
            assert unicodedata.combining(char) == 0


def test_truthy(spark):
    got = apply(spark, ["True", "1", "Y", "是", "有", "1.0", "false", "", None], text.truthy)
    assert got == [True] * 5 + [False] * 4


def test_capital(spark):
    got = apply(spark, ["5000萬", "1億2000萬", "新台幣 1,200 元", "暫不提供", None, "NaN", "1.5億"], text.capital_amount)
    assert got == [5e7, 1.2e8, 1200.0, None, None, None, 1.5e8]


def test_first_number(spark):
    assert apply(spark, ["約 1,200.50 人", "none", None, "７人"], text.first_number) == [1200.5, None, None, 7.0]


def test_address(spark):
    cases = [
        ("臺北市信義區松仁路100號", None, ("台北市", "信義區")),
        ("台中市中區市府路1號", None, ("台中市", "中區市")),
        ("東京", "台北市信義區", (None, None)),
        ("", "臺北市信義區", ("台北市", "信義區")),
        ("高雄市某路1號", "高雄市前鎮區", ("高雄市", "前鎮區")),
        ("高雄市某路1號", "前鎮區", ("高雄市", "前鎮區")),
        (None, None, (None, None)),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = text.with_address_parts(rows, F.col("a"), F.col("b"), "city", "district").orderBy("i").collect()
    assert [(r.city, r.district) for r in got] == [want for _, _, want in cases]


def test_won(spark):
    values = ["closed_won", "Unsuccessful", "queued", "已簽約", None]
    assert apply(spark, values, text.is_won) == [True, True, False, True, False]
    whole = apply(spark, values, lambda c: text.is_won(c, whole_words=True))
    assert whole == [True, False, False, True, False]


def test_spellings(spark):
    rows = spark.createDataFrame([(0, "ABC_股份有限公司－台北店"), (1, "星河 Star（測試）有限公司"), (2, "Plain Shop")], "i int, name string")
    got = text.with_spellings(rows, "name", "").orderBy("i").collect()
    assert [r["core"] for r in got] == ["", "星河", "plainshop"]
    assert [[w["k"] for w in r["words"]] for r in got][1] == [
        "星河 Star（測試）有限公司", "星河 Star有限公司", "星河 Star有限公司", "星河有限公司", "星河",
    ]


def test_joined_values(spark):
    rows = spark.createDataFrame([([" a ", "", None, "b"],), (None,)], "v array<string>")
    assert [r[0] for r in rows.select(text.joined_values(F.col("v"))).collect()] == ["a、b", ""]


def test_codes(spark):
    got = apply(spark, ["i301010 F213030, ZZ99999 I301010"], lambda c: F.array_distinct(codes_in(c)))
    assert got == [["I301010", "F213030", "ZZ99999"]]
    items = spark.createDataFrame([("1", "I301010 F213030"), ("1", "ZZ99999"), ("2", "Z999999"), ("3", "none")], "no string, item string")
    rows = {r["no"]: r for r in company_industries(items, "no").collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"][fixed.INDUSTRY] == "批發、零售及餐飲業,專業、科學及技術服務業"
    assert [rows["1"][c] for c in fixed.INDUSTRY_FLAGS] == [0, 0, 0, 0, 0, 1, 0, 0, 1, 0]
    assert rows["2"][fixed.INDUSTRY] == ""


def test_website(spark):
    values = ["https://example.com/a", "example.com", "https://www.facebook.com/x", "https://www.online.media.tw", "no site", None, "https://local/x"]
    assert apply(spark, values, website) == ["https://example.com/a", "https://example.com", "", "", "", "", ""]


@pytest.mark.parametrize(
    "value, found",
    [
        ("聯絡信箱info@a.com", []),
        ("x: info@b.com.", []),
        ("ok info@c.com, z", ["info@c.com"]),
        ("logo@2x.png noreply@a.com x@y.example", []),
        ("a\\u0040b.com &#105;nfo&#64;d.com b%40e.com B@E.com", ["info@d.com", "b@e.com"]),
    ],
)
def test_emails(spark, value, found):
    got = apply(spark, [value], udfs.find_emails)[0]
    assert [e["email"] for e in got] == found


def test_context(spark):
    value = "公司信箱 a@x.com 訂閱 b@x.com <a href='mailto:c@x.com'>c</a>" + " " * 150 + "d@x.com 聯絡信箱: d@x.com"
    got = {e["email"]: e["context"] for e in apply(spark, [value], udfs.find_emails)[0]}
    assert got == {"a@x.com": 135, "b@x.com": -60, "c@x.com": 50, "d@x.com": 135}


def test_email_points(spark):
    rows = spark.createDataFrame([("info@a.com", 0), ("bob@b.org", 0)], "e string, c int")
    assert [r[0] for r in rows.select(email_points(F.col("e"), F.lit("a.com"), F.col("c"))).collect()] == [60, 0]


def test_gram_counts_match_a_plain_count(spark):
    from collections import Counter

    texts = ["a", "ab", "aaaa", "雲端😀平台", "the quick brown fox " * 60 + "😀 fin"]
    got = apply(spark, texts, udfs.gram_counts)
    for value, grams in zip(texts, got):
        want = Counter(value[i : i + n] for n in (2, 3, 4) for i in range(len(value) - n + 1))
        assert {g["gram"]: g["tf"] for g in grams} == dict(want)


def test_instant_does_not_depend_on_the_session_zone(spark):
    values = ["2024-01-02", "2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05+08:00", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05-02:30", "soon", "", None]
    seconds = lambda c: F.unix_millis(text.instant(c))
    want = apply(spark, values, seconds)
    day = 1704153600000
    assert want == [day, day + 11045000, day + 11045500, day + 11045000 - 28800000, day + 11045000, day + 11045000 + 9000000, None, None, None]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        assert apply(spark, values, seconds) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dates_with_slashes_and_full_stops(spark):
    from leadkin.functions.text import instant

    texts = ["2024/06/09", "2024/06/09 10:00", "2024.6.9", "2024-06-09T00:00:00+08:00", "soon", "2024/13/01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(instant(F.col("t")).cast("string").alias("x"))
    assert [r.x for r in df.collect()] == ["2024-06-09 00:00:00", "2024-06-09 10:00:00", "2024-06-09 00:00:00", "2024-06-08 16:00:00", None, None]


def test_full_width_space_ends_an_address_and_bad_links_are_skipped(spark):
    from leadkin.functions.udfs import joined
    from leadkin.operators.emails import website

    df = spark.createDataFrame([("https://a.com\u3000台北",)], "t string").select(website(F.col("t")).alias("x"))
    assert df.first().x == "https://a.com"
    assert joined("https://a.com/", "http://[x") is None and joined("https://a.com/", "/b") == "https://a.com/b"


def test_nested_numbers_are_safe_in_json(spark):
    from leadkin.operators.columns import as_json

    df = spark.sql("SELECT array(double('NaN'), 1D) AS a, named_struct('x', double('Infinity')) AS s, map('k', double('NaN')) AS m")
    assert df.transform(as_json).first().json == '{"a":[null,1.0],"s":{"x":null},"m":{"k":null}}'
