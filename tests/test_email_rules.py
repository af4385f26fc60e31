"""Which addresses are refused, and points of what stands before them, as columns against plain Python."""

import random
import re

from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions.udfs import context_points, is_valid, valid_email
from leadkin.operators.emails import emails_in


def _points(before):
    """The rule stated plainly."""
    shown = re.sub(" +", " ", re.sub(r"<[^>]+>|\s+", " ", before))
    kinds = {"strong": fixed.STRONG_CONTEXTS, "weak": fixed.WEAK_CONTEXTS, "negative": fixed.NEGATIVE_CONTEXTS}
    points = sum(fixed.CONTEXT_POINTS[kind] for kind, words in kinds.items() if any(w in shown for w in words))
    return points + ("mailto:" in before[-fixed.MAILTO_CHARS :]) * fixed.CONTEXT_POINTS["mailto"]


def test_refusal_as_a_column(spark):
    r = random.Random(1)
    locals_ = ["info", "a.b", "", "x%2f", "u00a9x", *fixed.BAD_LOCAL_PREFIXES, *fixed.BAD_LOCAL_PARTS]
    ends = ["a.com", "", "b.co.uk", *fixed.BAD_TLDS, *fixed.BAD_DOMAIN_ENDS, *[f"x.{t}" for t in fixed.BAD_TLDS]]
    values = {f"{a}@{b}" for a in locals_ for b in ends} | {"none", "@", "a@"} | {f"{r.choice(locals_)}q{r.choice(locals_)}@{r.choice(ends)}z" for _ in range(200)}
    rows = spark.createDataFrame([(v,) for v in values], "email string").select("email", is_valid(F.col("email")).alias("ok")).collect()
    assert {x.email: x.ok for x in rows} == {v: valid_email(v) for v in values}
    assert 0 < sum(x.ok for x in rows) < len(values)


def test_context_as_a_column(spark):
    r = random.Random(2)
    bits = [*fixed.STRONG_CONTEXTS, *fixed.WEAK_CONTEXTS, *fixed.NEGATIVE_CONTEXTS, "<b>", "</a href=x>", " ", "\n", "　", "\xa0", "\x1c", "mailto:", "word", "<", "x" * 30, "𠀀"]
    values = {"".join(r.choices(bits, k=r.randint(0, 8))).lower() for _ in range(1500)}
    rows = spark.createDataFrame([(v,) for v in values], "before string").select("before", context_points(F.col("before")).alias("n")).collect()
    assert {x.before: x.n for x in rows} == {v: _points(v) for v in values}


def test_addresses_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "no address"), (4, "noreply@a.com then a@b.com, and A@B.com."), (5, "a@b.com " * 5000), (4, "x@y.org")]
    got = emails_in(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()
    assert sorted((x.id, x.ord, x.email) for x in got) == [(4, 0, "a@b.com"), (4, 0, "x@y.org"), (5, 0, "a@b.com")]
    assert all(x.context == 0 for x in got)
