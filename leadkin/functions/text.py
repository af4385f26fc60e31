"""Text rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions.udfs import nfkc

SPACE = r"(?U)[\s\x1C-\x1F]+"
EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
PARENTHESES = r"（[^）]*）|\([^)]*\)"
SEPARATORS = "[-－–—/／|｜]"
CJK = r"[一-鿿]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def blank(text: Column) -> Column:
    """Null becomes the empty string, edges are stripped."""
    return F.coalesce(strip(text.cast("string")), F.lit(""))


def present(text: Column) -> Column:
    """The stripped text, or null if nothing is left of it."""
    return F.nullif(blank(text), F.lit(""))


def first_present(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])


def _folded(text: Column) -> Column:
    return F.replace(nfkc(F.coalesce(text.cast("string"), F.lit(""))), F.lit("臺"), F.lit("台"))


def clean(text: Column) -> Column:
    """Width-folded text with single spaces and no edges."""
    return F.trim(F.regexp_replace(_folded(text), SPACE, " "))


def squeezed(text: Column) -> Column:
    """Width-folded text without any white space."""
    return F.regexp_replace(_folded(text), SPACE, "")


def _key(text: Column) -> Column:
    key = F.lower(text)
    key = F.regexp_replace(key, PARENTHESES, "")
    key = F.regexp_replace(key, "[_＿]+", "")
    key = F.regexp_replace(key, f"{SEPARATORS}.*$", "")
    key = F.regexp_replace(key, "|".join(fixed.KEY_SUFFIXES), "")
    return F.regexp_replace(key, r"[^\p{L}\p{N}_一-鿿]+", "")


def company_key(name: Column) -> Column:
    """Key under which two spellings of a company meet; spaces go last."""
    return _key(clean(name))


def squeezed_company_key(name: Column) -> Column:
    """As company_key, but spaces go first, so a spaced legal form is removed too."""
    return _key(squeezed(name))


def without_latin(text: Column) -> Column:
    """Latin letters go only if at least two ideographs stay."""
    rest = F.regexp_replace(F.regexp_replace(text, "[a-zA-Z]+", ""), SPACE, "")
    return F.when(F.regexp_count(rest, F.lit(CJK)) >= 2, rest).otherwise(text)


def best_segment(text: Column) -> Column:
    """Among the parts between underscores, the one with most ideographs, then the longest, then the first."""
    scored = F.transform(
        F.split(text, "[_＿]+"),
        lambda part, i: F.struct(
            F.regexp_count(strip(part), F.lit(CJK)).alias("ideographs"),
            F.length(strip(part)).alias("size"),
            (-i).alias("place"),
            strip(part).alias("part"),
        ),
    )
    return F.coalesce(F.array_max(F.filter(scored, lambda s: s.size > 0))["part"], text)


def before_separator(text: Column) -> Column:
    return F.regexp_replace(text, f"(?s){SEPARATORS}.*$", "")


def plain(folded: Column) -> Column:
    """Lower-case text without white space, brackets and full stops; takes width-folded text."""
    text = F.replace(F.lower(folded), F.lit("臺"), F.lit("台"))
    return F.regexp_replace(F.regexp_replace(text, SPACE, ""), r"[_()（）【】\[\]「」『』,，.。．·]", "")


def with_spellings(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Add <prefix>plain, <prefix>core and <prefix>words for a company name.

    core: the name without brackets, branch, Latin part and one trailing legal form.
    words: up to five ordered spellings to look the company up with, as
    (k, n) with n the length without white space.
    Built in steps, each of which is worked out once.
    """
    at = lambda c: F.col(prefix + c)
    add = lambda d, c, value: d.withColumn(prefix + c, value)
    out = add(df, "folded", nfkc(F.coalesce(F.col(name), F.lit(""))))
    out = add(out, "open", strip(F.regexp_replace(at("folded"), PARENTHESES, "")))
    out = add(out, "shown", best_segment(at("open")))
    out = add(out, "first", before_separator(at("shown")))
    out = add(out, "bare", without_latin(at("first")))
    endings = "|".join(dict.fromkeys(s.replace("臺", "台") for s in fixed.CORE_SUFFIXES))
    out = add(out, "core", F.regexp_replace(plain(at("bare")), f"(?:{endings})$", ""))
    out = add(out, "plain", plain(at("folded")))
    sized = lambda k, folded: F.struct(k.alias("k"), F.length(F.regexp_replace(folded, SPACE, "")).alias("n"))
    others = [sized(at(c), at(c)) for c in ("shown", "first", "bare", "core")]
    out = add(out, "words", F.array(sized(strip(F.col(name)), at("folded")), *others))
    return out.drop(*[prefix + c for c in ("folded", "open", "shown", "first", "bare")])


def joined_text(*texts: Column) -> Column:
    """Cleaned parts with one space between them; blank parts keep their space."""
    parts: list[Column] = []
    for text in texts:
        parts += [F.lit(" "), clean(text)]
    return F.trim(F.concat(*parts[1:])) if parts else F.lit("")


def joined_values(values: Column) -> Column:
    trimmed = F.transform(values, lambda v: blank(v))
    return F.coalesce(F.array_join(F.filter(trimmed, lambda v: v != ""), "、"), F.lit(""))


def truthy(text: Column) -> Column:
    return F.lower(clean(text)).isin(fixed.TRUE_WORDS)


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def found_words(text: Column, words: list[str]) -> Column:
    """Words contained in the text, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def is_won(*texts: Column, whole_words: bool = False) -> Column:
    """A won word anywhere in the joined texts; whole_words asks for word edges instead."""
    lowered = [F.nullif(F.lower(clean(t)), F.lit("")) for t in texts]
    joined = F.concat_ws(" ", *lowered)
    if whole_words:
        words = "|".join(re.escape(w) for w in fixed.WON_WORDS)
        return joined.rlike(rf"(?U)(?<!\w)(?:{words})(?!\w)")
    return contains_any(joined, fixed.WON_WORDS)


def first_number(text: Column) -> Column:
    digits = F.translate(F.replace(blank(text), F.lit(","), F.lit("")), "０１２３４５６７８９", "0123456789")
    return F.nullif(F.regexp_extract(digits, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")


def capital_amount(text: Column) -> Column:
    """Amount in dollars from a text with units of ten thousand and a hundred million."""
    folded = nfkc(blank(text))
    bare = F.regexp_replace(folded, r"(?U)[,，\s新台幣臺元NTD$]", "")
    yi = F.nullif(F.regexp_extract(bare, r"([0-9]+(?:\.[0-9]+)?)億", 1), F.lit("")).cast("double")
    wan = F.nullif(F.regexp_extract(bare, r"([0-9]+(?:\.[0-9]+)?)萬", 1), F.lit("")).cast("double")
    units = F.coalesce(yi * 1e8, F.lit(0.0)) + F.coalesce(wan * 1e4, F.lit(0.0))
    missing = (folded == "") | folded.rlike("(?i)暫不提供|未提供|無|nan")
    return F.when(missing, None).when(yi.isNotNull() | wan.isNotNull(), units).otherwise(first_number(bare))


_DISTRICT = r"^([一-鿿]{1,6}(?:區|鄉|鎮|市))"


def with_address_parts(df: DataFrame, address: Column, area: Column, city: str, district: str) -> DataFrame:
    """City and district; the area text helps where the address is blank or has no district.

    Built in steps, so that the text found in one is not worked out again for
    every place that needs it in the next.
    """
    folded = lambda t: F.replace(nfkc(blank(t)), F.lit("臺"), F.lit("台"))
    district_of = lambda value: F.nullif(F.regexp_extract(value, _DISTRICT, 1), F.lit(""))
    texts = df.select("*", folded(address).alias("_address"), folded(area).alias("_area"))
    source = texts.withColumn("_source", first_present(F.col("_address"), F.col("_area")))
    known = source.withColumn("_city", F.coalesce(*[F.when(F.contains("_source", F.lit(c)), F.lit(c)) for c in fixed.CITIES]))
    # text after the city, and the area text with the first mention of the city taken out
    rests = known.select(
        "*",
        F.expr("substring(_source, instr(_source, _city) + length(_city))").alias("_tail"),
        F.expr("overlay(_area PLACING '' FROM instr(_area, _city) FOR length(_city))").alias("_cut"),
        F.expr("instr(_area, _city) > 0").alias("_in_area"),
    )
    rest = F.when(F.col("_in_area"), F.col("_cut")).otherwise(F.col("_area"))
    found = F.when(F.col("_city").isNotNull(), F.coalesce(district_of(F.col("_tail")), district_of(rest)))
    return rests.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_city").alias(city), found.alias(district))


def instant(text: Column) -> Column:
    """ISO text as a point in time, or null; without an offset it is UTC in any session.

    Dates may be written with slashes or full stops instead of hyphens.
    """
    iso = F.regexp_replace(clean(text), r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"^(\S+[ T]\d{1,2}:\d{2})$", "$1:00")
    whole = (
        F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(iso, F.lit("T00:00:00Z")))
        .when(iso.rlike(r":\d{2}(?:\.\d+)?$") & ~iso.rlike(r"[+-]\d{1,2}:\d{2}$"), F.concat(iso, F.lit("Z")))
        .otherwise(iso)
    )
    return F.try_to_timestamp(F.nullif(whole, F.lit("")))
