"""Score potentials against customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.operators import pairs, tfidf
from leadkin.operators.companies import companies
from leadkin.operators.columns import col
from leadkin.operators.ranking import number_rows, with_percentile
from leadkin.session import cut, fill_cores

COMPONENT_COLUMNS = {k: f"{k}_similarity_component" for k in pairs.COMPONENTS}


def vectors_for(potentials: DataFrame, customers: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Both sides with their unit gram vectors, and the two row counts."""
    sizes = (potentials.count(), customers.count())
    words = tfidf.vocabulary_of(*[df.select("id", *fields) for df in (potentials, customers)], fields, sum(sizes))
    p, c = (tfidf.with_vectors(df, fields, words) for df in (potentials, customers))
    return p, c, sizes


def text_scores(potentials: DataFrame, customers: DataFrame, **options) -> DataFrame:
    """Best text matches of (id, company, text) rows: (id, v_total, b_*)."""
    # stored, as the counts, the vocabulary and the vectors all read the prepared texts
    p, c, sizes = vectors_for(*[cut(fill_cores(df, "id")) for df in (potentials, customers)], ["text"])
    return pairs.score_texts(p, c, sizes, **options)


def company_scores(potentials: DataFrame, customers: DataFrame, **options) -> DataFrame:
    """Best values of every potential; stored, since several outputs read it."""
    # stored, as the vocabulary, the vectors and the scores all read them
    sides = [cut(companies(fill_cores(df, fixed.ROW_ORD), label)) for df, label in ((potentials, "potentials"), (customers, "customers"))]
    p, c, sizes = vectors_for(*sides, pairs.TEXT_FIELDS)
    coverage = sides[0].select("id", "coverage")
    once = sides[0].agg(F.count("id") == F.count("*")).first()[0] and coverage.groupBy("id").count().filter("count > 1").isEmpty()
    if once:  # then a row keeps its own coverage, and the scores, which are many times larger, need not be shuffled
        return cut(pairs.score_companies(p, c, sizes, carried=["coverage double"], **options))
    return cut(pairs.score_companies(p, c, sizes, **options).join(coverage, "id"))


def rank_companies(potentials: DataFrame, scored: DataFrame) -> DataFrame:
    """All columns of the potentials with rank, scores, explanation and percentile."""
    scores = scored.select(
        "id",
        pairs.top_mix("v_total").alias("similarity_score"),
        pairs.mean_of_top("v_total", 1).alias("max_pair_similarity"),
        pairs.mean_of_top("v_total", 3).alias("top3_mean_similarity"),
        pairs.mean_of_top("v_total", 10).alias("top10_mean_similarity"),
        *[pairs.top_mix(f"v_{k}").alias(name) for k, name in COMPONENT_COLUMNS.items()],
        F.col("b_company").alias("_names"),
        F.array_join(F.transform("b_total", lambda x: F.format_number(x, 4)), " | ").alias("top_existing_customer_scores"),
        F.coalesce(F.get("b_total", F.lit(0)), F.lit(0.0)).alias("top_existing_customer_score"),
        F.col("duplicate").alias("is_existing_customer_duplicate"),
        F.col("coverage").alias("feature_coverage"),
    )
    order = [F.col(c).desc() for c in ("similarity_score", COMPONENT_COLUMNS["welfare"], COMPONENT_COLUMNS["industry"])]
    ranked, total = number_rows(scores, [*order, F.col("id").asc()], "rank")
    ranked = with_percentile(ranked, "similarity_score", "rank", total, "score_percentile")
    names = _clean_names(ranked)
    wide = potentials.withColumn("id", F.col(fixed.ROW_ORD).cast("long")).join(names, "id")
    tail = [c for c in names.columns if c not in ("id", "rank", "feature_coverage", "score_percentile")]
    return wide.select(
        "rank", *[col(c) for c in potentials.columns], *tail, "feature_coverage", "score_percentile"
    )


def _clean_names(ranked: DataFrame) -> DataFrame:
    """Clean the matched names in one pass over the joined list.

    A line feed inside a name is white space and becomes a space when cleaned,
    so the unit separator used here can only come from the join.
    """
    mark = "\x1f"
    folded = text.nfkc(F.array_join(F.transform("_names", lambda n: F.replace(F.coalesce(n, F.lit("")), F.lit(mark), F.lit(" "))), mark))
    each = F.transform(
        F.split(F.replace(folded, F.lit("臺"), F.lit("台")), mark),
        lambda n: F.trim(F.regexp_replace(n, text.SPACE, " ")),
    )
    return ranked.withColumn("top_existing_customer_names", F.array_join(each, " | ")).drop("_names")


def match_rows(potentials: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per potential and match: the five best customers with all component scores."""
    lists = ["b_company", "b_total", *[f"b_{k}" for k in pairs.COMPONENTS]]
    one = scored.select("id", F.posexplode(F.arrays_zip(*lists)).alias("at", "m"))
    names = potentials.select(F.col(fixed.ROW_ORD).cast("long").alias("id"), col(fixed.NAME).alias("potential_company"))
    return one.join(names, "id").select(
        F.col("id").alias("potential_row_ord"),
        "potential_company",
        (F.col("at") + 1).alias("match_rank"),
        F.col("m.b_company").alias("existing_customer"),
        F.col("m.b_total").alias("total_similarity"),
        *[F.col(f"m.b_{k}").alias(f"{k}_similarity") for k in pairs.COMPONENTS],
    )


def score(customers: DataFrame, potentials: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(ranking, top matches). Both inputs need a unique `row_ord`, the order that breaks ties."""
    scored = company_scores(potentials, customers, **options)
    return rank_companies(potentials, scored), match_rows(potentials, scored)
