"""One row per key, and companies that are on both lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin.operators.columns import col
from leadkin.operators.components import components
from leadkin.operators.lookup import left_lookup
from leadkin.session import cut

AT_ONCE = 200_000  # pairs of keys that one task settles


def _one_per(df: DataFrame, keys: list[Column], pick) -> DataFrame:
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(pick.alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; null and blank keys are equal.

    An aggregate, not a window: it combines on the map side, so a key with a
    third of all rows costs one row per task.
    """
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    row = F.struct(*[col(c) for c in df.columns])
    return _one_per(df, parts, F.max_by(row, F.struct(*[col(c) for c in order])))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[col(c) for c in df.columns])
    return _one_per(df, [col(k) for k in keys], F.min_by(row, F.struct(*[col(c) for c in order])))


def duplicate_counts(potentials: DataFrame, customers: DataFrame, name: str, number: str, spread: str) -> DataFrame:
    """How many customers share a potential's non-blank name key or number.

    Customers are counted per key before any join, and those that share both
    are taken off once, so no pair of companies is ever formed.
    """
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    by_both = customers.select(known(name).alias("_n"), known(number).alias("_c"))

    def counts(keys: list[str], out: str) -> DataFrame:
        return by_both.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(out))

    out = potentials.withColumns({"_n": known(name), "_c": known(number)})
    columns = [*potentials.columns, "duplicate_customers"]
    for keys, label in ((["_n"], "_same_name"), (["_c"], "_same_number"), (["_n", "_c"], "_same_both")):
        out = left_lookup(out, counts(keys, label), keys, F.col(spread))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shared = zero("_same_name") + zero("_same_number") - zero("_same_both")
    return out.withColumn("duplicate_customers", shared).select(*[col(c) for c in columns])


def keep_in_turn(df: DataFrame, order: str, own: str, matched: str, at_once: int = AT_ONCE) -> DataFrame:
    """Rows kept when each kept row bars later rows whose own or matched key equals its matched key.

    `order` is unique; null and blank keys bar nothing. Of all rows with a matched
    key at most one is kept, and of those with the same two keys only the first
    can be: later ones are barred by whatever bars it, or by itself. So one row
    per pair of keys decides, and most pairs decide alone: own and matched key
    are the same, or no row is matched to the own key.

    What is left is a graph of keys. Up to `at_once` pairs are settled in their
    order by one task, however long the chains are. Beyond that the graph falls
    into components; each is settled by a task, and only components of over
    `at_once` pairs go round by round.
    """
    rows = cut(df)
    usable = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    pairs = rows.filter(usable(matched)).groupBy(F.col(matched).cast("string").alias("m"), F.col(own).cast("string").alias("o")).agg(F.min(order).alias("at"))
    pairs = cut(pairs.withColumn("o", F.when((F.col("o") == "") | (F.col("o") == F.col("m")), None).otherwise(F.col("o"))))
    firsts = pairs.groupBy("m").agg(F.min("at").alias("at"))
    crossing = cut(pairs.filter("o is not null").join(pairs.select(F.col("m").alias("o")).distinct(), "o", "left_semi"))
    keys = crossing.select("m").union(crossing.select("o")).distinct()
    kept = firsts.join(keys, "m", "left_anti").unionByName(_settled(pairs, crossing, keys, at_once))
    kept = cut(kept.select(F.col("m").alias("_key"), F.col("at").alias("_at")))
    whole = left_lookup(rows, kept.select(F.col("_key").alias(matched), F.col("_at").alias("_mine")), [matched], F.col(order))
    whole = left_lookup(whole, kept.select(F.col("_key").alias(own), F.col("_at").alias("_bar")), [own], F.col(order))
    alone = ~usable(matched) & F.coalesce(F.col("_bar") > F.col(order), F.lit(True))
    return whole.filter(F.coalesce(F.col("_mine") == F.col(order), F.lit(False)) | alone).select(*[col(c) for c in df.columns])


def _settled(pairs: DataFrame, crossing: DataFrame, keys: DataFrame, at_once: int) -> DataFrame:
    """(m, at): the kept row of each matched key that is linked to another key."""
    linked = cut(pairs.join(keys, "m", "left_semi"))
    if linked.limit(at_once + 1).count() <= at_once:
        return _by_task(linked.withColumn("root", F.lit("")))
    parts = components(crossing.select(F.col("m").alias("a"), F.col("o").alias("b"))).withColumnRenamed("node", "m").distinct()
    linked = cut(linked.join(parts, "m"))
    sizes = linked.groupBy("root").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > at_once).select("root"))
    small = _by_task(linked.join(large, "root", "left_anti"))
    return small if large.isEmpty() else small.unionByName(_by_rounds(linked.join(large, "root", "left_semi").select("m", "o", "at")))


def _by_task(linked: DataFrame) -> DataFrame:
    """(m, at) of the kept rows, component by component in row order."""

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, int] = {}
        for m, o, at in part.sort_values("at")[["m", "o", "at"]].itertuples(index=False):
            if m not in kept and o not in kept:
                kept[m] = at
        return pd.DataFrame({"m": list(kept), "at": pd.Series(list(kept.values()), dtype="int64")})

    return linked.groupBy("root").applyInPandas(settle, "m string, at long")


def _by_rounds(linked: DataFrame) -> DataFrame:
    """(m, at) of the kept rows. A row is settled once every earlier row that could bar it is; each round settles the first open row of every key."""
    rest, kept = cut(linked), None
    while True:
        firsts = rest.groupBy("m").agg(F.min("at").alias("_open")).withColumn("_kept", F.lit(None).cast("long"))
        if kept is not None:
            done = kept.select("m", F.lit(None).cast("long").alias("_open"), F.col("at").alias("_kept"))
            firsts = firsts.unionByName(done).groupBy("m").agg(F.min("_open").alias("_open"), F.min("_kept").alias("_kept"))
        seen = rest
        for key in ("m", "o"):
            table = firsts.select(F.col("m").alias(key), F.col("_open").alias(f"_open_{key}"), F.col("_kept").alias(f"_kept_{key}"))
            seen = left_lookup(seen, table, [key], F.col("at"))
        earlier = lambda kind: F.least(F.col(f"{kind}_m"), F.col(f"{kind}_o")) < F.col("at")
        barred, waiting = (F.coalesce(earlier(kind), F.lit(False)) for kind in ("_kept", "_open"))
        settled = cut(seen.withColumn("_state", F.when(barred, "gone").when(waiting, "open").otherwise("kept")).select("m", "o", "at", "_state"))
        new = settled.filter("_state = 'kept'").select("m", "at")
        kept = new if kept is None else kept.unionByName(new)
        rest = settled.filter("_state = 'open'").drop("_state")
        if rest.isEmpty():
            return kept
