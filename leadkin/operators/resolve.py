"""Which registry company a name stands for.

Names are looked up in two steps: keywords equal to a registry name, then
keywords contained in one. Only keywords that could still beat the result of the
first step take part in the second. There they are dealt into blocks of bounded
size, each made into one automaton that finds all its keywords in one pass over
a name, so a name costs the same however many keywords there are in a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.functions import text
from leadkin.functions.udfs import name_ratio
from leadkin.session import cut, parallelism

# Letters of keywords in one automaton (about a hundred bytes each), and of names read past it by one task.
BLOCK_CHARS = 1 << 20
PART_CHARS = 1 << 20
PAIRS_AT_ONCE = 20_000


def usable(registry: DataFrame) -> DataFrame:
    """Registered, approved companies with a name and a number."""
    status, described = text.blank(F.col("Company_Status")), text.blank(F.col("Company_Status_Desc"))
    return registry.filter(
        (text.blank(F.col("Company_Name")) != "")
        & (text.blank(F.col("Business_Accounting_NO")) != "")
        & status.isin("", fixed.REGISTRY_ACTIVE)
        & ((described == "") | described.contains(fixed.REGISTRY_APPROVED))
    )


def tier(target: Column, target_core: Column, name: Column, core: Column, fuzzy: bool = True) -> Column:
    """Position of the match in MATCH_TIERS, or null. An empty name matches nothing."""
    both = (target != "") & (name != "")
    cores = (target_core != "") & (core != "")
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    found = (
        F.when(both & (target == name), 0)
        .when(cores & (target_core == core), 1)
        .when(both & within(target, name), 2)
        .when(cores & within(target_core, core), 3)
    )
    if not fuzzy:
        return found
    # a ratio of r needs a length ratio of at least r / (2 - r)
    near = F.least(F.length(target_core), F.length(core)) * (2 - fixed.FUZZY_RATIO) >= (
        F.greatest(F.length(target_core), F.length(core)) * fixed.FUZZY_RATIO
    )
    asked = found.isNull() & cores & near
    ratio = name_ratio(F.when(asked, target_core), F.when(asked, core))
    return F.coalesce(found, F.when(ratio >= fixed.FUZZY_RATIO, 4))


def keywords(*words: Column) -> Column:
    """Ordered, distinct keywords out of several spellings that are long enough to search for."""
    usable = F.filter(F.concat(*words), lambda w: (w.k != "") & (w.n >= fixed.MIN_KEYWORD_LENGTH))
    return F.array_distinct(F.transform(usable, lambda w: w.k))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and part, keywords before names; a group may go over several batches."""
    group, tree, ready, found = None, None, False, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*found)], names=["keyword", "name"])

    for batch in batches:
        for block, part, is_name, value in zip(*[c.to_pylist() for c in batch.columns]):
            if (block, part) != group:
                group, tree, ready = (block, part), ahocorasick.Automaton(), False
            if not is_name:
                tree.add_word(value, value)
                continue
            if not ready:
                tree.make_automaton()
                ready = True
            if len(tree):
                found += [(word, value) for word in {word for _, word in tree.iter(value)}]
            if len(found) >= PAIRS_AT_ONCE:
                yield out()
                found = []
    if found:
        yield out()


def containing(words: DataFrame, names: DataFrame, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """(keyword, name) where the name contains the keyword; both inputs are distinct.

    A task holds one block of keywords and reads its part of the names past it
    row by row. Names are sent once for each block, keywords once for each part.
    An empty keyword or name is in no pair.
    """
    words, names = words.filter("keyword <> ''"), names.filter("name <> ''")
    chars = lambda df, c: df.agg(F.sum(F.length(c))).first()[0] or 0
    blocks, parts = -(-chars(words, "keyword") // block_chars), -(-chars(names, "name") // part_chars)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    left = words.select(dealt("keyword", blocks).alias("block"), every(parts).alias("part"), F.lit(False).alias("is_name"), F.col("keyword").alias("value"))
    right = names.select(every(blocks).alias("block"), dealt("name", parts).alias("part"), F.lit(True).alias("is_name"), F.col("name").alias("value"))
    sorted_rows = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "is_name")
    return sorted_rows.mapInArrow(_matched, "keyword string, name string")


def spread(names: DataFrame, *keys: str) -> DataFrame:
    """Different names over all cores. Names are short, so adaptive execution would leave few tasks to work out their spellings.

    By a hash of the keys, as Spark takes out a shuffle by keys that rows are dealt by already.
    """
    return names.repartition(parallelism(names.sparkSession), F.xxhash64(*keys))


def prepared(registry: DataFrame) -> DataFrame:
    """Each usable name once with its first row and its spellings; stored, as every step of `resolve` reads it."""
    known = usable(registry).groupBy(text.blank(F.col("Company_Name")).alias("name")).agg(F.min("reg_ord").alias("reg_ord"))
    return cut(text.with_spellings(spread(known, "name"), "name", "").drop("words"))


def resolve(targets: DataFrame, registry: DataFrame | None, id: str, names: list[str], fuzzy: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Best registry row per target: (id, reg_ord, match_tier). `known`, if given, is the prepared registry.

    Order of preference: keyword, equality before containment, tier of the
    first spelling that matches, order of the registry. `registry` needs a
    unique `reg_ord`. Equal targets are resolved once.
    """
    known = prepared(registry) if known is None else known
    spelled = targets.select(id, *[text.blank(F.col(n)).alias(f"_n{i}") for i, n in enumerate(names)])
    spellings = [f"_n{i}" for i in range(len(names))]
    wanted = spread(spelled.select(*spellings).distinct(), *spellings).withColumn("tid", F.monotonically_increasing_id())
    for c in spellings:
        wanted = text.with_spellings(wanted, c, f"{c}_")
    wanted = cut(wanted.withColumn("keywords", keywords(*[F.col(f"{c}_words") for c in spellings])).drop(*[f"{c}_words" for c in spellings]))
    asked = wanted.select("tid", F.posexplode("keywords").alias("kw_ord", "keyword"))

    def judged(pairs: DataFrame, op: int) -> DataFrame:
        full = pairs.join(wanted.drop("keywords", *spellings), "tid")
        tiers = [tier(F.col(f"{c}_plain"), F.col(f"{c}_core"), F.col("plain"), F.col("core"), fuzzy) for c in spellings]
        rated = full.withColumn("tier", F.coalesce(*tiers)).filter(F.col("tier").isNotNull())
        return rated.groupBy("tid").agg(F.min(F.struct("kw_ord", F.lit(op).alias("op"), "tier", "reg_ord")).alias("best"))

    equal = cut(judged(asked.join(known, asked.keyword == known.name).select("tid", "kw_ord", "reg_ord", "plain", "core"), 0))
    open_words = asked.join(equal, "tid", "left").filter(F.col("best").isNull() | (F.col("kw_ord") < F.col("best.kw_ord"))).select(
        "tid", "kw_ord", "keyword"
    )
    found = containing(cut(open_words.select("keyword").distinct()), known.select("name"))
    like = judged(open_words.join(found, "keyword").join(known, "name").select("tid", "kw_ord", "reg_ord", "plain", "core"), 1)
    best = equal.unionByName(like).groupBy("tid").agg(F.min("best").alias("best"))
    by_name = wanted.select("tid", *spellings).join(best, "tid")
    return spelled.join(by_name, spellings).select(
        id, F.col("best.reg_ord").alias("reg_ord"), F.element_at(F.array(*[F.lit(t) for t in fixed.MATCH_TIERS]), F.col("best.tier") + 1).alias("match_tier")
    )
