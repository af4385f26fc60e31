"""Merkle manifest (operator 13): every row a leaf, a hash tree per source, one root over all sources.

Slot pivot: the nodes of a level are numbered within their source, so number
div FANOUT is a node's parent and the remainder its slot. Conditional
aggregates spread the children of a parent into FANOUT columns, one row per
parent. Those columns concatenated hash to the parent; the same columns without
the own one are a child's siblings. Groups have FANOUT rows at most, whatever
the size of a source, and most of them meet before the shuffle, as rows are
numbered in sorted order.

Upwards each level has a sixteenth of the rows of the one below. Downwards a
parent hands its children its own way to the root, as steps (what stands before
the own digest, what stands after it). Leaves get theirs from their parent's
row, where their siblings are already, so the leaves are shuffled once for
their number and once for the pivot, and the long ways only a sixteenth as often.

Numbers come from a range partition and the sizes of its parts; no window and
no task holds a source. Every level is stored before the next one is built.

Cases. A null in any column is hashed as `-`, an empty text as `0:`. The source
null is a source of its own, before all others. Rows with the same doc_id stand
in the order of their leaves, a null doc_id first; equal rows are leaves each.
Of an empty table there is no root and no row. Other columns are not read; very
long texts are hashed by the JVM in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadkin.operators.lookup import heavy_light_lookup
from leadkin.operators.ranking import number_rows
from leadkin.session import cut

FANOUT = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, other: digest of each row, and the digest it has where the text of column `altered` is in its place (null: as it is)."""
    head = F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), _hash(head, _field(altered)))
    # the name of a tree is never null and sorts like the source, null first
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), _hash(head, _field(F.col("text"))).alias("leaf"), other.alias("other"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds pos (from 0 in each tree, by doc_id and leaf) and size (leaves of the tree)."""
    found, total = number_rows(rows, [F.col("tree"), F.col("doc_id"), F.col("leaf")], "n")
    trees = cut(found.groupBy("tree").agg(F.min("n").alias("first"), F.count("*").alias("size")))
    return heavy_light_lookup(found, trees, ["tree"], "size", total, F.col("n")).withColumn("pos", F.col("n") - F.col("first")).drop("n", "first")


def pivoted(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tree, pos, size (nodes of the tree on the children's level), c0 … : one row per parent, a column per slot with (h, and whatever else `nodes` has)."""
    slot = F.pmod("pos", F.lit(fanout))
    child = F.struct("h", *[c for c in nodes.columns if c not in ("tree", "pos", "size", "h")])
    columns = [F.max(F.when(slot == i, child)).alias(f"c{i}") for i in range(fanout)]
    return nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.max("size").alias("size"), *columns)


def _digests(fanout: int) -> list[Column]:
    return [F.col(f"c{i}.h") for i in range(fanout)]


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Pivoted levels from the leaves up, and the tops of all trees: tree, level, h."""
    levels, tops, k = [], [], 0
    while True:
        level = cut(pivoted(nodes, fanout))
        lone = level.filter("size = 1").select("tree", F.lit(k).alias("level"), F.col("c0.h").alias("h"))
        tops.append(lone)
        levels.append(level)
        if level.filter("size > 1").isEmpty():
            break
        up = F.ceil(F.col("size") / fanout).alias("size")
        nodes, k = level.filter("size > 1").select("tree", "pos", up, _hash(*_digests(fanout)).alias("h")), k + 1
    found = tops[0]
    for lone in tops[1:]:
        found = found.unionByName(lone)
    return levels, cut(found)


def _steps(level: DataFrame, above: DataFrame, fanout: int, *more: str) -> DataFrame:
    """Children of a level with their way to the root: the own step, then the way of the parent."""
    digests = _digests(fanout)

    def child(i: int) -> Column:
        step = F.struct(F.concat_ws("", *digests[:i]).alias("before"), F.concat_ws("", *digests[i + 1 :]).alias("after"))
        kept = [F.col(f"c{i}.{c}").alias(c) for c in ("h", *more)]
        return F.struct((F.col("pos") * fanout + i).alias("pos"), *kept, F.concat(F.array(step), F.col("way")).alias("way"))

    joined = level.filter("size > 1").join(above, ["tree", "pos"])
    each = joined.select("tree", "top", F.explode(F.array(*[child(i) for i in range(fanout)])).alias("x"))
    return each.filter("x.h is not null").select("tree", "top", "x.*")


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, *more: str) -> DataFrame:
    """tree, top, pos, h, way and the columns `more` of every leaf. `tops`: tree, level, top, way."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ended = tops.filter(F.col("level") == k)
        if k == 0:
            kept = ["pos", *[F.col(f"c0.{c}").alias(c) for c in ("h", *more)]]
            below = levels[0].filter("size = 1").join(ended.select("tree", "top", "way"), "tree").select("tree", "top", *kept, "way")
        else:
            below = ended.select("tree", "top", F.lit(0).cast("long").alias("pos"), "way")
        if above is not None:
            found = _steps(levels[k], above, fanout, *(more if k == 0 else ()))
            below = below.unionByName(found if k == 0 else found.drop("h"))
        above = below if k == 0 else cut(below)
    return above


def prove(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, other, subroot, root and way of every row of `leaves`."""
    nodes = numbered(rows).select("tree", "pos", "size", F.col("leaf").alias("h"), "doc_id", "other")
    levels, subroots = climb(nodes, fanout)
    ordered, trees = number_rows(subroots, [F.col("tree")], "n")
    ordered = cut(ordered)
    over = ordered.select(F.lit("").alias("tree"), (F.col("n") - 1).alias("pos"), F.lit(trees).cast("long").alias("size"), "h", F.col("tree").alias("name"), "level")
    upper, roots = climb(over, fanout)
    root = roots.first()
    root = root["h"] if root else None
    no_way = F.array().cast("array<struct<before: string, after: string>>")
    joined = descend(upper, roots.select("tree", "level", F.col("h").alias("top"), no_way.alias("way")), fanout, "name", "level")
    named = cut(joined.select(F.col("name").alias("tree"), F.col("level"), F.col("h").alias("top"), "way"))
    found = descend(levels, named, fanout, "doc_id", "other")
    return found.select("doc_id", F.col("h").alias("leaf"), "other", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "way")


def proof(way: Column) -> Column:
    """Digest of all siblings on a way, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(start: Column, way: Column) -> Column:
    """The root that a digest leads to with the siblings of a way."""
    return F.aggregate(way, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def digests(docs: DataFrame, altered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the altered leaf if there is one), verified."""
    found = prove(leaves(docs, altered), fanout)
    found = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("way")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered() -> Column:
    """Lower-cased text of the rows whose doc_id has a CRC-32 that 5 divides; null for the others."""
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, lowered(F.col("text").cast("string")))


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars"))


def _text(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}) || ':' || {column} END"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_FIELDS} || {_text("text")}) AS leaf,
      sha256({_FIELDS} || {_text("CASE WHEN " + _CRC + " % 5 = 0 THEN translate(text, '" + _UPPER + "', '" + _UPPER.lower() + "') ELSE text END")}) AS begun
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM hashed
), nodes(k, tree, pos, size, h) AS (
  SELECT 0, tree, pos, size, leaf FROM placed
  UNION ALL
  SELECT k + 1, tree, pos // {FANOUT}, max((size + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY k, tree, pos // {FANOUT}
), tops AS (
  SELECT tree, k AS height, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), upper(k, pos, size, h) AS (
  SELECT 0, pos, size, h FROM tops
  UNION ALL
  SELECT k + 1, pos // {FANOUT}, max((size + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE size > 1 GROUP BY k, pos // {FANOUT}
), root AS (
  SELECT h FROM upper WHERE size = 1
), runs AS (
  SELECT k, tree, pos // {FANOUT} AS pos, list(h ORDER BY pos) AS hs FROM nodes WHERE size > 1 GROUP BY k, tree, pos // {FANOUT}
  UNION ALL
  SELECT k, NULL, pos // {FANOUT}, list(h ORDER BY pos) FROM upper WHERE size > 1 GROUP BY k, pos // {FANOUT}
), walk(doc_id, leaf, tree, inside, k, pos, seen, h) AS (
  SELECT doc_id, leaf, tree, size > 1, 0, CASE WHEN size > 1 THEN pos ELSE (SELECT t.pos FROM tops t WHERE t.tree = placed.tree) END, '', begun FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.inside AND w.k + 1 < t.height, CASE WHEN w.inside AND w.k + 1 = t.height THEN 0 ELSE w.k + 1 END,
      CASE WHEN w.inside AND w.k + 1 = t.height THEN t.pos ELSE w.pos // {FANOUT} END,
      w.seen || array_to_string(r.hs[: w.pos % {FANOUT}], '') || array_to_string(r.hs[w.pos % {FANOUT} + 2 :], ''),
      sha256(array_to_string(r.hs[: w.pos % {FANOUT}], '') || w.h || array_to_string(r.hs[w.pos % {FANOUT} + 2 :], ''))
  FROM walk w JOIN tops t ON t.tree = w.tree
  JOIN runs r ON r.k = w.k AND r.pos = w.pos // {FANOUT} AND r.tree IS NOT DISTINCT FROM CASE WHEN w.inside THEN w.tree END
), ended AS (
  SELECT * FROM walk WHERE NOT inside AND k = (SELECT max(k) FROM upper)
)
SELECT e.doc_id, e.leaf, t.h AS subroot, root.h AS root, sha256(e.seen) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM ended e JOIN tops t ON t.tree = e.tree CROSS JOIN root
"""
