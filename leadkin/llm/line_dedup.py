"""Line dedup (operator 10): chunks of lines with content-defined boundaries. DataFrame functions only.

Every line has a 32-bit hash. A rolling hash over a line and the one before it
decides whether a chunk ends there, on average after CHUNK lines. So boundaries
depend on two lines only: what is added or taken away elsewhere in a document
does not move them, and a passage that several documents share falls into the
same chunks in all of them, but for its edges. A line of over LONG words is a
passage by itself: boundaries lie before and after it.

Chunks of two or more lines and long lines are grouped by their whole text, so
only chunks with the same bytes count as equal. The first document (smallest doc_id) keeps
a repeated chunk at its first place; everywhere else it is removed. A chunk of
one line that is not long is never removed. Rejoined lines give exactly the text that was.

Copies of a chunk are counted before the shuffle, so a chunk that a third of
all documents have is a few rows. From there on only chunk keys travel (two
unrelated hashes); a second join brings each document its removed places. Texts
are shuffled twice in all and never collected.

`dedup_runs`, which the pipeline uses, takes out more: besides those chunks,
every run of lines of over LONG words in all that stands, byte for byte, at an earlier
place (smaller doc_id, or further up without overlap), and whole texts of
several lines that an earlier document has. From each line the shortest run of over LONG
words goes down and another goes up; together these windows cover every line
of any longer run that is repeated. Only lines that stand at several places are
followed up; all others leave after a count of line hashes. Windows are compared by SHA-256 over
those of their lines. Every line that goes has an equal one at an earlier place, so the first stays.

Cases. Null text stays null. A document that consists of repeated chunks only
keeps its row and becomes empty. Rows with the same doc_id and text count as one
document and keep the same chunks; with the same doc_id and different texts they
are documents of their own, in the order of the texts' MD5. Rows without doc_id
stay as they are and do not count. Blank lines are lines. An empty table stays
empty. A very long text is cut up in the task of its row, and its lines are
numbered in one. Other columns are kept as they are, also those with clashing
names; `n_chars`, if there is one, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadkin.operators.lookup import heavy_light_lookup
from leadkin.session import cut

CHUNK = 3
LONG = 50
_MULTIPLIER = 31
_LINES = 1 << 31  # over the lines of any text


def line_hashes(lines: Column) -> Column:
    """First 32 bits of each line's MD5."""
    return F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint"))


def is_long(line: Column) -> Column:
    """Over LONG words, parted by blanks or tabs."""
    return F.regexp_count(line, F.lit("[^ \\t]+")) > LONG


def chunks(text: Column, chunk: int = CHUNK) -> Column:
    """Array of (start, n_lines, passage, text) that, joined by line feeds, are the text again; passages may be removed."""
    lines = F.split(text, "\n", -1)

    def cut_lines(both: Column) -> Column:
        lines, hashes, long = both["lines"], both["hashes"], both["long"]
        n = F.size(lines)
        rolled = lambda i: (i > 1) & ((F.get(hashes, i - 2) * _MULTIPLIER + F.get(hashes, i - 1)) % 1000003 % chunk == 0)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get(long, i - 1) | F.get(long, i) | rolled(i))
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda x: F.struct(
                x["a"].alias("start"),
                (x["b"] - x["a"]).alias("n_lines"),
                ((x["b"] - x["a"] > 1) | F.get(long, x["a"])).alias("passage"),
                F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n").alias("text"),
            ),
        )

    # one-element arrays, so that lines and what is known of them are worked out once for all uses
    known = lambda lines: F.struct(lines.alias("lines"), line_hashes(lines).alias("hashes"), F.transform(lines, is_long).alias("long"))
    both = F.transform(F.array(lines), known)
    return F.get(F.transform(both, cut_lines), 0)


def _key(text: Column) -> Column:
    """Two unrelated hashes, so texts made to share one of them still differ."""
    return F.unhex(F.concat(F.md5(text), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def _strong(text: Column) -> Column:
    """Half of a SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _body(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart, and orders them."""
    return F.unhex(F.md5(text))


def removed(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, body, places: the chunks (counted from 0) that a text loses."""
    given = docs.filter("doc_id is not null and text is not null")
    parts = given.select("doc_id", _body(F.col("text")).alias("body"), chunks(F.col("text"), chunk).alias("parts"))
    large = parts.select("doc_id", "body", F.posexplode("parts").alias("place", "part")).filter("part.passage")
    # equal bytes, not only equal hashes; copies are summed up before anything is shuffled
    same = large.groupBy(F.col("part.text").alias("text")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).filter("n > 1")
    repeated = cut(same.select(_key(F.col("text")).alias("key"), "keeper", "n"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    keyed = large.select("doc_id", "body", "place", _key(F.col("part.text")).alias("key"))
    # the few chunks that a large share of all places can have are sent to the workers, so no task gets all places of one
    places = heavy_light_lookup(keyed, repeated, ["key"], "n", total, F.xxhash64("doc_id", "body", "place")).filter("keeper is not null").select("doc_id", "body", "place", "key", "keeper")
    places = cut(places)
    # the first place, among the texts of the keeper, of which there is one but for repeated ids
    firsts = places.filter("doc_id = keeper").groupBy("key").agg(F.min(F.struct("body", "place")).alias("first")).withColumnRenamed("key", "first_key")
    own = places.filter("doc_id = keeper").join(firsts, F.col("key") == F.col("first_key")).filter(F.struct("body", "place") != F.col("first"))
    lost = places.filter("doc_id <> keeper").select("doc_id", "body", "place").unionByName(own.select("doc_id", "body", "place"))
    return lost.groupBy("doc_id", "body").agg(F.collect_set("place").alias("places"))


def _named(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Columns by number, with the digest of the text beside them, and the names of doc_id and text."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    return plain.withColumn("hash", _body(F.col(text))), id_, text


def _joined(plain: DataFrame, found: DataFrame, id_: str, name: str) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": f"{name}_id", "body": f"{name}_body"})
    return plain.join(found, (F.col(id_) == F.col(f"{name}_id")) & (F.col("hash") == F.col(f"{name}_body")), "left")


def _written(joined: DataFrame, docs: DataFrame, text: str, same: Column, fresh: Column) -> DataFrame:
    """The columns of `docs` with the new text, and its length in `n_chars` if there is one."""
    names = docs.columns
    joined = joined.withColumn("same", same).withColumn(text, F.when(F.col("same"), F.col(text)).otherwise(fresh))
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        joined = joined.withColumn(n, F.when(F.col("same"), F.col(n)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def dedup(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`docs` with repeated chunks taken out of `text`; same columns, same rows."""
    plain, id_, text = _named(docs)
    joined = _joined(plain, cut(removed(plain.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")), chunk)), id_, "lost")
    kept = F.filter(chunks(F.col(text), chunk), lambda part, i: ~F.array_contains("places", i))
    return _written(joined, docs, text, F.col("places").isNull(), F.array_join(F.transform(kept, lambda p: p["text"]), "\n"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, body, at, hash, words: every line that stands at more than one place, once per text."""
    given = docs.filter("doc_id is not null and text is not null")
    words = lambda line: F.regexp_count(line, F.lit("[^ \\t]+")).cast("int")
    lines = given.select("doc_id", _body(F.col("text")).alias("body"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("doc_id", "body", "at", _strong(F.col("line")).alias("hash"), words(F.col("line")).alias("words"))
    counts = cut(lines.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    again = heavy_light_lookup(lines, counts, ["hash"], "n", total, F.xxhash64("doc_id", "body", "at")).filter("n is not null").drop("n")
    return again.repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "at"])


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, body, key, start, n: shortest runs of over LONG words from each line down and up, of lines that stand elsewhere too, and whole texts of several lines."""
    row = Window.partitionBy("doc_id", "body")
    # lines without a gap between them have the same difference of number and rank
    lines = repeated_lines(docs).withColumn("island", F.col("at") - F.row_number().over(row.orderBy("at")))
    row = Window.partitionBy("doc_id", "body", "island")
    summed = lines.withColumn("through", F.sum("words").over(row.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumns({"down": (F.col("through") - F.col("words")) * _LINES + F.col("at"), "up": F.col("through") * _LINES + F.col("at")})
    # a frame reaches as far as the lines between its two ends, without the far one, have LONG words at most
    reach = (LONG + 1) * _LINES - 1
    down, up = row.orderBy("down").rangeBetween(0, reach), row.orderBy("up").rangeBetween(-reach, 0)
    of = lambda frame: F.struct(F.min("at").over(frame).alias("start"), F.count("*").over(frame).alias("n"), F.sum("words").over(frame).alias("words"), F.collect_list("hash").over(frame).alias("hashes"))
    both = summed.select("doc_id", "body", "words", of(down).alias("d"), of(up).alias("u"))
    # a run up that is a run down as well counts once
    up_only = F.when(F.col("u.words") - F.col("words") > LONG, F.col("u"))
    each = both.select("doc_id", "body", F.explode(F.array(F.col("d"), up_only)).alias("w")).filter(f"w.words > {LONG}")
    key = _strong(F.array_join(F.transform("w.hashes", lambda h: F.hex(h)), ""))
    runs = each.select("doc_id", "body", key.alias("key"), F.col("w.start").cast("int").alias("start"), F.col("w.n").cast("int").alias("n"))
    given = docs.filter("doc_id is not null and text is not null and contains(text, '\n')")
    count = F.regexp_count("text", F.lit("\n")).cast("int") + 1
    whole = given.select("doc_id", _body(F.col("text")).alias("body"), _strong(F.concat(F.lit("whole "), "text")).alias("key"), F.lit(0).alias("start"), count.alias("n"))
    return runs.unionByName(whole)


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, body, runs (start, n): the lines that an earlier place has as part of the same window."""
    found = cut(windows(docs))
    place = F.struct("doc_id", "body", "start")
    repeated = cut(found.groupBy("key").agg(F.count("*").alias("times"), F.min(place).alias("keeper")).filter("times > 1"))
    total = repeated.agg(F.sum("times")).first()[0] or 0
    places = heavy_light_lookup(found, repeated, ["key"], "times", total, F.xxhash64("doc_id", "body", "start")).filter("keeper is not null")
    other = (F.col("doc_id") != F.col("keeper.doc_id")) | (F.col("body") != F.col("keeper.body"))
    later = places.filter(other | (F.col("start") >= F.col("keeper.start") + F.col("n")))
    return later.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def dedup_runs(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`docs` without repeated chunks, repeated runs of over LONG words and repeated whole texts of several lines; same columns, same rows."""
    plain, id_, text = _named(docs)
    slim = plain.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))
    lost, runs = cut(removed(slim, chunk)), cut(covered(slim))
    joined = _joined(_joined(plain, lost, id_, "lost"), runs, id_, "run")
    numbers = lambda spans: F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    whole = F.filter(chunks(F.col(text), chunk), lambda part, i: F.col("places").isNull() | ~F.array_contains("places", i))
    kept = numbers(F.transform(whole, lambda p: F.struct(p["start"].alias("start"), p["n_lines"].alias("n"))))
    left = F.array_except(kept, F.when(F.col("runs").isNull(), F.array().cast("array<int>")).otherwise(numbers(F.col("runs"))))
    # one-element array, so that the text is split once
    taken = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return _written(joined, docs, text, F.col("places").isNull() & F.col("runs").isNull(), F.get(taken, 0))


def report(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, text without repeated chunks, n_chars_before, n_chars_after."""
    slim = docs.select("doc_id", F.col("text"), F.length("text").alias("before"))
    return dedup(slim, chunk).select(
        "doc_id", "text", F.col("before").cast("long").alias("n_chars_before"), F.length("text").cast("long").alias("n_chars_after")
    )


SQL = f"""
WITH lined AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), hashed AS (
  SELECT *, list_transform(lines, lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT)) AS hs,
      list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ \t]+')) > {LONG}) AS long FROM lined
), ended AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR long[i] OR long[i + 1]
      OR (i > 1 AND (hs[i - 1] * {_MULTIPLIER} + hs[i]) % 1000003 % {CHUNK} = 0)) AS ends FROM hashed
), cut_up AS (
  SELECT doc_id, text, md5(text) AS body, list_transform(range(1, len(ends) + 1), lambda k: {{'place': k,
      'passage': ends[k] - (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) > 1 OR long[ends[k]],
      't': array_to_string(lines[(CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END) : ends[k]], chr(10))}}) AS parts FROM ended
), flat AS (
  SELECT doc_id, body, unnest(parts) AS p FROM cut_up
), large AS (
  SELECT doc_id, body, p.place AS place, p.t AS t FROM flat WHERE p.passage
), repeated AS (
  SELECT t, min(doc_id) AS keeper FROM large GROUP BY t HAVING count(*) > 1
), firsts AS (
  SELECT l.t, min(row(l.body, l.place)) AS place FROM large l JOIN repeated r ON l.t = r.t AND l.doc_id = r.keeper GROUP BY l.t
), lost AS (
  SELECT l.doc_id, l.body, list(l.place) AS places FROM large l JOIN repeated r ON l.t = r.t JOIN firsts f ON f.t = l.t
  WHERE NOT (l.doc_id = r.keeper AND row(l.body, l.place) = f.place) GROUP BY l.doc_id, l.body
), done AS (
  SELECT c.doc_id, c.text AS whole, CASE WHEN o.places IS NULL THEN c.text
      ELSE array_to_string(list_transform(list_filter(c.parts, lambda p: NOT list_contains(o.places, p.place)), lambda p: p.t), chr(10)) END AS text
  FROM cut_up c LEFT JOIN lost o ON c.doc_id = o.doc_id AND c.body = o.body
)
SELECT doc_id, text, length(whole) AS n_chars_before, length(text) AS n_chars_after FROM done
"""
