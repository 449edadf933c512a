"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line (by document id, then line number) is equal or within one character
edit. Judged on the input: a line that goes still counts as earlier for others.

Two lines within one edit share a hashed key: with one character deleted, or as it is, each emits
the pair (hash before the place, hash after it). All lines that share such a pair are within one
edit of each other, so the least line of a key is every member's earlier partner and no pairs are
made, however many lines share a key. The edit distance of a line and that partner is verified on
the lines themselves.

Few lines need variants. An edit spares the first or the last half of a line, so lines that share
neither half with another line of fitting length emit nothing, and the others only at places in the
half that may differ. That test is exact as well: lines of length c and c - 1 meet under c.

Defined cases: null is no line and stays null; blank lines always stay; exact copies go whatever their
length, and lines one edit apart from ``least`` characters on (in shorter ones an edit makes another
word); very long lines cost in proportion to their length; an empty table gives an empty result; texts
split at line feeds only; rows with a null key stay as they are and are not
earlier than any; keys should be unique, and rows that share one share the line numbers removed.
A document that loses nothing keeps its very text. Columns of the names that ``without_lines`` adds
are replaced by its own, all others are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attached, column, released, sift, spare, stored, table, without

LEAST, GRID = 20, 128
SOLID = r"[^\x09-\x0d\x20]"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, line) of every line that is not blank."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    return rows.where(F.col("line").rlike(SOLID))


def _halves(line: str, longer: "F.Column") -> list["F.Column"]:
    """Hashes of the first and the last half, for partners such that the longer has ``longer``."""
    half = F.floor((longer - 1) / 2).cast("int")
    first, last = F.substring(line, F.lit(1), half), F.substring(line, F.char_length(line) - half + 1, half)
    return [F.xxhash64(F.lit("p"), longer, first), F.xxhash64(F.lit("s"), longer, last)]


def _hashes(line: str) -> list["F.Column"]:
    """Two 64-bit hashes that tell lines apart, so that no text is shuffled."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), F.reverse(line)).alias("h2")]


def _distinct(lines: DataFrame) -> DataFrame:
    """A row for each distinct line: where it first stands, how often, and its half hashes."""
    n = F.char_length("line")
    halves = dict(zip(("p0", "s0", "p1", "s1"), _halves("line", n) + _halves("line", n + 1), strict=True))
    keyed = lines.select("key", "no", *_hashes("line"), n.alias("n"), *(h.alias(k) for k, h in halves.items()))
    return keyed.groupBy("h1", "h2").agg(F.min(F.struct("key", "no")).alias("at"), F.count("*").alias("times"), *(F.first(k).alias(k) for k in ("n", *halves)))


def _places(distinct: DataFrame) -> DataFrame:
    """(at, n, lo, hi, deleted): for lines with a fitting partner, where variants are needed."""
    # slots 0 and 1 are the halves under the line's own length, 2 and 3 those under one more
    halves = distinct.select("at", "n", F.posexplode(F.array("p0", "s0", "p1", "s1")).alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("lines"), F.count_if(F.col("slot") < 2).alias("long"))
    met = halves.join(shared.where("lines > 1 AND long > 0").select("half"), "half", "left_semi")
    met = met.withColumn("c", F.when(F.col("slot") < 2, F.col("n")).otherwise(F.col("n") + 1)).withColumn("first", F.col("slot") % 2 == 0)
    half = F.floor((F.col("c") - 1) / 2).cast("int")
    return met.select(
        "at",
        "n",
        F.when(F.col("first"), half).otherwise(0).alias("lo"),
        F.when(F.col("first"), F.col("n")).otherwise(F.col("n") - half).alias("hi"),
        (F.col("n") == F.col("c")).alias("deleted"),
    ).distinct()


def _variants(wanted: DataFrame) -> DataFrame:
    """wanted(at, n, line, lo, hi, deleted) -> (before, after, at, p, behind): the place and the number
    of characters behind it.

    A line is cut into blocks of GRID characters, once from its start and once from its end. What
    stands before a place is whole blocks from the start and a part of the next one, what stands
    behind it whole blocks from the end and a part of the next one. Whole blocks are hashed with
    their numbers and summed up by a running exclusive or, so a place costs 2 * GRID characters at
    the most, however long its line is, and no row holds more than three blocks.
    """
    g, own = GRID, ["at", "n", "lo", "hi", "deleted"]
    cut = lambda text: F.concat(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{g}}}"), F.lit(0)), F.array(F.lit("")))
    last = F.floor(F.col("n") / g).cast("int")
    # a generator's columns are computed once, not anew for each block below
    blocks = wanted.select(*own, last.alias("k"), F.inline(F.array(F.struct(cut("line").alias("f"), cut(F.reverse("line")).alias("b")))))
    # behind a place of block c from the start lie block k - c or k - c - 1 from the end
    each = F.transform(F.sequence(F.lit(0), F.col("k")), lambda c: F.struct(c.alias("c"), F.get("f", c).alias("f"), F.get("b", F.col("k") - c).alias("b1"), F.get("b", F.col("k") - c - 1).alias("b0")))
    rows = blocks.select(*own, "k", F.inline(each))
    there = F.xxhash64(F.col("k") - F.col("c"), "b1")
    whole = Window.partitionBy(*own)
    upto = whole.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.bit_xor(F.xxhash64("c", "f")).over(upto).bitwiseXOR(F.xxhash64("c", "f")).alias("head"),
        F.bit_xor(there).over(whole).bitwiseXOR(F.bit_xor(there).over(upto)).alias("tail1"),
    )
    rows = rows.withColumn("tail0", F.col("tail1").bitwiseXOR(F.xxhash64(F.col("k") - F.col("c") - 1, "b0")))
    base, skip = F.col("c") * g, F.when(F.col("deleted"), 1).otherwise(0)
    low, high = F.greatest("lo", base), F.least(F.col("hi") - skip, base + g - 1)
    placed = rows.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("p"))
    behind = F.col("n") - F.col("p") - skip
    outer = behind >= (F.col("k") - F.col("c")) * g
    return placed.select(
        "at",
        F.xxhash64("head", F.substring("f", F.lit(1), F.col("p") - base)).alias("before"),
        F.xxhash64(F.when(outer, F.col("tail1")).otherwise(F.col("tail0")), F.substring(F.when(outer, F.col("b1")).otherwise(F.col("b0")), F.lit(1), behind % g)).alias("after"),
        F.struct(F.col("p"), behind.alias("behind"), skip.alias("skip")).alias("place"),
    )


def near_lines(docs: DataFrame, distinct: DataFrame, key: str, text: str, held: list[str]) -> DataFrame:
    """(at, partner): distinct lines, by their first place, with an earlier line one edit away.

    ``held`` gets the tables that the result reads."""
    places = stored(_places(distinct), "places", held)
    wanted = places.select("at").distinct().select(F.col("at.key").alias("key"), "at")
    by_doc = wanted.groupBy("key").agg(F.collect_list("at").alias("ats"))
    by_doc = stored(by_doc, "places-by-doc", held)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = sift(rows, "key", by_doc, "key").join(by_doc, "key")
    texts = texts.select(F.split("text", "\n", -1).alias("lines"), F.explode("ats").alias("at"))
    texts = stored(texts.select("at", F.get("lines", F.col("at.no")).alias("line")).where("line IS NOT NULL").distinct(), "candidates", held)
    emitted = _variants(places.join(texts, "at"))
    least = emitted.groupBy("before", "after").agg(F.min("at").alias("partner"), F.max("at").alias("most")).where("partner < most")
    met = emitted.join(least.drop("most"), ["before", "after"]).where("partner < at")
    pairs = met.groupBy("at", "partner").agg(F.min("place").alias("place"))
    lines = pairs.join(texts, "at").join(texts.select(F.col("at").alias("partner"), F.col("line").alias("other")), "partner")
    return lines.where(_within_one("line", "other")).groupBy("at").agg(F.min("partner").alias("partner"))


def _within_one(line: str, other: str) -> "F.Column":
    """Whether the lines are the same before and behind the place, and what is between them is one
    edit at the most. The edit distance is taken of the middles only, as it takes the square of a
    line's length in Spark."""
    p, m = F.col("place.p"), F.col("place.behind")
    before = F.substring(line, F.lit(1), p) == F.substring(other, F.lit(1), p)
    after = F.substring(line, F.char_length(line) - m + 1, m) == F.substring(other, F.char_length(other) - m + 1, m)
    middle = [F.substring(t, p + 1, F.greatest(F.char_length(t) - p - m, F.lit(0))) for t in (line, other)]
    fits = F.greatest(F.char_length(line), F.char_length(other)) - p - m
    return before & after & fits.between(0, 1) & (F.levenshtein(*middle) <= 1)


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, removed array<int>): the numbers, from 0, of the lines that go; others have no row. Lines
    under ``least`` characters are not compared for edits.
    """
    lines = lines_of(docs, key, text)
    held: list[str] = []
    distinct = stored(_distinct(lines), "lines", held)
    again = distinct.where("times > 1").select("h1", "h2", "at")
    spots = lines.select("key", "no", *_hashes("line"))
    copies = spots.join(again, ["h1", "h2"]).where(F.struct("key", "no") > F.col("at")).select("key", "no")
    near = near_lines(docs, distinct.where(F.col("n") >= least), key, text, held).select("at.key", "at.no")
    removed = stored(copies.union(near).groupBy("key").agg(F.collect_set("no").alias("removed")), "removed")
    released(docs.sparkSession, held)
    return removed


def cut_lines(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = None, gone: str | None = None) -> DataFrame:
    """docs with the lines taken out of ``text``, all columns in their places; ``size`` and ``gone``
    name columns (bigint) for the number of lines and of removed ones, if they are wanted."""
    mark, numbers = spare(docs, "mark", "numbers")
    joined = attached(docs, key, removed.select(F.col("key").alias(mark), F.col("removed").alias(numbers)), mark)
    lines = F.split(column(text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    whole = F.col(numbers).isNull()
    out = [F.when(whole, column(text)).otherwise(kept).alias(text) if c == text else column(c) for c in docs.columns]
    if size:
        out.append(F.when(column(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias(size))
    if gone:
        out.append(F.when(whole, 0).otherwise(F.size(numbers)).cast("bigint").alias(gone))
    return joined.select(*out)


def without_lines(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines taken out of ``text``; adds n_lines and n_removed (both bigint)."""
    return cut_lines(without(docs, "n_lines", "n_removed"), removed, key, text, "n_lines", "n_removed")


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = without_lines(docs, removed_lines(docs))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# Lines are compared by their halves first, as pairs within one edit share one; then exactly: of
# equal length with one differing character, or equal but for one more character in the longer.
OP2_SQL = f"""
WITH spots AS (
  SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), lines AS (SELECT * FROM spots WHERE regexp_matches(line, '{SOLID}')),
firsts AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS spot FROM lines GROUP BY line
), long AS (SELECT * FROM firsts WHERE n >= {LEAST}), halves AS (
  SELECT line, n, spot, c, 'p' AS kind, left(line, (c - 1) // 2) AS half FROM long, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT n + k AS c)
  UNION ALL
  SELECT line, n, spot, c, 's', right(line, (c - 1) // 2) FROM long, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT n + k AS c)
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.spot AS a_at, a.n AS an, b.n AS bn
  FROM halves a JOIN halves b ON a.c = b.c AND a.kind = b.kind AND a.half = b.half AND b.spot < a.spot
), split AS (
  SELECT a_at, an, bn, string_split(CASE WHEN an >= bn THEN a ELSE b END, '') AS x, string_split(CASE WHEN an >= bn THEN b ELSE a END, '') AS y FROM pairs
), placed AS (
  SELECT a_at, an, bn, x, y, coalesce(list_position(list_transform(range(1, len(y) + 1), lambda i: x[i] <> y[i]), true), len(y) + 1) AS p FROM split
), near AS (
  SELECT DISTINCT a_at FROM placed
  WHERE CASE WHEN an = bn THEN x[p + 1:] = y[p + 1:] ELSE x[p + 1:] = y[p:] END
), gone AS (
  SELECT l.doc_id, l.no FROM lines l JOIN firsts f ON l.line = f.line
  WHERE (l.doc_id, l.no) > f.spot OR f.spot IN (SELECT a_at FROM near)
)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed,
  sha256(coalesce((SELECT string_agg(s.line, chr(10) ORDER BY s.no) FROM spots s
    WHERE s.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.no = s.no)), '')) AS kept_sha256
FROM documents d
"""
