"""Where quotes stand in texts: an index join first, the exact search on the few pairs left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, locate, pinned

#: Characters of a quote's head, without white space; characters of a text that are cut at a time.
HEAD, PART = 24, 256
#: Quotes that are looked for beside one reading of a text; as many heads are looked for one by one.
GATHERED, FEW = 1024, 64
#: Bytes of a head's beginning that a text is searched for, by numpy; as many different ones are sent to
#: the tasks, more are joined.
BEGINNINGS, SENT = (1, 2, 4, 8, 16, 24), 65_536


def _bare(text: str) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def _heads(bare: str, size: int | Column) -> Column:
    """Hashes of all stretches of ``size`` characters. Characters are cut out of short parts, as finding
    one in a long text means walking there."""
    size = F.lit(size) if isinstance(size, int) else size
    parts = F.regexp_extract_all(bare, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    ahead = F.transform(F.arrays_zip(parts.alias("x"), F.slice(parts, 2, 1 << 30).alias("y")), lambda p: F.concat(p["x"], F.coalesce(p["y"].substr(F.lit(1), size - 1), F.lit(""))))
    cut = F.transform(ahead, lambda part: F.transform(F.sequence(F.lit(1), F.lit(PART)), lambda i: F.xxhash64(part.substr(i, size))))
    return F.array_distinct(F.flatten(cut))


def _windows(data: bytes) -> dict[int, np.ndarray]:
    """Hashes of all windows of BEGINNINGS bytes, each size from smaller ones."""
    hashes = {1: np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)}
    for size, part, factor in ((2, 1, 0x9E3779B97F4A7C15), (4, 2, 0xC2B2AE3D27D4EB4F), (8, 4, 0x165667B19E3779F9), (16, 8, 0xD6E8FEB86659FD93), (24, 8, 0xA0761D6478BD642F)):
        n = max(0, len(data) - size + 1)
        hashes[size] = hashes[size - part][:n] * np.uint64(factor) + hashes[part][size - part :][:n]
    return hashes


def _beginning(head: Column) -> Column:
    """The hash of as many of a head's first bytes as BEGINNINGS has."""

    @F.pandas_udf("bigint")
    def hashed(heads: pd.Series) -> pd.Series:
        def one(head: str) -> int:
            data = head.encode()
            size = max(n for n in BEGINNINGS if n <= len(data))
            return int(_windows(data[:size])[size].view(np.int64)[0])

        return heads.map(one)

    return hashed(head)


def _begun(bare: Column, wanted: list[int], sizes: list[int]) -> Column:
    """Which of the wanted hashes a text's windows have."""
    sought = np.sort(np.array(wanted, np.int64).view(np.uint64))

    @F.pandas_udf("array<bigint>")
    def met(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mixed, shift = np.uint64(0x9FB21C651E98DF25), np.uint64(44)
        likely = np.zeros(1 << 20, bool)
        likely[(sought * mixed) >> shift] = True

        def one(text: str) -> np.ndarray:
            hashes = _windows(text.encode())
            some = [h[likely[(h * mixed) >> shift]] for h in (hashes[n] for n in sizes)]
            found = np.unique(np.concatenate(some)) if some else sought[:0]
            return found[np.isin(found, sought)].view(np.int64)

        for batch in texts:
            yield batch.map(one)

    return met(bare)


def place_quotes(quotes: DataFrame, texts: DataFrame, within: str | None = None) -> DataFrame:
    """quotes(quote_id, quote), texts(text_id, text) -> (quote_id, text_id, start, end): the first place
    of every quote in every text that holds it, exactly or up to white space.

    With ``within``, a column of both, a quote is looked for in texts of its own value only
    (``_placed_within``).

    Without white space, a text that holds a quote holds the quote's head, HEAD characters or as many
    as it has. Up to SENT different beginnings of heads are sent to the tasks, which hash all windows of a
    text of as many bytes; only texts that share one with a quote are joined, by its hash, and searched if
    they hold the quote up to white space. Of more, heads are indexed by size, of which there are HEAD at
    the most; each text's stretches of a size that quotes have are hashed and joined, and texts are joined by
    key after that. A head that very many quotes share meets a text once for each of them, as each is a
    place to find.

    Blank and null quotes and null texts have no place.
    """
    if within:
        return _placed_within(quotes, texts, within)
    bare = _bare("quote")
    begun = quotes.select("quote_id", "quote", bare.alias("whole")).where("whole != ''").withColumn("begin", _beginning(F.substring("whole", 1, HEAD)))
    size = F.octet_length(F.substring("whole", 1, HEAD))
    sent = begun.groupBy("begin").agg(F.collect_set(sum((F.when(size >= n, 1).otherwise(0) for n in BEGINNINGS), F.lit(0))).alias("sizes")).limit(SENT + 1).collect()
    if len(sent) <= SENT:
        sizes = sorted({BEGINNINGS[i - 1] for row in sent for i in row["sizes"]})
        held = pinned(texts.where("text IS NOT NULL").select("text_id", "text"), "bare", _bare("text"))
        met = held.select("*", F.explode(_begun(F.col("bare"), [row["begin"] for row in sent], sizes)).alias("begin"))
        near = met.join(begun, "begin").where(F.contains("bare", "whole"))
        placed = pinned(near, "place", locate(F.col("text"), F.col("quote"))).where("place IS NOT NULL")
        return placed.select("quote_id", "text_id", "place.start", "place.end")
    size = F.least(F.lit(HEAD), F.char_length(bare))
    asked = quotes.select("quote_id", "quote", size.alias("size"), F.xxhash64(F.substring(bare, 1, HEAD)).alias("head")).where("size > 0")
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())  # HEAD at the most
    stripped = pinned(texts.where("text IS NOT NULL"), "bare", _bare("text"))
    stretches = [F.transform(_heads("bare", n), lambda h: F.struct(F.lit(n).alias("size"), h.alias("head"))) for n in sizes]  # noqa: B023 - called at once
    if not stretches:
        stretches = [F.array().cast("array<struct<size:int,head:bigint>>")]
    starts = stripped.select("text_id", F.inline(F.concat(*stretches)))
    wanted = asked.select("size", "head").distinct()
    met = starts.join(wanted, ["size", "head"], "left_semi")
    pairs = met.join(asked, ["size", "head"]).select("text_id", "quote_id", "quote")
    near = pairs.join(texts.select("text_id", "text"), "text_id")
    placed = pinned(near, "place", locate(F.col("text"), F.col("quote"))).where("place IS NOT NULL")
    return placed.select("quote_id", "text_id", "place.start", "place.end")


def _placed_within(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``place_quotes`` for quotes and texts of one ``key``.

    A key's quotes are gathered to arrays of some GATHERED and meet its texts in one join; no stretch of a
    text is a row of its own. A text looks for FEW heads one by one; for more, its stretches are hashed and
    the hashes of both intersected. What stands in a text up to white space is searched for there.
    """
    asked = quotes.select("quote_id", "quote", key, F.substring(_bare("quote"), 1, HEAD).alias("head")).where("head != ''")
    busy = asked.groupBy(F.col(key).alias("__busy")).agg(F.count("*").alias("__n")).where(F.col("__n") > GATHERED)
    dealt = F.pmod(F.xxhash64("quote_id"), F.ceil(F.col("__n") / GATHERED))
    parts = asked.join(busy, F.col(key) == F.col("__busy"), "left").withColumn("__part", F.coalesce(dealt, F.lit(0)))
    lists = parts.groupBy(key, "__part").agg(F.collect_list(F.struct("quote_id", "quote", "head")).alias("asked")).drop("__part")
    met = texts.where("text IS NOT NULL").select("text_id", key, "text").join(lists, key)
    met = pinned(met, "bare", _bare("text"))
    sizes = F.array_distinct(F.transform("asked", lambda q: F.char_length(q["head"])))
    stretches = F.flatten(F.transform(sizes, lambda n: _heads("bare", n)))
    shared = F.array_intersect(stretches, F.transform("asked", lambda q: F.xxhash64(q["head"])))
    met = pinned(met, "shared", F.when(F.size("asked") > FEW, shared))
    near = F.filter("asked", lambda q: F.when(F.col("shared").isNull(), F.contains(F.col("bare"), q["head"])).otherwise(F.array_contains("shared", F.xxhash64(q["head"]))))
    pairs = met.select("text_id", key, "text", "bare", F.explode(near).alias("q")).where(F.contains("bare", _bare("q.quote")))
    placed = pinned(pairs, "place", locate(F.col("text"), F.col("q.quote"))).where("place IS NOT NULL")
    return placed.select("q.quote_id", key, "text_id", "place.start", "place.end")
