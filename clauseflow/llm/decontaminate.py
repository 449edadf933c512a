"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space collapsed. An item of m characters may differ
by e = m // ``per`` edits. Cut into e + 1 pieces, at least one stands unchanged in any text within
e edits, so all pieces of all items are searched at once (Aho-Corasick) and each hit names the
stretch of text where its item can lie. Stretches of one item merge, and Myers' bit-parallel
algorithm gives the least edit distance of the item to any substring there.

The items are the small side: they are read in blocks of ``BLOCK`` characters at most (one pass
over the documents each), so what goes to every task has a bound however many items there are.

Defined cases: null, empty and blank texts and items match nothing; items under ``least`` characters
after normalising are searched without edits, as whole words; other columns, whatever their names,
are left alone; an empty table of either kind gives no matches; repeated items and repeated rows each get rows of their own; very
long texts are searched whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, batches_of, column, kind_of, lacking, stored, table

PER, LEAST, BLOCK = 12, 24, 1 << 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, per: int = PER) -> int:
    return len(item) // per


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item: distances of its best match that ends at each character."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance to a substring of text, and where its first such match ends."""
        every, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = every, 0, self.size
        least, end = score, 0
        find = self.masks.get
        for at, c in enumerate(text, 1):
            equal = find(c, 0)
            vertical = equal | minus
            carried = ((equal & plus) + plus ^ plus) | equal
            up = minus | every & ~(carried | plus)
            down = plus & carried
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, end = score, at
            up = up << 1 & every  # a match may start anywhere, so no one comes in below
            down = down << 1 & every
            plus = down | every & ~(vertical | up)
            minus = up & vertical
        return least, end


class Searcher:
    """All items of a block: one automaton of their pieces, and a pattern for each item."""

    def __init__(self, items: list[tuple[object, str]], per: int, least: int = LEAST) -> None:
        self.items = [(key, item, budget(item, per) if len(item) >= least else 0, Pattern(item)) for key, item in items]
        self.least = least
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item, edits, _) in enumerate(self.items):
            for at, piece in pieces(item, edits):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item key, edits, end) of every item that stands in the normalised text."""
        spans: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, at in places:
                _, item, edits, _ = self.items[i]
                if len(item) < self.least and not _whole(text, end + 1 - size, end + 1):
                    continue
                lo = max(0, end + 1 - size - at - edits)
                hi = min(len(text), end + 1 - size - at + len(item) + edits)
                held = spans.setdefault(i, [])
                if held and lo <= held[-1][1] and held[-1][0] <= hi:
                    held[-1] = [min(lo, held[-1][0]), max(hi, held[-1][1])]
                else:
                    held.append([lo, hi])
        out = []
        for i, held in spans.items():
            key, _, edits, pattern = self.items[i]
            found = [(d, lo + end) for lo, hi in held for d, end in [pattern.best(text[lo:hi])] if d <= edits]
            if found:
                out.append((key, *min(found)))
        return out


def _whole(text: str, lo: int, hi: int) -> bool:
    """Whether no letter or digit stands before or behind text[lo:hi]."""
    return not (text[lo - 1 : lo].isalnum() or text[hi : hi + 1].isalnum())


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[int, list[tuple[object, str]]]]:
    """The number of blocks, and the normalised items of each block, of bounded size."""
    rows = items.select(column(key).alias("key"), column(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // BLOCK) or 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i)
        yield n, [(r[0], normal(r[1])) for r in part.collect()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", per: int = PER, least: int = LEAST) -> DataFrame:
    """(key, item_key, edits, end): a row for each document and item within its error budget.

    ``end`` is where the first best match ends in the normalised text. A narrow map.
    """
    kind, item_kind, item_type = kind_of(docs, key), kind_of(items, item_key), arrow_type(items, item_key)
    rows = docs.where(column(text).isNotNull()).select(column(key).alias("key"), column(text).alias("text"))
    batches_of(docs.sparkSession)
    made = []
    for blocks, block in _blocks(items, item_key, item_text):
        held = [(k, item) for k, item in block if item]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(held, per, least) if held else None
            for batch in batches:
                row, found = [], []
                for i, raw in enumerate(batch.column(1).to_pylist() if searcher else []):
                    hits = searcher.search(normal(raw))
                    found += hits
                    row += [i] * len(hits)
                columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((item_type, pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=["key", "item", "edits", "end"])

        found = rows.mapInArrow(run, f"key {kind}, item {item_kind}, edits int, end int")
        made.append(found if blocks == 1 else stored(found, "matches"))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out.toDF(key, item_key, "edits", "end")


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no item stands; rows without a key stay."""
    leaks = stored(matches(docs, items, key, text, **options).select(column(key).alias("key")).distinct(), "leaks")
    return lacking(docs, key, leaks, "key")


def op10_benchmark_decontamination(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
