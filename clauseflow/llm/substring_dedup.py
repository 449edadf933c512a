"""Substring dedup: word windows that an earlier document holds, by suffix automata.

The reference is the corpus itself, so a broadcast automaton of it would grow with the data.
Instead the reference is cut into shards by content: phrases that share a rolling-hash trigger
(see ``repeats``) meet in one shard of bounded size, which holds every place where their windows
can recur. Each task builds the automaton of its shard's distinct phrases and streams the phrases
through it for matching statistics; each state knows the least document that reaches it.

Defined cases: null and blank texts have no words; texts of fewer than ``window`` words keep all;
of equal documents the one with the least key keeps its words; windows are judged on the input;
rows with a null key keep their words and are no reference. Keys should be unique; rows that share
one share the places removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, batches_of, kind_of, released, stored, table, utf8
from .repeats import merged, repeated

WINDOW, GRAM, SHARD_WORDS = 50, 16, 1 << 17


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Known()


def word_units(text: bytes) -> np.ndarray:
    words = text.split()  # bytes split at \\x20 and \\x09-\\x0d only
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def word_pieces(text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[lo:hi]) for lo, hi in ranges]


class Automaton:
    """Suffix automaton of several token sequences, added in order of their documents, so that the
    document that makes a state is the least one that reaches it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, moves: dict, link: int, least) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, p: int, token, q: int) -> int:
        """A state for what p and the token spell, taken out of q, which also stands for more."""
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.least[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def add(self, tokens: list, least) -> None:
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0, least), last
            while p != -1 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
            last = new

    def stream(self, tokens: list, most: int) -> Iterator[tuple[int, object]]:
        """After each token, the length of the longest match that ends there, up to ``most``, and
        the least document that holds it."""
        at = size = 0
        for token in tokens:
            while at and token not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if token in self.next[at]:
                at, size = self.next[at][token], size + 1
            else:
                size = 0
            while at and self.length[self.link[at]] >= most:
                at = self.link[at]
            size = min(size, most)
            yield size, self.least[at]


def compare(rows: list[dict], window: int = WINDOW) -> list[list[tuple[int, int, int, object]]]:
    """For each phrase, the runs of its windows with the least document that holds each."""
    ids: dict[bytes, int] = {}
    tokens = [[ids.setdefault(w, len(ids)) for w in r["content"].split()] for r in rows]
    automaton = Automaton()
    for i in sorted(range(len(rows)), key=lambda i: rows[i]["least"]):
        automaton.add(tokens[i], rows[i]["least"])
    out = []
    for row, held in zip(rows, tokens, strict=True):
        found: list[list] = []
        for end, (size, least) in enumerate(automaton.stream(held, window)):
            if size < window or (least == row["least"] and row["copies"] < 2):
                continue
            at = end - window + 1
            if found and found[-1][1] == at - 1 and found[-1][3] == least:
                found[-1][1] = at
            else:
                found.append([at, at, 2, least])
        out.append([tuple(f) for f in found])
    return out


def earlier_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, spans): each document's word ranges that windows of earlier documents cover."""
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    held: list[str] = []
    found = repeated(rows, word_units, word_pieces, lambda shard: compare(shard, window), min(GRAM, 1 << max(0, (window // 2).bit_length() - 1)), window, held, rows=1024)
    span = F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + window).alias("hi"))
    spans = stored(found.where("least < key").groupBy("key").agg(F.collect_list(span).alias("spans")), "spans")
    released(docs.sparkSession, held)
    return spans


def reference_spans(docs: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, spans) as ``earlier_spans`` has them, for windows that stand in a table of references
    with the same columns, under a lesser key.

    The references are read in shards of ``shard_words`` words, in order of their keys' hashes; a
    longer reference is cut into parts that overlap by a window. Each shard becomes one suffix
    automaton, which is broadcast, and all documents are streamed through it for matching
    statistics; its spans are stored before the next shard is read. So driver and tasks hold one
    shard at a time. The work is documents times shards: this is for references that are few beside
    the documents. ``earlier_spans`` routes shards instead, where the corpus is its own reference.
    """
    spark, kind = docs.sparkSession, kind_of(docs, key)
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text")).where("key IS NOT NULL")
    held: list[str] = []
    found: list[DataFrame] = []
    for shard in _shards(reference.select(F.col(key).alias("key"), utf8(text).alias("text")).where("key IS NOT NULL"), window, shard_words):
        automaton = Automaton()
        for least, words in sorted(shard, key=lambda r: r[0]):
            automaton.add(words, least)
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                at, los, his = [], [], []
                for i, (k, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    ends = [end for end, (size, least) in enumerate(known.stream(raw.split(), window), 1) if size == window and least < k]
                    for lo, hi in merged([(end - window, end) for end in ends]):
                        at.append(i)
                        los.append(lo)
                        his.append(hi)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(los, pa.int32()), pa.array(his, pa.int32())], names=["key", "lo", "hi"])

        batches_of(spark)
        found.append(stored(rows.mapInArrow(run, f"key {kind}, lo int, hi int"), "shard", held))
        shared.destroy()
    every = spark.createDataFrame([], f"key {kind}, lo int, hi int")
    for part in found:
        every = every.union(part)
    spans = stored(every.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    released(spark, held)
    return spans


def _shards(reference: DataFrame, window: int, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """References in shards of about ``most`` words; rows come to the driver shard by shard."""
    parts = reference.select("key", F.size(F.split(F.decode("text", "UTF-8"), "[ \t\n\x0b\f\r]+")).alias("n"), "text")
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = -(-total // most)
    for i in range(count):
        shard: list[tuple[object, list[bytes]]] = []
        for key, _, raw in parts.where(F.pmod(F.xxhash64("key"), F.lit(count)) == i).toLocalIterator():
            words = bytes(raw).split()
            for at in range(0, max(1, len(words) - window + 1), most):
                shard.append((key, words[at : at + most + window - 1]))
                if sum(len(w) for _, w in shard) >= 2 * most:
                    yield shard
                    shard = []
        if shard:
            yield shard


def without_words(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept binary: the words left, joined by one space, n_words, n_removed) for every row."""
    kind = kind_of(docs, key)
    rows = attached(docs.select(F.col(key).alias("key"), utf8(text).alias("text")), "key", spans, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for raw, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = raw.split()
                n = len(words)
                for lo, hi in reversed(merged([(s["lo"], s["hi"]) for s in held or []])):
                    del words[lo:hi]
                kept.append(b" ".join(words))
                counts.append((n, n - len(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(2))], names=["key", "kept", "n_words", "n_removed"])

    batches_of(docs.sparkSession)
    out = rows.select("key", "text", "spans").mapInArrow(run, f"key {kind}, kept binary, n_words bigint, n_removed bigint")
    return out.withColumnRenamed("key", key)


def op4_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = without_words(docs, earlier_spans(docs))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# Windows by their digests; runs of covered words from windows that touch.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
windows AS (
  SELECT doc_id, j, md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING), ' ')) AS h,
    count(*) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n FROM words
), whole AS (SELECT doc_id, j, h FROM windows WHERE n = {WINDOW}),
firsts AS (SELECT h, min(doc_id) AS least FROM whole GROUP BY h),
hits AS (SELECT doc_id, j, j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS gap FROM whole JOIN firsts USING (h) WHERE least < doc_id),
runs AS (
  SELECT doc_id, min(j) AS lo, max(j) + {WINDOW} AS hi FROM (SELECT *, count(*) FILTER (gap IS NULL OR gap > {WINDOW}) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM hits) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.j >= r.lo AND w.j < r.hi) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce((SELECT sum(hi - lo) FROM runs r WHERE r.doc_id = d.doc_id), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
