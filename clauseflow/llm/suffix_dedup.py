"""Suffix-array dedup by prefix-free parsing: repeated byte strings, wherever they stand.

Rolling-hash triggers cut each text into overlapping phrases (see ``repeats``). Because equal
strings lie in phrases of one trigger at one distance, the corpus order of suffixes, as far as
``length`` bytes, is the order within each trigger: the suffix array of the dictionary's phrases
gives the order of the strings and the parse gives how often each phrase, hence string, occurs.

Defined cases: null is empty; texts shorter than ``length`` keep everything; equal documents lose
all that repeats, in every copy (strings are judged on the input); rows with a null key neither
lose bytes nor count as places. Keys should be unique; rows that share one share removed places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, batches_of, kind_of, released, stored, table, utf8
from .repeats import merged, repeated

LENGTH, GRAM = 400, 64


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64)


def byte_pieces(text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    return [text[lo:hi] for lo, hi in ranges]


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among all by its first ``depth`` bytes, by prefix doubling.

    Equal ranks mean equal strings; the order is that of the suffix array. The last ``depth``
    ranks see zeros past the end.
    """
    n = len(text)
    size = min(8, depth)
    ranks = np.zeros(n, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(size, np.uint64)])
    for i in range(size):
        ranks = ranks << np.uint64(8) | padded[i : i + n]
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.uint64)
    while size < depth:
        step = min(size, depth - size)
        right = np.zeros(n, np.uint64)
        right[: n - step] = ranks[step:] + np.uint64(1)
        ranks = np.unique(ranks << np.uint64(32) | right, return_inverse=True)[1].astype(np.uint64)
        size += step
    return ranks.astype(np.int64)


def compare(rows: list[dict], length: int = LENGTH) -> list[list[tuple[int, int, int, int]]]:
    """Windows of the phrases that start twice or more in all: one suffix array for the shard.

    Byte strings of different triggers differ (or have equal ranks and are truly equal), so
    triggers need no separation.
    """
    text = np.frombuffer(b"".join(r["content"] for r in rows), np.uint8)
    sizes = np.array([len(r["content"]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    counts = np.array([r["windows"] for r in rows])
    ranks = suffix_ranks(text, length)
    row = np.repeat(np.arange(len(rows)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = np.unique(ranks[starts[row] + at], return_inverse=True)[1]
    copies = np.bincount(rank, weights=np.array([r["copies"] for r in rows])[row]).astype(np.int64)[rank]
    twice = copies > 1
    edge = np.diff(np.concatenate([[0], (twice).astype(np.int8), [0]]))
    inner = np.flatnonzero((row[1:] != row[:-1]) & twice[1:] & twice[:-1]) + 1
    lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
    hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in rows]
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out[row[a]].append((int(at[a]), int(at[b - 1]), 2, rows[row[a]]["least"]))
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, spans): each document's byte ranges that repeated strings cover; others have no row."""
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    held: list[str] = []
    found = repeated(rows, byte_units, byte_pieces, lambda shard: compare(shard, length), min(GRAM, 1 << (length // 2).bit_length() - 1), length, held)
    span = F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + length).alias("hi"))
    spans = stored(found.groupBy("key").agg(F.collect_list(span).alias("spans")), "spans")
    released(docs.sparkSession, held)
    return spans


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) for every row of docs."""
    kind = kind_of(docs, key)
    rows = attached(docs.select(F.col(key).alias("key"), utf8(text).alias("text")), "key", spans, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for raw, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = merged([(s["lo"], min(s["hi"], len(raw))) for s in held or [] if s["lo"] < len(raw)])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                counts.append((len(raw), len(raw) - len(kept[-1]), len(runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], names=["key", "kept", "n_bytes", "n_removed", "n_spans"])

    batches_of(docs.sparkSession)
    out = rows.select("key", "text", "spans").mapInArrow(run, f"key {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    return out.withColumnRenamed("key", key)


def op9_suffix_array_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = without_spans(docs, repeated_spans(docs))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as hex digits, strings by their digests; long texts are cut into parts that overlap by a string.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), s AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
parts AS (SELECT doc_id, n, unnest(range(0, greatest(n - {LENGTH - 1}, 0), 2048)) AS p, x FROM s),
cut AS (SELECT doc_id, p, least(2048, n - {LENGTH - 1} - p) AS m, substr(x, 2 * p + 1, 2 * (2048 + {LENGTH - 1})) AS part FROM parts),
strings AS (SELECT doc_id, p + k AS i, md5(substr(part, 2 * k + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, p, part, unnest(range(0, m)) AS k FROM cut)),
again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM strings SEMI JOIN again USING (h)),
runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM (SELECT *, count(*) FILTER (gap IS NULL OR gap > {LENGTH}) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits) GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS b FROM runs UNION ALL SELECT doc_id, 0, min(lo) FROM runs GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM edges JOIN s ON edges.doc_id = s.doc_id GROUP BY s.doc_id
), sums AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT s.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM s LEFT JOIN sums ON s.doc_id = sums.doc_id LEFT JOIN kept ON s.doc_id = kept.doc_id
"""
