"""SimHash near-duplicates: a grid join over segment popcounts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints, so a pair within d bits is
within d there too; cut into d + 3 coordinate groups, at least three groups then agree exactly.
Each combination of three groups is a grid cell; pairs of a cell are verified on the fingerprints.

Only distinct fingerprints are joined: copies cost nothing. In a cell with more than ``crowded``
fingerprints no pairs are made: there, each fingerprint also emits the fingerprints one bit off.
All that share such a value are within two bits of each other, and it has at most 65 of them, so
each is tied to the least; that finds exactly the same components. (This needs a bound of two
bits, which the constructor checks.)

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other;
repeated rows and equal texts share a fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, kind_of, released, stored, table, utf8
from .components import components

BITS, SHINGLE, SEED = 2, 3, 42
#: Bit ranges of the coordinate groups: whole two-bit segments.
GROUPS = ((0, 14), (14, 28), (28, 40), (40, 52), (52, 64))
_ODD = 0x5555555555555555

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the word shingles of a UTF-8 text; zero without words."""
    words = text.lower().split()  # bytes: A-Z only, and split at \\x20 and \\x09-\\x0d only
    if not words:
        return 0
    if len(words) < shingle:
        return int(np.uint64(_hash(b" ".join(words))).astype(np.int64))
    n = len(words) - shingle + 1
    return majority(np.fromiter(map(_hash, map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of shingle hashes: the bits set in over half of them; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp bigint) for every row; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["key", "fp"])

    batches_of(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = kind_of(rows, "key")
    return rows.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _embedded(fp: str) -> "F.Column":
    """The 32 segment popcounts, each in its own two bits."""
    low, high = F.col(fp).bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def near_pairs(fps: DataFrame, bits: int = BITS, crowded: int = 128, held: list[str] | None = None) -> DataFrame:
    """fps(fp), distinct -> links (a, b) whose components are those of all pairs within ``bits``."""
    if bits not in (0, 1, 2):
        raise ValueError("the grid is laid out for at most two bits")
    masks = []
    for some in combinations(GROUPS, 3):
        masks.append(_signed(sum((1 << hi) - (1 << lo) for lo, hi in some)))
    cells = F.array(*(F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)))
    placed = stored(fps.select("fp", _embedded("fp").alias("e")).select("fp", F.inline(cells)), "cells", held)
    sizes = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sized = placed.join(sizes, ["grid", "cell"])
    few = sized.where(f"n <= {crowded}").select("grid", "cell", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["grid", "cell"])
        .where(F.col("a") < F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        .select("a", "b")
    )
    if bits < 2:  # one bit off is then too far, so ties are to the fingerprint itself
        flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64))) if bits else F.array("fp")
        near = sized.where(f"n > {crowded}").select("fp").distinct().select(F.col("fp").alias("a"), F.explode(flips).alias("b"))
        return pairs.union(near.join(fps.select(F.col("fp").alias("b")), "b").select("a", "b")).distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    around = sized.where(f"n > {crowded}").select("fp").distinct().select("fp", F.explode(flips).alias("at"))
    least = around.groupBy("at").agg(F.min("fp").alias("m"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = least.select(F.col("m").alias("b"), F.explode("fps").alias("a")).where("a != b").select("a", "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component): component is the least key that links of at most ``bits`` bits reach.

    Rows with a null key take part and get a component too, which is null only if no row of it has
    a key.
    """
    held: list[str] = []
    marked = stored(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "key"), "fingerprints", held)
    fps = stored(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct", held)
    roots = components(near_pairs(fps.select("fp"), bits, held=held), held=held).withColumnRenamed("node", "fp")
    classed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classed.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = classed.join(ids, "root").select("fp", "component")
    found = stored(marked.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component"), "classes")
    released(docs.sparkSession, held)
    return found


def op5_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
