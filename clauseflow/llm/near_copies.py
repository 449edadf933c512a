"""Near-duplicates: SimHash and, further off, MinHash bands propose, shingle sets decide.

A text becomes the set of its 64-bit hashed shingles of ``SHINGLE`` words. Equal sets are one node.
Two nodes are linked if the Jaccard similarity of their sets is at least 4/5, which is verified on
the whole sets.

First each set has its SimHash fingerprint, and the grid of ``simhash`` finds those within two bits.
A pair at 0.8 is some 10 of 64 bits apart, and many are further, where no grid of exact groups is
left. So what that leaves in different components is looked for by bands as well. Such candidates
share one of 40 bands of ``ROWS`` minima each: ``MINIMA`` minima are arranged in bands twice, in
different orders. A pair at 0.8 misses all of them with a probability of some
(1 - 0.8^6)^40 = 5e-6, a pair at 0.85 with 6e-9, and a pair at 0.3, like two texts that share a
passage, meets in a band with 3 in 100.

A band that more than ``crowded`` nodes share makes no pairs: its nodes are compared with its least
and its greatest node. What that leaves in different components is dealt anew, by the band and one
of ``SUBS`` groups of five further minima, of which a pair at 0.8 shares one with 96 in 100, for
every band that it shares. So a passage that very many different texts have in common is cut into
groups of texts that have more in common. That is done ``LEVELS`` times at the most; what is crowded
even then is compared pair by pair.

Defined cases: texts without words, null ones too, are copies of each other; a text of fewer words
than a shingle has all its words as its one shingle; rows with a null key take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, kind_of, released, sift, stored, utf8
from .components import components
from .simhash import _hash, majority, near_pairs

SHINGLE, MINIMA, ROWS, FEW, CROWDED = 5, 120, 6, 8, 1024
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)
_ORDER = np.concatenate([np.arange(MINIMA), _RNG.permutation(MINIMA)])
BANDS = len(_ORDER) // ROWS
SUBS, SUB_ROWS, LEVELS = 8, 5, 3
_SUBS = _RNG.permutation(MINIMA)[: SUBS * SUB_ROWS * LEVELS]
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a UTF-8 text; words as in ``simhash``."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(_hash, joined), "<u8"))


def bands(found: np.ndarray) -> np.ndarray:
    """A value for each band, then one for each finer group; none for an empty set."""
    if not found.size:
        return np.empty(0, np.int64)
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, found.size, 1024):
        least = np.minimum(least, np.multiply.outer(found[at : at + 1024], _FACTORS).min(axis=0))
    coarse = (least[_ORDER].reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _SALT
    fine = (least[_SUBS].reshape(-1, SUB_ROWS) * _MIX[:SUB_ROWS]).sum(axis=1, dtype=np.uint64)
    return np.concatenate([coarse, fine]).view(np.int64)


def _nested(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, n, fp, bands, shingles) for every row; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            sizes, fps = pa.array([len(s) for s in found], pa.int32()), pa.array([majority(s) for s in found], pa.int64())
            columns = [batch.column(0), pa.array(nodes), sizes, fps, _nested([bands(s) for s in found]), _nested(found)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "fp", "bands", "shingles"])

    batches_of(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), utf8(text).alias("text"))
    kind = kind_of(rows, "key")
    return rows.mapInArrow(run, f"key {kind}, node bigint, n int, fp bigint, bands array<bigint>, shingles array<bigint>")


def _sized(pairs: DataFrame) -> DataFrame:
    """(a, b) once each, of sizes that a similarity of 0.8 allows."""
    return pairs.where(5 * F.least("an", "bn") >= 4 * F.greatest("an", "bn")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(rows: DataFrame) -> DataFrame:
    """Pairs of different nodes that share a band."""
    one = rows.select("band", F.col("node").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"))
    other = rows.select("band", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"))
    return _sized(one.join(other, "band").where("a < b AND ar != br"))


def _linked(met: DataFrame, known: DataFrame, held: list[str], out: list[str]) -> DataFrame:
    """The links (a, b) among nodes that share a band, without a row for any other pair.

    A pair is compared under the least of the bands in met that both have, and not if links have tied
    its nodes before."""
    own = stored(met.groupBy("node").agg(F.collect_set("band").alias("met")), "own", held)
    sets_of = stored(sift(known, "node", own, "node").join(own, "node").dropDuplicates(["node"]).select("node", "met", "shingles"), "sets", held)
    full = met.select("band", "node", "n", "root").join(sets_of, "node")
    one = full.select("band", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "root", "met", "shingles")))
    other = full.select(F.col("band").alias("band_"), *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "root", "met", "shingles")))
    sized = 5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n")
    first = F.array_min(F.array_intersect("a_met", "b_met")) == F.col("band")
    alike = 9 * F.size(F.array_intersect("a_shingles", "b_shingles")).cast("bigint") >= 4 * (F.col("a_n") + F.col("b_n"))
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
    links = one.join(other, (F.col("band") == F.col("band_")) & apart & sized & first & alike)
    return stored(links.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "links", out)


def _by_fingerprint(nodes: DataFrame, held: list[str]) -> DataFrame:
    """Pairs (a, b) that the SimHash grid proposes: nodes with one fingerprint as pairs with its least
    and greatest node, and of fingerprints that the grid links their least and greatest nodes."""
    ends = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi"))
    ends = stored(ends, "fingerprints", held)
    near = near_pairs(ends.select("fp"), held=held)
    two = ends.select("fp", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("end"))
    one = two.select(F.col("fp").alias("a"), F.col("end").alias("x"))
    other = two.select(F.col("fp").alias("b"), F.col("end").alias("y"))
    crossed = near.join(one, "a").join(other, "b").select("x", "y")
    shared = nodes.join(ends.where("lo.node != hi.node"), "fp")
    alike = shared.select(F.struct("node", "n").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x.node != y.node")
    return _sized(crossed.union(alike).select(F.col("x.node").alias("a"), F.col("x.n").alias("an"), F.col("y.node").alias("b"), F.col("y.n").alias("bn")))


def verified(pairs: DataFrame, known: DataFrame, out: list[str]) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 at least; known(node, n, shingles)."""
    held: list[str] = []
    pairs = stored(pairs, "candidates", held)
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted", held)
    found = stored(sift(known, "node", wanted, "node").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets", held)
    one = found.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("shingles").alias("x"))
    other = found.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("shingles").alias("y"))
    same = F.size(F.array_intersect("x", "y")).cast("bigint")
    links = stored(pairs.join(one, "a").join(other, "b").where(9 * same >= 4 * (F.col("an") + F.col("bn"))).select("a", "b"), "links", out)
    released(pairs.sparkSession, held)
    return links


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(key, component): component is the least key that links reach, null only if none has a key."""
    held: list[str] = []
    marked = stored(sets(docs, key, text), "shingles", held)
    nodes = stored(marked.groupBy("node").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes", held)
    known = marked.select("node", "n", "shingles")
    finer = nodes.select("node", F.slice("bands", BANDS + 1, SUBS * LEVELS).alias("finer"))
    placed = nodes.select("node", "n", F.explode(F.slice("bands", 1, BANDS)).alias("band"))
    links = verified(_by_fingerprint(nodes.select("node", "n", "fp"), held), known, held)
    roots = components(links, held=held).withColumnRenamed("node", "linked")

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node")).drop("linked")

    for level in range(LEVELS + 1):
        shared = placed.groupBy("band").agg(F.count("*").alias("times"), F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("times > 1")
        shared = stored(shared, "shared", held)
        met = stored(rooted(sift(placed, "band", shared, "band").join(shared, "band")), "bands", held)
        last = level == LEVELS
        many = met.where(F.lit(not last) & (F.col("times") > crowded))
        stars = many.select("node", "n", F.explode(F.array("lo", "hi")).alias("end")).where("node != end.node")
        stars = _sized(stars.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("end.node").alias("b"), F.col("end.n").alias("bn")))
        found = verified(_joined(met.where(F.col("times") <= FEW)).union(stars).distinct(), known, held)
        some = _linked(met.where((F.col("times") > FEW) & (F.lit(last) | (F.col("times") <= crowded))), known, held, held)
        links = links.union(found).union(some)
        roots = components(links, held=held).withColumnRenamed("node", "linked")
        open_ = stored(rooted(many.select("band", "node", "n")), "crowded", held)
        split = open_.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("band")
        rest = stored(open_.join(split, "band", "left_semi").join(finer, "node"), "split", held)
        if last or rest.isEmpty():
            break
        subs = F.transform(F.sequence(F.lit(0), F.lit(SUBS - 1)), lambda j: F.xxhash64("band", j, F.get("finer", j + SUBS * level)))  # noqa: B023
        placed = rest.select("node", "n", F.explode(subs).alias("band"))
    classed = rooted(nodes.select("node", "least"))
    ids = classed.groupBy("root").agg(F.min("least").alias("component"))
    out = marked.select("key", "node").join(classed.join(ids, "root").select("node", "component"), "node").select(F.col("key").alias(key), "component")
    out = stored(out, "classes")
    released(docs.sparkSession, held)
    return out
