"""The corpus pipeline: each stage takes what its predecessor kept of ``documents``.

quality classifier -> line dedup -> SimHash near-dedup -> benchmark decontamination -> BPE encoding
and decoding. The first four return the columns of ``documents``; the last returns a row for each
document left: doc_id, its token ids' number and digest, and the digest of the text decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm import bpe, decontaminate, line_dedup, near_copies, quality
from clauseflow.llm.common import lacking, spare, stored, table

#: Some stages cannot be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score for quality is under 0.5."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = spare(docs, "score")
    return quality.scored(docs, model, score=score).where(F.col(score) >= 0.5).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line equals, however short, or nearly; n_chars follows the text."""
    cut = line_dedup.cut_lines(docs, line_dedup.removed_lines(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates: documents linked by
    pairs that have four fifths of their five-word shingles in common (Jaccard). Pairs come from the
    SimHash grid, and those too far apart for it from MinHash bands.

    Documents that line dedup has left without a word are copies of each other: one stays.
    """
    found = near_copies.near_copies(docs)
    return lacking(docs, "doc_id", found.where("doc_id != component"), "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands, give or take the error budget."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text."""
    path = bpe.vocabulary_path()
    return bpe.digests(bpe.round_trip(docs, path))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
