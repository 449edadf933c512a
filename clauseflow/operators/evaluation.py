"""Precision and recall of findings against gold spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLAUSE_TYPES, MIN_IOU
from ..sources.gold import normalize_doc_key
from ..sources.scratch import fresh_path
from .placement import place_quotes


def keyed_findings(findings: DataFrame) -> DataFrame:
    """Findings of known clause types with the key that gold uses for documents."""
    return findings.where(F.col("clause_type").isin(*CLAUSE_TYPES)).withColumn("doc_key", normalize_doc_key(F.col("doc_id")))


def evaluated_documents(findings: DataFrame, paragraphs: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """(doc_key): annotated documents that have findings, or that were ingested at all."""
    annotated = paragraphs.select("doc_key").distinct()
    seen = keyed_findings(findings).select("doc_key")
    if ingested is not None:
        seen = seen.union(ingested.select(normalize_doc_key(F.col("doc_id")).alias("doc_key")))
    return annotated.intersect(seen)


def require_evaluated(documents: DataFrame) -> None:
    if documents.isEmpty():
        raise RuntimeError("no document has both findings and annotations")


def place_findings(findings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(finding_id, doc_key, clause_type, para_ix, start, end): the first paragraph that holds the
    quote, exactly or up to white space; null places where none does.

    Paragraphs that share no head with a quote of their document are not searched for it, and contexts
    stop at the join: what is aggregated are places.
    """
    keyed = keyed_findings(findings).select("finding_id", "doc_key", "clause_type", "quote")
    texts = paragraphs.select("doc_key", F.col("para_ix").alias("text_id"), F.col("context").alias("text"))
    held = place_quotes(keyed.withColumnRenamed("finding_id", "quote_id"), texts, within="doc_key")
    first = held.groupBy(F.col("quote_id").alias("finding_id"), "doc_key").agg(F.min(F.struct("text_id", "start", "end")).alias("p"))
    return keyed.drop("quote").join(first, ["finding_id", "doc_key"], "left").select("finding_id", "doc_key", "clause_type", F.col("p.text_id").alias("para_ix"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over union of half-open spans; 0 if they do not meet."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def iou_pairs(placed: DataFrame, gold: DataFrame, min_iou: float = MIN_IOU) -> DataFrame:
    """Pairs of one document, paragraph and clause type that overlap enough: an interval join with
    equal keys first."""
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be over 0 and at most 1")
    keys = ["doc_key", "para_ix", "clause_type"]
    ours = placed.where("para_ix IS NOT NULL").select("finding_id", *keys, F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    theirs = gold.where("start >= 0").select("gold_ix", *keys, F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    met = ours.join(theirs, keys).where((F.col("f_start") < F.col("g_end")) & (F.col("g_start") < F.col("f_end")))
    iou = span_iou(F.col("f_start"), F.col("f_end"), F.col("g_start"), F.col("g_end"))
    return met.withColumn("iou", iou).where(F.col("iou") >= min_iou)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches by falling IoU, ties by finding and then by gold order.

    Pairs never cross a (document, paragraph, clause) cell. Cells are dealt to tasks, sorted there by
    the order of choice, and read in one stream that remembers what the current cell has used; a
    cell's size is that of one paragraph's annotations.
    """
    keys = ["doc_key", "para_ix", "clause_type"]
    columns = [*keys, "finding_id", "gold_ix", "f_start", "iou"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ours, theirs = None, set(), set()
        for batch in batches:
            keep = []
            for *now, finding, gold in zip(*(batch[c] for c in (*keys, "finding_id", "gold_ix")), strict=True):
                if now != cell:
                    cell, ours, theirs = now, set(), set()
                free = finding not in ours and gold not in theirs
                keep.append(free)
                if free:
                    ours.add(finding)
                    theirs.add(gold)
            yield batch[keep]

    rows = pairs.select(*columns).repartition(*keys)
    return rows.sortWithinPartitions(*keys, F.desc("iou"), "f_start", "finding_id", "gold_ix").mapInPandas(choose, rows.schema)


def prf(placed: DataFrame, gold: DataFrame, matches: DataFrame) -> DataFrame:
    """(clause_type, tp, fp, fn, precision, recall, f1): all clause types and ``overall``.

    A finding that could not be placed is a false positive, gold that could not be a miss.
    """
    counts = (
        matches.select("clause_type", F.lit(1).alias("tp"), F.lit(-1).alias("fp"), F.lit(-1).alias("fn"))
        .unionAll(placed.select("clause_type", F.lit(0), F.lit(1), F.lit(0)))
        .unionAll(gold.select("clause_type", F.lit(0), F.lit(0), F.lit(1)))
    )
    every = placed.sparkSession.createDataFrame([(c,) for c in CLAUSE_TYPES], "clause_type string")
    counts = counts.unionAll(every.select("clause_type", F.lit(0), F.lit(0), F.lit(0)))
    sums = counts.rollup("clause_type").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(F.coalesce("clause_type", F.lit("overall")).alias("clause_type"), "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def eval_counters(findings: DataFrame, evaluated: DataFrame, paragraphs: DataFrame, placed: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of counts; placed and gold are those of the evaluated documents."""
    keyed = keyed_findings(findings)
    inside = keyed.join(evaluated, "doc_key", "left_semi")
    parts = [
        evaluated.agg(F.count("*").alias("documents_evaluated")),
        paragraphs.agg(F.countDistinct("doc_key").alias("documents_annotated")),
        keyed.agg(F.count("*").alias("findings_total")),
        inside.agg(F.count("*").alias("inside")),
        placed.agg(F.count_if(F.col("para_ix").isNull()).alias("unlocatable_findings")),
        gold.agg(F.count_if(F.col("start") < 0).alias("unlocatable_gold")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # each has one row
    return row.withColumn("findings_outside", F.col("findings_total") - F.col("inside")).drop("inside")


def evaluate(findings: DataFrame, paragraphs: DataFrame, gold: DataFrame, ingested: DataFrame | None = None, min_iou: float = MIN_IOU) -> DataFrame:
    """The whole comparison: the prf table over the evaluated documents.

    Documents, their paragraphs and places are written to the shared folder, as several steps read
    them."""
    spark = findings.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    documents = stored(evaluated_documents(findings, paragraphs, ingested), "evaluated")
    ours = keyed_findings(findings).join(documents, "doc_key", "left_semi").drop("doc_key")
    theirs = stored(gold.join(documents, "doc_key", "left_semi"), "gold")
    inside = stored(paragraphs.select("doc_key", "para_ix", "context").join(documents, "doc_key", "left_semi"), "paragraphs")
    placed = stored(place_findings(ours, inside), "placed")
    return prf(placed, theirs, greedy_match(iou_pairs(placed, theirs, min_iou)))
