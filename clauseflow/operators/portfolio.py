"""Questions across contracts, from verified quotes.

The quote is read by patterns, which see less than a person: what each operator cannot see is
said where it stands. A caller may pass ``positions(finding_id, position)`` of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_phrases, shortest_days
from ..functions.text import collapse_ws
from ..schemas import CLAUSE_TYPES
from .gate import validation_report
from .severity import FREE_REFUSAL, severity_counts, severity_rank

GATING = ("change_of_control", "anti_assignment", "termination_convenience")
DATED = ("auto_renewal", "change_of_control", "termination_convenience", "exclusivity")
OBLIGATION = r"(?i)\b(?:shall|must|may not|may terminate|consent|notice|not less than)\b"
STANDARD = r"(?i)(sole(?:\s+and\s+absolute)?\s+discretion|absolute\s+discretion|not\s+(?:to\s+)?(?:be\s+)?unreasonably\s+(?:withheld|delayed|conditioned)|for\s+any\s+reason)"
LEAST_DOCUMENTS, RARE = 5, 0.1


def diligence_summary(scored: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: findings by severity, the drop rate and page repairs."""
    counts = severity_counts(scored).groupBy().pivot("severity", ["blocking", "consent_required", "note"]).agg(F.first("n"))
    return counts.crossJoin(validation_report(checked).select("drop_rate", "page_repairs"))


def consent_standard(quote: Column) -> Column:
    """The standard as worded, collapsed and lower-cased; null if the quote has none."""
    found = F.regexp_extract(quote, STANDARD, 1)
    return F.when(found != "", F.lower(collapse_ws(found)))


def obligations(scored: DataFrame, ordered: bool = True) -> DataFrame:
    """Consent and notice duties: quotes of three clause types, or graded consent_required, that
    hold words of obligation. Other duties (payment, delivery, insurance) are not in the data."""
    quote = F.col("quote")
    rows = scored.where(F.col("clause_type").isin(*GATING) | (F.col("severity") == "consent_required")).where(quote.rlike(OBLIGATION))
    rows = rows.select(
        "finding_id", "doc_id", "doc_title", "clause_type", "severity", "severity_rank", "page", "char_start", "quote",
        F.get(period_phrases(quote), F.lit(0)).alias("deadline"),
        shortest_days(quote).alias("deadline_days"),
        consent_standard(quote).alias("consent_standard"),
        F.coalesce(consent_standard(quote).rlike("sole|absolute"), F.lit(False)).alias("sole_discretion"),
    )
    keys = [F.asc_nulls_last("deadline_days"), "severity_rank", "doc_id", "page", "char_start", "finding_id"]
    return rows.orderBy(*keys) if ordered else rows


def calendar(validated: DataFrame, ordered: bool = True) -> DataFrame:
    """Notice windows as worded: automatic renewals first, then the shortest window. Windows are
    relative; no date is computed, since no anchor is known."""
    quote = F.col("quote")
    rows = validated.where(F.col("clause_type").isin(*DATED)).select(
        "finding_id", "doc_id", "doc_title", "clause_type", "page", "char_start", "quote",
        (F.col("clause_type") == "auto_renewal").alias("renews_by_itself"),
        F.array_join(period_phrases(quote), "; ").alias("windows"),
        shortest_days(quote).alias("window_days"),
        F.when(F.size(period_phrases(quote)) > 0, "anchor not extracted").otherwise("no window stated").alias("note"),
    )
    keys = [F.desc("renews_by_itself"), F.asc_nulls_last("window_days"), "doc_id", "page", "char_start", "finding_id"]
    return rows.orderBy(*keys) if ordered else rows


def verify_names(names: DataFrame, documents: DataFrame) -> DataFrame:
    """names(doc_id, name_clause, party) with ``verified``: the clause stands word for word in the
    document, white space included."""
    joined = names.join(documents.select("doc_id", "full_text"), "doc_id", "left")
    held = (F.coalesce("name_clause", F.lit("")) != "") & F.coalesce(F.contains("full_text", "name_clause"), F.lit(False))
    return joined.select(*names.columns, held.alias("verified"))


def counterparty_rollup(verified: DataFrame, scored: DataFrame) -> DataFrame:
    """For each verified party: contracts, worst severity, governing laws, and consents that gate."""
    parties = verified.where("verified").select("party", "doc_id").distinct()
    facts = scored.select("doc_id", "severity_rank", "severity", "clause_type", position().alias("position"), consent_standard(F.col("quote")).alias("standard"))
    gate = F.col("clause_type").isin("change_of_control", "anti_assignment") & F.col("severity").isin("blocking", "consent_required")
    rows = parties.join(facts, "doc_id", "left")
    law = F.when(F.col("clause_type") == "governing_law", F.col("position"))
    out = rows.groupBy("party").agg(
        F.countDistinct("doc_id").alias("contracts"),
        F.min("severity_rank").alias("worst_rank"),
        F.array_join(F.array_sort(F.collect_set(law)), "; ").alias("governing_laws"),
        F.countDistinct(F.when(gate, F.col("doc_id"))).alias("gating_contracts"),
        F.array_join(F.array_sort(F.collect_set(F.when(gate, F.col("standard")))), "; ").alias("consent_standards"),
    )
    return out.withColumn("concentrated", (F.col("contracts") > 1) & (F.col("gating_contracts") > 1))


def position(clause: str = "clause_type", quote: str = "quote") -> Column:
    """The comparable position of a quote: jurisdiction, window, cap, standard, reach or parties.

    Trivial equivalents fold ("State of Delaware", "ninety (90) days"); a quote whose wording no
    pattern knows is ``other``.
    """
    c, q = F.col(clause), F.col(quote)
    law = F.trim(F.regexp_extract(q, r"(?i)laws\s+of\s+(?:the\s+)?(?:state\s+of\s+|republic\s+of\s+)?([^.,;]+)", 1))
    window = F.concat(shortest_days(q).cast("string"), F.lit(" days"))
    return (
        F.when((c == "governing_law") & q.rlike(r"(?i)arbitrat"), F.lit("arbitration"))
        .when((c == "governing_law") & (law != ""), F.upper(law))
        .when(c == "indemnity_cap", F.when(q.rlike(r"(?i)unlimited|without\s+limitation"), "uncapped").otherwise("capped"))
        .when(c == "exclusivity", F.when(q.rlike(r"(?i)world-?wide"), "worldwide").otherwise("regional"))
        .when(c == "anti_assignment", F.when(q.rlike(FREE_REFUSAL), "free refusal").when(q.rlike(r"(?i)unreasonabl"), "reasonable").otherwise("other"))
        .when(c.isin("auto_renewal", "change_of_control"), F.coalesce(window, F.lit("no window")))
        .when(c == "termination_convenience", F.when(q.rlike(r"(?i)either\s+party"), "mutual").otherwise("one party"))
        .otherwise("other")
    )


def positions(validated: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(finding_id, doc_id, clause_type, position); ``given(finding_id, position)`` has precedence."""
    rows = validated.select("finding_id", "doc_id", "clause_type", position().alias("position"))
    if given is None:
        return rows
    own = given.groupBy("finding_id").agg(F.min("position").alias("__given"))
    return rows.join(own, "finding_id", "left").select("finding_id", "doc_id", "clause_type", F.coalesce("__given", "position").alias("position"))


def position_distribution(positions: DataFrame) -> DataFrame:
    """(clause_type, position, documents, total, share, majority, majority_documents).

    Documents are counted first; the windows run over positions, never over findings.
    """
    counts = positions.groupBy("clause_type", "position").agg(F.countDistinct("doc_id").alias("documents"))
    totals = positions.groupBy("clause_type").agg(F.countDistinct("doc_id").alias("total"))
    top = counts.groupBy("clause_type").agg(F.min(F.struct(-F.col("documents"), "position")).alias("top"))
    rows = counts.join(totals, "clause_type").join(top, "clause_type")
    return rows.select("clause_type", "position", "documents", "total", F.round(F.col("documents") / F.col("total"), 6).alias("share"), F.col("top.position").alias("majority"), (-F.col("top.col1")).alias("majority_documents"))


def value_outliers(distribution: DataFrame, least: int = LEAST_DOCUMENTS, rare: float = RARE) -> DataFrame:
    """Positions of one document, or of under a tenth, where the rest mostly agree.

    Clause types with fewer than ``least`` documents are refused: they get no rows.
    """
    alone = (F.col("documents") == 1) | (F.col("documents") / F.col("total") < rare)
    agree = F.col("majority_documents") / F.col("total") > 0.5
    return distribution.where((F.col("total") >= least) & alone & agree & (F.col("position") != F.col("majority")))


def require_portfolio(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> None:
    n = documents.select("doc_id").distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{n} documents are no distribution; {least} are needed")


def absences(documents: DataFrame, validated: DataFrame, candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, clause_type, cause): no finding where most documents have one.

    The cause is pipeline_gap (an extraction error on a candidate with that hint), not_found
    (screened, but nothing extracted) or never_screened. Pairs are documents times the eight clause
    types, a fixed list.
    """
    spark = documents.sparkSession
    every = documents.select("doc_id").distinct()
    clauses = spark.createDataFrame([(c,) for c in CLAUSE_TYPES], "clause_type string")
    present = validated.select("doc_id", "clause_type").distinct()
    common = present.join(every, "doc_id", "left_semi").groupBy("clause_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(every.agg(F.count("*").alias("total"))))
    common = common.where("n * 2 > total").select("clause_type")
    gaps = every.crossJoin(F.broadcast(clauses.join(common, "clause_type", "left_semi"))).join(present, ["doc_id", "clause_type"], "left_anti")
    failed = errors.select("candidate_id").distinct().withColumn("__failed", F.lit(True))
    hinted = candidates.select("candidate_id", "doc_id", F.explode("clause_hints").alias("clause_type")).join(failed, "candidate_id", "left")
    seen = hinted.groupBy("doc_id", "clause_type").agg(F.max(F.coalesce("__failed", F.lit(False))).alias("failed"))
    cause = F.when(F.col("failed"), "pipeline_gap").when(F.col("failed").isNotNull(), "not_found").otherwise("never_screened")
    return gaps.join(seen, ["doc_id", "clause_type"], "left").select("doc_id", "clause_type", cause.alias("cause"))


def rank_anomalies(outliers: DataFrame, positions: DataFrame, scored: DataFrame, ordered: bool = True) -> DataFrame:
    """The findings that hold outlying positions, worst first and rarest next, with the majority's
    position and count beside the quote."""
    held = positions.join(outliers, ["clause_type", "position"])
    facts = scored.select("finding_id", "severity", severity_rank(F.col("severity")).alias("severity_rank"), "page", "quote")
    rows = held.join(facts, "finding_id").select("finding_id", "doc_id", "clause_type", "position", "severity", "severity_rank", "documents", "total", "share", "majority", "majority_documents", "page", "quote")
    return rows.orderBy("severity_rank", "share", "doc_id", "finding_id") if ordered else rows
