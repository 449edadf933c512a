"""Severity by deal structure: row-local rules over verified findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.terms import is_true, stated, term
from ..schemas import CLAUSE_TYPES, DEALS, MIN_CONFIDENCE, SEVERITIES

BLOCKING, CONSENT, NOTE = SEVERITIES

# Fixed value: wording that lets the other side refuse for free.
FREE_REFUSAL = r"(?i)sole|absolute|discretion|any\s+reason"


def severity_for(clause: Column, terms: Column, deal: str) -> Column:
    """struct(severity, reason). Rules stand in order and the first that holds decides; where a rule
    asks that something be stated as true, a value of false does not do."""
    if deal not in DEALS:
        raise ValueError(f"deal is one of {', '.join(DEALS)}")

    def says(key: str) -> Column:
        return is_true(term(terms, key))

    def graded(severity: str, reason: str | Column) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(severity).alias("severity"), text.alias("reason"))

    control, assignment, cap = (clause == c for c in ("change_of_control", "anti_assignment", "indemnity_cap"))
    # The reasons below, which reports and later stages compare by their wording.
    base = F.concat(F.lit("base:"), clause, F.lit(f"/{deal}"))
    rules: list[tuple[Column, Column]] = []
    if deal == "stock":
        rules.append((control & says("termination_right"), graded(BLOCKING, "counterparty may terminate on a change of control")))
    else:
        barred = assignment & says("assignment_barred") & ~stated(term(terms, "exceptions"))
        free = assignment & F.coalesce(term(terms, "consent_standard").rlike(FREE_REFUSAL), F.lit(False))
        rules.append((barred, graded(BLOCKING, "assignment barred outright with no exceptions")))
        rules.append((free, graded(BLOCKING, "consent may be withheld at the counterparty's discretion")))
    rules.append((cap & says("uncapped"), graded(BLOCKING, "liability expressly uncapped")))
    if deal == "asset":
        rules.append((control & says("consent_required"), graded(CONSENT, "deemed-assignment consent may reach an asset transfer")))
        bound = says("assignment_barred") | says("consent_required")
        rules.append((assignment & ~bound, graded(NOTE, "successors-and-assigns language, no transfer restriction")))
        rules.append((assignment, graded(CONSENT, base)))
    else:
        bound = says("consent_required") | says("termination_right") | stated(term(terms, "notice_days"))
        rules.append((control & ~bound, graded(NOTE, "trigger defined but no consequence stated in the span")))
        rules.append((control, graded(CONSENT, base)))
    chain = F.when(*rules[0])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(graded(NOTE, base))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; null counts as a note, an unknown word as 9."""
    chain = F.when(severity.isNull(), len(SEVERITIES) - 1)
    for i, name in enumerate(SEVERITIES):
        chain = chain.when(severity == name, i)
    return chain.otherwise(9)


def score_findings(validated: DataFrame, deal: str, min_confidence: float = MIN_CONFIDENCE, require_validated: bool = True) -> DataFrame:
    """Adds severity, its reason and rank, the deal and low_confidence (which changes no severity).

    Unvalidated findings are skipped unless allowed, findings of unknown clause types always;
    ``skipped`` counts them.
    """
    known = F.col("clause_type").isin(*CLAUSE_TYPES)
    rows = validated.where(known & F.coalesce("validated", F.lit(False)) if require_validated else known)
    graded = rows.withColumn("__s", severity_for(F.col("clause_type"), F.col("terms"), deal))
    return graded.withColumns(
        {
            "severity": F.col("__s.severity"),
            "severity_reason": F.col("__s.reason"),
            "severity_rank": severity_rank(F.col("__s.severity")),
            "deal_structure": F.lit(deal),
            "low_confidence": F.coalesce(F.col("confidence") < min_confidence, F.lit(False)),
        }
    ).drop("__s")


def skipped(findings: DataFrame) -> DataFrame:
    """One row: unvalidated findings, and validated ones of an unknown clause type."""
    good = F.coalesce("validated", F.lit(False))
    known = F.coalesce(F.col("clause_type").isin(*CLAUSE_TYPES), F.lit(False))
    return findings.agg(F.count_if(~good).alias("unvalidated"), F.count_if(good & ~known).alias("unknown_clause"))


def require_scored(scored: DataFrame, findings: DataFrame) -> None:
    if scored.isEmpty():
        unvalidated = skipped(findings).first()["unvalidated"]
        raise RuntimeError(f"all {unvalidated} findings were unvalidated" if unvalidated else "no finding can be scored")


def review_order(scored: DataFrame) -> DataFrame:
    """Worst first; within a severity, sure findings first, then by place."""
    return scored.orderBy(*ORDER)


#: The review list's order: worst first; within a severity, sure findings first, then by place.
ORDER = ("severity_rank", "low_confidence", "doc_id", "page", "char_start", "finding_id")


def review_page(scored: DataFrame, rows: int, behind: Row | None = None) -> DataFrame:
    """The next ``rows`` of ``review_order`` behind a row (none: from the start), without sorting the
    rest: each task keeps its first ``rows``. Nulls come first, as in that order."""
    later = F.lit(True)
    if behind is not None:
        later = F.lit(False)
        for name in reversed(ORDER):
            value, kind = behind[name], scored.schema[name].dataType
            over = F.col(name).isNotNull() if value is None else F.col(name) > F.lit(value).cast(kind)
            later = F.coalesce(over, F.lit(False)) | (F.col(name).eqNullSafe(F.lit(value).cast(kind)) & later)
    return scored.where(later).orderBy(*ORDER).limit(rows)


def severity_counts(scored: DataFrame) -> DataFrame:
    """(severity, n) for all severities, zeros too."""
    every = scored.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, severity_rank int")
    counts = scored.groupBy(F.coalesce("severity", F.lit(NOTE)).alias("severity")).agg(F.count("*").alias("n"))
    return every.join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
