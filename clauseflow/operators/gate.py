"""The citation gate: a finding passes only if its quote stands at its offsets in the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, is_blank
from ..schemas import MAX_DROP_RATE, MAX_QUOTE_CHARS
from ..sources.stages import write_counted
from .documents import page_for_offset, page_offsets

#: Findings that are checked beside one reading of a text; offsets in a bin.
GATHERED, BIN = 4096, 4096


def _sound(length: str) -> Column:
    return (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.col("char_end") <= F.col(length))


def attach_source(findings: DataFrame, documents: DataFrame, most: int = GATHERED) -> DataFrame:
    """Adds what the checks need: whether there is a text, its length, the cited slice and the page.

    A document's findings are gathered to arrays of some ``most`` at the most and joined one to one, so
    a text is read once for that many, however many findings cite it. The text itself stops at the
    join. Its length is that of the documents table.
    """
    length = F.when(F.col("full_text").isNotNull(), F.col("char_length") if "char_length" in documents.columns else F.char_length("full_text"))
    texts = documents.select(F.col("doc_id").alias("__doc"), F.col("full_text").alias("__text"), F.col("pages").alias("__pages"), length.alias("__length"))
    busy = findings.groupBy(F.col("doc_id").alias("__busy")).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    dealt = F.pmod(F.xxhash64("finding_id", "char_start", "char_end"), F.ceil(F.col("__n") / most))
    parts = findings.join(busy, F.col("doc_id") == F.col("__busy"), "left").withColumn("__part", F.coalesce(dealt, F.lit(0)))
    lists = parts.groupBy(F.col("doc_id").alias("__of"), "__part").agg(F.collect_list(F.struct(*(F.col(c) for c in findings.columns))).alias("__rows"))
    joined = lists.join(texts, F.col("__of") == F.col("__doc"), "left")
    mapped = F.coalesce(F.size("__pages") > 0, F.lit(False))

    def seen(row: Column) -> Column:
        start, end = row["char_start"], row["char_end"]
        sound = (start >= 0) & (end > start) & (end <= F.col("__length"))
        cut = F.when(sound, F.substring("__text", start + 1, end - start))
        return F.struct(row.alias("__row"), cut.alias("__slice"), F.when(mapped, page_for_offset(F.col("__pages"), start)).alias("__expected"))

    each = joined.select("__length", (F.col("__length").isNotNull() & ~mapped).alias("__bare"), F.explode(F.transform("__rows", seen)).alias("__seen"))
    return each.select("__seen.__row.*", "__length", "__seen.__slice", "__seen.__expected", "__bare")


def attach_pages(findings: DataFrame, pages: DataFrame, bin_chars: int = BIN) -> DataFrame:
    """As ``attach_source``, from pages(doc_id, page_no, page_text): no document is ever one row.

    Findings and pages meet where their intervals do, by bins of ``bin_chars`` offsets; of a page only
    the part that a finding cites goes on, and the parts of a quote over page borders are put together.
    """
    placed = page_offsets(pages)
    order = Window.partitionBy("doc_id").orderBy("start")
    numbered = placed.select("doc_id", "start", "end", "body", F.row_number().over(order).alias("number"))
    sizes = placed.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("end").alias("__length"))
    rows = findings.join(sizes, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_chars), F.floor((hi - 1) / bin_chars)))
    # a place and its text follow from the document and the offsets: no number that is given to rows, and
    # may be given otherwise when they are read again, ties a slice to its finding
    place = [F.col("doc_id").alias("__doc"), F.col("char_start").alias("lo"), F.col("char_end").alias("hi")]
    cited = rows.where(_sound("__length")).select(*place).withColumn("bin", bins(F.col("lo"), F.col("hi")))
    held = numbered.withColumn("bin", bins(F.col("start"), F.col("end"))).withColumnRenamed("bin", "__bin")
    met = cited.join(held, (F.col("__doc") == F.col("doc_id")) & (F.col("bin") == F.col("__bin")) & (F.col("lo") < F.col("end")) & (F.col("start") < F.col("hi")))
    # of the bins that both lie in, the first one speaks
    met = met.where(F.col("bin") == F.floor(F.greatest("lo", "start") / bin_chars))
    part = F.substring("body", F.greatest(F.col("lo") - F.col("start"), F.lit(0)) + 1, F.least("hi", "end") - F.greatest("lo", "start"))
    whole = met.groupBy("__doc", "lo", "hi").agg(F.sort_array(F.collect_set(F.struct("start", part.alias("part")))).alias("parts"), F.min("number").alias("__expected"))
    cuts = whole.select("__doc", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.array_join("parts.part", "").alias("__slice"), "__expected")
    same = (F.col("doc_id") == F.col("__doc")) & (F.col("char_start") == F.col("__lo")) & (F.col("char_end") == F.col("__hi"))
    return rows.join(cuts, same, "left").drop("__doc", "__lo", "__hi").withColumn("__bare", F.lit(False))


def check_finding(findings: DataFrame, documents: DataFrame, page_policy: str = "repair") -> DataFrame:
    """Adds ``reason`` (null: passes), ``page_repair`` (null: none) and ``no_page_map``, and sets
    ``validated``.

    The first test that fails gives the reason. ``strict`` drops a finding whose page differs from
    the page map; ``repair`` sets the page from the verified offset and says so. Without a page map
    the page is not checked. The quote is never repaired.
    """
    return judged(attach_source(findings, documents), page_policy)


def check_finding_pages(findings: DataFrame, pages: DataFrame, page_policy: str = "repair") -> DataFrame:
    """``check_finding`` from pages(doc_id, page_no, page_text) in place of documents."""
    return judged(attach_pages(findings, pages), page_policy)


def check_records(records: DataFrame, documents: DataFrame, page_policy: str = "repair") -> DataFrame:
    """``check_finding`` of ``sources.records.read_records``: records that are no findings fail too, by the
    reason ``unreadable_finding``, with their line in ``record``; they belong to no document."""
    good = records.where("unreadable IS NULL").drop("unreadable", "line")
    bad = records.where("unreadable IS NOT NULL").withColumns({"validated": F.lit(False), "reason": F.concat(F.lit("unreadable_finding:"), "unreadable")})
    return check_finding(good, documents, page_policy).unionByName(bad.withColumnRenamed("line", "record").drop("unreadable"), allowMissingColumns=True)


def judged(seen: DataFrame, page_policy: str) -> DataFrame:
    """The checks over what ``attach_source`` or ``attach_pages`` adds."""
    if page_policy not in ("strict", "repair"):
        raise ValueError("page_policy is strict or repair")
    quote, page, expected = F.coalesce("quote", F.lit("")), F.col("page"), F.col("__expected")
    reason = (
        F.when(F.col("__length").isNull(), "missing_fulltext")
        .when(is_blank(quote), "empty_quote")
        .when(F.char_length(quote) > MAX_QUOTE_CHARS, "quote_too_long")
        .when(F.coalesce((F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")), F.lit(True)), "invalid_offsets")
        .when(F.col("char_end") > F.col("__length"), "offsets_past_end_of_document")
        .when(collapse_ws(F.col("__slice")) != collapse_ws(quote), "quote_mismatch")
    )
    moved = expected.isNotNull() & ~page.eqNullSafe(expected)
    wrong = F.concat(F.lit("page_mismatch:cited_"), F.coalesce(page.cast("string"), F.lit("None")), F.lit("_actual_"), expected)
    if page_policy == "strict":
        reason = reason.when(moved, wrong)
    checked = seen.withColumn("reason", reason)
    fixed = F.col("reason").isNull() & moved
    label = F.concat(F.lit("page_repaired_"), F.coalesce(page.cast("string"), F.lit("None")), F.lit("_to_"), expected)
    checked = checked.withColumn("page_repair", F.when(fixed, label))
    checked = checked.withColumn("page", F.when(fixed, expected).otherwise(page)).withColumn("validated", F.col("reason").isNull())
    return checked.withColumnRenamed("__bare", "no_page_map").drop("__length", "__slice", "__expected")


def split_validated(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(validated findings, failures with ``validation_error``): write or cache ``checked`` first."""
    good = checked.where("reason IS NULL").drop("reason", "page_repair", "no_page_map", "record")
    bad = checked.where("reason IS NOT NULL").drop("page_repair", "no_page_map").withColumnRenamed("reason", "validation_error")
    return good, bad


def write_checked(checked: DataFrame, path: str) -> dict[str, int]:
    """Writes what was checked; total, validated, dropped and page_repairs are counted on the way."""
    seen = write_counted(checked, path, validated=F.count_if(F.col("reason").isNull()), page_repairs=F.count("page_repair"))
    return {"total": seen["rows"], "validated": seen["validated"], "dropped": seen["rows"] - seen["validated"], "page_repairs": seen["page_repairs"]}


def gate_reports(checked: DataFrame) -> DataFrame:
    """(level, reason, doc_id, total, validated, dropped, page_repairs, no_page_map): the gate's reports
    from one scan. ``level`` is all, reason (of what was dropped) or document."""
    kinds = F.substring_index("reason", ":", 1)
    unread = kinds.eqNullSafe("unreadable_finding")
    rows = checked.select(kinds.alias("reason"), "doc_id", "page_repair", F.coalesce("no_page_map", F.lit(False)).alias("bare"), unread.alias("unread"))
    counts = [
        F.count("*").alias("total"),
        F.count_if(F.col("reason").isNull()).alias("validated"),
        F.count_if(F.col("reason").isNotNull()).alias("dropped"),
        F.count("page_repair").alias("page_repairs"),
        F.max("bare").alias("no_page_map"),
        F.min("unread").alias("unread"),
    ]
    grouped = rows.withColumns({"kind": F.col("reason"), "doc": F.col("doc_id")}).groupingSets([["kind"], ["doc"], []], "kind", "doc")
    made = grouped.agg(F.grouping_id().alias("id"), *counts)
    level = F.when(F.col("id") == 3, "all").when(F.col("id") == 1, "reason").otherwise("document")
    told = made.select(level.alias("level"), F.col("kind").alias("reason"), F.col("doc").alias("doc_id"), "total", "validated", "dropped", "page_repairs", "no_page_map", "unread")
    # what passed has no reason, and unreadable records no document
    return told.where(~((F.col("level") == "reason") & F.col("reason").isNull())).where(~((F.col("level") == "document") & F.col("unread"))).drop("unread")


def validation_report(checked: DataFrame, max_drop_rate: float = MAX_DROP_RATE) -> DataFrame:
    """One row: total, validated, dropped, drop_rate (4 places), threshold_exceeded (by the exact
    rate), page_repairs."""
    counts = checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason").isNull()).alias("validated"),
        F.count("page_repair").alias("page_repairs"),
    )
    dropped = F.col("total") - F.col("validated")
    rate = F.when(F.col("total") > 0, dropped / F.col("total")).otherwise(0.0)
    return counts.select("total", "validated", dropped.alias("dropped"), F.round(rate, 4).alias("drop_rate"), (rate > max_drop_rate).alias("threshold_exceeded"), "page_repairs")


def drops_by_reason(checked: DataFrame) -> DataFrame:
    """(reason, n): reasons count by what stands before the first colon."""
    kind = F.substring_index("reason", ":", 1)
    return checked.where("reason IS NOT NULL").groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


def drops_by_doc(checked: DataFrame) -> DataFrame:
    """(doc_id, validated, dropped); unreadable records are in no document."""
    good = F.col("reason").isNull()
    read = ~F.coalesce(F.col("reason").startswith("unreadable_finding:"), F.lit(False))
    return checked.where(read).groupBy("doc_id").agg(F.count_if(good).alias("validated"), F.count_if(~good).alias("dropped"))


def missing_page_maps(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Cited documents that have a text but no page map."""
    bare = documents.where(F.col("full_text").isNotNull() & (F.coalesce(F.size("pages"), F.lit(0)) <= 0))
    return bare.select("doc_id").join(findings.select("doc_id"), "doc_id", "left_semi").distinct()


def require_gate(report: DataFrame, max_drop_rate: float = MAX_DROP_RATE) -> None:
    """An error if there was nothing, too much was dropped, or nothing passed; call it after the
    output is written."""
    row = report.first()
    if row is None or not row["total"]:
        raise ValueError("no findings to check")
    rate = row["dropped"] / row["total"]
    if rate > max_drop_rate:
        raise RuntimeError(f"{rate:.1%} of the findings were dropped; at most {max_drop_rate:.1%} may be")
    if not row["validated"]:
        raise RuntimeError("no finding passed")
