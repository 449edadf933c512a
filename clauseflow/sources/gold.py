"""Gold annotations: nested question-and-answer JSON to a table of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, locate

SCHEMA = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<question:string, "
    "is_impossible:boolean, answers:array<struct<text:string, answer_start:int>>>>>>>>"
)

# The annotation labels that stand for each clause type.
CATEGORIES = {
    "change of control": "change_of_control",
    "anti-assignment": "anti_assignment",
    "most favored nation": "mfn",
    "cap on liability": "indemnity_cap",
    "uncapped liability": "indemnity_cap",
    "renewal term": "auto_renewal",
    "notice period to terminate renewal": "auto_renewal",
    "termination for convenience": "termination_convenience",
    "exclusivity": "exclusivity",
    "governing law": "governing_law",
}


def normalize_doc_key(name: Column) -> Column:
    """Lower-case letters and digits of a name without its file ending."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.(pdf|txt|json)$", "")
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "")


def category_from_question(question: Column) -> Column:
    """The clause type of the label in double quotes, or of the whole question; null if unmapped."""
    label = F.regexp_extract(question, '"([^"]+)"', 1)
    label = F.lower(F.trim(F.when(label != "", label).otherwise(question)))
    table = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.try_element_at(table, label)


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Paragraphs of annotation files: each one JSON object, or with ``lines`` one object in a line."""
    if not lines:
        return paragraphs(spark.read.schema(SCHEMA).option("multiLine", True).json(path).select("data", F.col("_metadata.file_path").alias("file")), "file")
    # a file's parts lie in the order of their starts, and a part's lines in the order of reading
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    rows = read.where(F.trim("value") != "").select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("row"), "file", "part", "line")
    return paragraphs(rows.select("row.data", "file", "part", "line"), "file", "part", "line")


def paragraphs(gold: DataFrame, *order: str) -> DataFrame:
    """(doc_key, para_ix, context, qas). Of entries with one key the last counts, by the columns in
    ``order`` and then by the place in ``data``; one without paragraphs replaces nothing, and one without
    a key is left out."""
    entries = gold.select(*order, F.posexplode("data").alias("entry_ix", "entry"))
    entries = entries.select(F.struct(*order, "entry_ix").alias("entry_ix"), normalize_doc_key(F.col("entry.title")).alias("doc_key"), F.col("entry.paragraphs").alias("paragraphs"))
    entries = entries.where("doc_key != '' AND size(paragraphs) > 0")
    last = entries.groupBy("doc_key").agg(F.max_by("paragraphs", "entry_ix").alias("paragraphs"))
    rows = last.select("doc_key", F.posexplode("paragraphs").alias("para_ix", "p"))
    return rows.select("doc_key", "para_ix", F.coalesce("p.context", F.lit("")).alias("context"), F.col("p.qas").alias("qas"))


def gold_spans(paragraphs: DataFrame) -> DataFrame:
    """(doc_key, para_ix, clause_type, gold_ix, start, end, text): -1, -1 where the text is not found.

    ``gold_ix`` is the order of the answers in the paragraph.
    """
    asked = paragraphs.select("doc_key", "para_ix", "context", F.posexplode("qas").alias("q_ix", "qa"))
    asked = asked.withColumn("clause_type", category_from_question(F.col("qa.question")))
    asked = asked.where(F.col("clause_type").isNotNull() & ~F.coalesce(F.col("qa.is_impossible"), F.lit(False)))
    rows = asked.select("doc_key", "para_ix", "context", "clause_type", "q_ix", F.posexplode("qa.answers").alias("a_ix", "a"))
    rows = rows.where(F.col("a.text").isNotNull()).where(~is_blank(F.col("a.text")))
    text, start = F.col("a.text"), F.col("a.answer_start")
    true_start = F.when((start >= 0) & (F.substring("context", start + 1, F.char_length(text)) == text), start)
    place = locate(F.col("context"), text)
    end = F.when(true_start.isNotNull(), true_start + F.char_length(text)).otherwise(place["end"])
    return rows.select(
        "doc_key",
        "para_ix",
        "clause_type",
        (F.col("q_ix") * F.lit(1 << 20) + F.col("a_ix")).cast("bigint").alias("gold_ix"),
        F.coalesce(true_start, place["start"], F.lit(-1)).cast("int").alias("start"),
        F.coalesce(end, F.lit(-1)).cast("int").alias("end"),
        text.alias("text"),
    )
