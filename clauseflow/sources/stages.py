"""Stage tables as JSON lines or Parquet, page text, and the issues list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..schemas import DOCUMENTS, PAGES, REQUIRED


def read_stage(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), corrupt: str | None = None, extra: str | None = None) -> DataFrame:
    """JSON lines with a declared schema. Blank lines are skipped.

    A malformed line ends the job, and so does a row without a required field, when that row is
    read; with ``corrupt``, malformed lines land in that column instead, and nothing is required of
    them. With ``extra``, that column
    has the keys that the schema does not know, as a JSON object in the keys' order (null: none).
    """
    mode = "PERMISSIVE" if corrupt else "FAILFAST"
    if extra is None:
        reader = spark.read.option("mode", mode)
        whole = f"{schema}, {corrupt} string" if corrupt else schema
        reader = reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader
        return require(reader.schema(whole).json(path), required, corrupt)
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = f"{schema}, {corrupt} string" if corrupt else schema
    options = {"mode": mode} | ({"columnNameOfCorruptRecord": corrupt} if corrupt else {})
    known = [f.name for f in spark.createDataFrame([], schema).schema]
    held = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, v: ~k.isin(*known))
    rows = lines.select(F.from_json("value", fields, options).alias("row"), F.when(F.size(held) > 0, F.to_json(held)).alias(extra))
    return require(rows.select("row.*", extra), required, corrupt)


def require(df: DataFrame, columns: tuple[str, ...], corrupt: str | None = None) -> DataFrame:
    """Every row as it is, or an error that names the first required field without a value; rows with
    a text in ``corrupt`` are left alone."""
    for name in columns:
        missing = F.raise_error(F.lit(f"missing field: {name}")).cast(df.schema[name].dataType)
        lacks = F.col(name).isNull() & (F.col(corrupt).isNull() if corrupt else F.lit(True))
        df = df.withColumn(name, F.when(lacks, missing).otherwise(F.col(name)))
    return df


def read_named_stage(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return read_stage(spark, path, schema, REQUIRED.get(name, ()))


def write_counted(df: DataFrame, path: str, format: str = "parquet", **counts: Column) -> dict[str, int]:
    """Writes a table and returns what was counted on the way, ``rows`` at least: no second scan."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in counts.items())).write.format(format).save(path)
    return seen.get


def write_stage(df: DataFrame, path: str, format: str = "json", extra: str | None = None) -> int:
    """Writes a stage and returns its number of rows; with ``extra``, JSON lines in which that column's
    keys stand beside the others."""
    if extra is None:
        return write_counted(df, path, format)["rows"]
    known = F.to_json(F.struct(*(c for c in df.columns if c != extra)))
    more = F.regexp_replace(extra, r"^\s*\{\s*|\s*\}\s*$", "")
    head = F.regexp_replace(known, r"\}$", "")
    comma = F.when(head == "{", "").otherwise(",")
    line = F.when(F.coalesce(more, F.lit("")) == "", known).otherwise(F.concat(head, comma, more, F.lit("}")))
    return write_counted(df.select(line.alias("value")), path, "text")["rows"]


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Page text by document and page, from a table."""
    return spark.read.schema(PAGES).format(format).load(path)


def source_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, length) of the files under a folder, by name and at any depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def write_documents(documents: DataFrame, path: str) -> None:
    """Full texts and page maps, clustered by document so that a reader can skip files."""
    documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def write_document_table(documents: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Documents as a table in buckets of doc_id, sorted in each: joins on doc_id move no text. The
    number of buckets is for the writer to choose, some GB of text each at the most."""
    documents.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(name)


def open_document_table(spark: SparkSession, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The table of ``write_document_table``, in a session that does not know it yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({DOCUMENTS}) USING parquet CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The documents; with ``wanted(doc_id)``, a row for each, its text null if there is none."""
    documents = spark.read.parquet(path)
    return documents if wanted is None else wanted.select("doc_id").join(documents, "doc_id", "left")


def write_issues(issues: DataFrame, path: str) -> None:
    """The issues list as CSV with a header; files in name order have the list's order."""
    flat = issues.select(*(clean(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in issues.dtypes))
    flat.write.option("header", True).option("escape", '"').csv(path)
