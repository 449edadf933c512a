"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import fresh_path, remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage: what follows reads files that every executor sees, so a lost executor
    costs its running tasks only, and Python work ahead of the cut runs once. The table's path is
    added to ``held``, which ``released`` takes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, held: list[str]) -> None:
    """Deletes stored tables, once all that is made of them is stored itself."""
    while held:
        remove(spark, held.pop())


def batches_of(spark: SparkSession, rows: int = 256) -> None:
    """Rows in an Arrow batch: whole texts go to Python, and some are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def column(name: str) -> Column:
    """A column by its very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less any columns of these names, as Spark compares names: an operator's own columns take
    the place of such."""
    gone = {n.lower() for n in names}
    return df.select(*(column(c) for c in df.columns if c.lower() not in gone))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns' places as their names, as Spark's Python maps cannot read all names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def kind_of(df: DataFrame, name: str) -> str:
    return df.select(column(name)).schema[0].dataType.simpleString()


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column, so that keys of any type can be built in Python."""
    return to_arrow_type(df.select(column(name)).schema[0].dataType)


def utf8(name: str) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def sha256(name: str) -> Column:
    return F.sha2(F.col(name), 256)


#: Bits of a bitmap's bucket (Spark's own size), and of the whole bitmap at the most: 2^27 are 16 MB.
BUCKET, MOST_SLOTS = 1 << 15, 1 << 27


def flagged(rows: DataFrame, name: str, wanted: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with the boolean ``flag``: whether the column may be among ``wanted[key]``. It is true for
    all that are, and for few others while the wanted keys are few.

    The keys' hashes set bits of a bitmap, which is broadcast. It has sixteen bits for each wanted
    row, but MOST_SLOTS (16 MB) at the most. Beyond what that serves, nearly every row would pass:
    then all do, without a bitmap.
    """
    n = wanted.count()
    if n > MOST_SLOTS:
        return rows.withColumn(flag, F.lit(True))
    slots = min(MOST_SLOTS, max(BUCKET, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    bucket, held, place = spare(rows, "bucket", "bits", "place")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) + 1
    bits = wanted.where(F.col(key).isNotNull()).select(slot(key).alias(place))
    maps = bits.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(held))
    at = F.bitmap_bit_position(slot(name))
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot(name)) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False)) & F.col(name).isNotNull()
    return joined.select(*columns(rows), found.alias(flag))


#: A key with more than one of HOT rows is hot: fewer than HOT keys can be, whatever the table's size.
HOT = 1 << 10


def hot_keys(counts: DataFrame, columns: list[str | Column], n: str) -> DataFrame:
    """Of a table with the rows of each key in ``n``, the columns of those keys that have more than
    1 in HOT of all rows: fewer than HOT, so that they may be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT > total).select(*columns)


def sift(rows: DataFrame, name: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that ``flagged`` marks. They are then joined exactly; the point is not to shuffle the
    rest."""
    (maybe,) = spare(rows, "maybe")
    return flagged(rows, name, wanted, key, maybe).where(F.col(maybe)).drop(maybe)


def lacking(rows: DataFrame, name: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose column is not among ``wanted[key]``. Of rows only those that may be are shuffled."""
    (maybe,) = spare(rows, "maybe")
    marks = flagged(rows, name, wanted, key, maybe)
    gone = wanted.select(F.col(key).alias(name)).distinct()
    rest = marks.where(F.col(maybe)).join(gone.hint("merge"), name, "left_anti").select(*columns(rows))
    return marks.where(~F.col(maybe)).select(*columns(rows)).union(rest)


def attached(rows: DataFrame, name: str, wanted: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of ``wanted``, null where its key is not among them; ``wanted`` has
    each key once, and names that rows lacks. Of rows only those that may have one are shuffled."""
    maybe, other = spare(rows, "maybe", "other")
    marks = flagged(rows, name, wanted, key, maybe)
    more = [c for c in wanted.columns if c != key]
    none = [F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in more]
    rest = marks.where(F.col(maybe)).join(wanted.withColumnRenamed(key, other).hint("merge"), column(name) == F.col(other), "left")
    return marks.where(~F.col(maybe)).select(*columns(rows), *none).union(rest.select(*columns(rows), *more))
