"""JSON lines as typed rows, or the reason why a line gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pinned, strip


def read_records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), label: str = "record", unreadable: str = "unreadable", line: str = "line") -> DataFrame:
    """The schema's columns, with ``unreadable`` (null: none) and ``line`` (the text of such a line).

    Each line is parsed once, to a variant. A line that is no JSON object ends the job when it is
    read. An object lacks a required key, or has a value that can't be coerced: then ``unreadable``
    says so, and the other columns are null. Blank lines are skipped.

    Texts take any value, numbers and nested values as their JSON. Integers take numbers (less their
    fraction), numerals in a text, and true or false. Numbers take numbers and numerals. Booleans are
    what Python calls true. Maps take objects, and nothing at all for an empty map. A null, or a key that
    is not required and not there, is null; a required integer can't be null.
    """
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return typed(lines, schema, required, label, unreadable, line)


def typed(lines: DataFrame, schema: str, required: tuple[str, ...] = (), label: str = "record", unreadable: str = "unreadable", line: str = "line") -> DataFrame:
    """``read_records`` of lines(value)."""
    fields = lines.sparkSession.createDataFrame([], schema).schema.fields
    parsed = pinned(lines, "__record", F.parse_json("value"))
    whole = F.schema_of_variant("__record").startswith("OBJECT")
    parsed = pinned(parsed, "__record", F.when(whole, F.col("__record")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 100)))))
    parts = pinned(parsed, "__parts", F.struct(*(F.variant_get("__record", f"$.{f.name}", "variant").alias(f.name) for f in fields)))
    made, faults = [], []
    for f in fields:
        value, fault = _coerced(F.col(f"__parts.`{f.name}`"), f, f.name in required, label)
        made.append(value.alias(f.name))
        faults.append((not isinstance(f.dataType, T.MapType), fault))
    lacking = F.array_compact(F.array(*(F.when(F.col(f"__parts.`{name}`").isNull(), F.lit(name)) for name in required)))
    missing = F.when(F.size(lacking) > 0, F.concat(F.lit(f"{label} missing field(s): "), F.array_join(lacking, ", ")))
    reason = F.coalesce(missing, *(fault for _, fault in sorted(faults, key=lambda x: x[0])))
    told = pinned(parts, "__row", F.struct(reason.alias(unreadable), F.struct(*made).alias("fields")))
    bad = F.col(f"__row.{unreadable}")
    columns = [F.when(bad.isNull(), F.col(f"__row.fields.`{f.name}`")).alias(f.name) for f in fields]
    return told.select(*columns, bad.alias(unreadable), F.when(bad.isNotNull(), F.col("value")).alias(line))


def _coerced(part: Column, field: T.StructField, required: bool, label: str) -> tuple[Column, Column]:
    """(the value, why there is none)."""
    kind = F.schema_of_variant(part)
    none = part.isNull() | (kind == "VOID")
    text = F.when(kind == "STRING", part.cast("string")).when(~none, F.to_json(part))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(part, "$", "boolean").cast("double")).otherwise(F.trim(text).try_cast("double"))
    fault = lambda right, what: F.when(~none & right.isNull() | (none & F.lit(required)), F.lit(f"{label}.{field.name} is no {what}"))
    if isinstance(field.dataType, T.StringType):
        return text, F.when(none & F.lit(required), F.lit(f"{label}.{field.name} is null"))
    if isinstance(field.dataType, T.IntegralType):
        spoken = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("decimal(38,0)"))
        whole = F.when(kind == "STRING", spoken).otherwise(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("decimal(38,0)"))
        value = whole.try_cast(field.dataType)
        return value, fault(value, "integer")
    if isinstance(field.dataType, T.FractionalType):
        return number.cast(field.dataType), fault(number, "number")
    if isinstance(field.dataType, T.BooleanType):
        empty = none | F.coalesce(number == 0, F.lit(False)) & (kind != "STRING") | text.isin("", "{}", "[]")
        return ~F.coalesce(empty, F.lit(False)), F.lit(None).cast("string")
    if isinstance(field.dataType, T.MapType):
        empty = none | text.isin("", "[]", "0", "false")
        value = F.when(empty, F.create_map().cast(field.dataType)).when(kind.startswith("OBJECT"), F.from_json(F.to_json(part), field.dataType))
        return value, F.when(value.isNull(), F.lit(f"{label}.{field.name} is no object"))
    raise TypeError(f"no rule for {field.dataType.simpleString()}")
