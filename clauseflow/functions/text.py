"""Text columns: white space, identifiers and literal search.

Offsets count Unicode code points from 0. Only functions that count code points are used for them
(``position``, ``substring``, ``char_length``), never ``regexp_instr``, which counts UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separator controls that (?U)\\s leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one blank, ends are stripped: the only change a quote may have."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return collapse_ws(text) == ""


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def page_body(text: Column) -> Column:
    """A page's text with line feeds only, and one at its end."""
    body = normalize_newlines(F.coalesce(text, F.lit("")))
    return F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))


def safe_doc_id(name: Column) -> Column:
    """A name that is safe as a file name, 120 characters at most; null if nothing is left."""
    plain = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    plain = F.regexp_replace(plain, "^[._-]+|[._-]+$", "")
    return F.when(plain != "", F.substring(plain, 1, 120))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The same parts give the same id in every run."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    digest = F.substring(F.sha1(F.concat_ws("|", *texts).cast("binary")), 1, 16)
    return F.concat(F.lit(f"{prefix}-"), digest) if prefix else digest


def _tolerant(quote: Column) -> Column:
    """A pattern for the quote's words, literally, with any white space between them."""
    quoted = F.transform(F.split(collapse_ws(quote), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(quoted, f"{SPACE}+")


def locate(window: Column, quote: Column) -> Column:
    """struct(start, end, text) of the quote's first place in the window; null if it has none.

    An exact place comes first; else one that differs in white space only. Of the latter the text is
    the window's own, and its first place is the match itself: an earlier one would have matched.
    """
    exact = F.position(quote, window)
    found = F.when(exact > 0, quote).otherwise(F.regexp_substr(window, _tolerant(quote)))
    at = F.when(exact > 0, exact).otherwise(F.position(found, window)) - 1
    place = F.struct(at.cast("int").alias("start"), (at + F.char_length(found)).cast("int").alias("end"), found.alias("text"))
    return F.when(~is_blank(quote) & found.isNotNull(), place)


def clean(text: Column) -> Column:
    """One line without control characters, for a cell; null is empty."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return collapse_ws(plain)


def yes_no(flag: Column) -> Column:
    return F.when(flag.isNull(), "").when(flag, "yes").otherwise("no")


def cell_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, where it stands.

    A filter on a plain column is pushed below it with the column's whole expression in place of its
    name; on chains of costly columns that multiplies the work and the generated code. Filters on
    what a generator makes stay above it.
    """
    return df.withColumn(name, F.explode(F.array(value)))
