"""Terms (map<string,string> of JSON scalars as text) and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, strip


def term(terms: Column, key: str) -> Column:
    return F.try_element_at(terms, F.lit(key))


def is_true(value: Column) -> Column:
    """True for the words true, yes and y; a number is never true."""
    return F.coalesce(F.lower(strip(value)).isin("true", "yes", "y"), F.lit(False))


def stated(value: Column) -> Column:
    """Any value counts as stated, false and 0 too, except null and blank text."""
    return F.coalesce(strip(value) != "", F.lit(False))


def render_terms(terms: Column) -> Column:
    """``key=value; ...`` by key, without nulls and empty texts; no terms give an empty text."""
    entries = F.filter(F.map_entries(terms), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), clean(e["value"])))
    return F.coalesce(F.array_join(lines, "; "), F.lit(""))
