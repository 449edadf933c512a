"""Periods of time as contracts word them: phrases are quoted, days only serve to sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = r"(?i)(?:\b[a-z]+(?:-[a-z]+)?\s+\(\d+\)|\b\d+)\s+(?:calendar\s+|business\s+)?(?:day|week|month|year)s?\b"


def period_phrases(quote: Column) -> Column:
    """Every phrase such as "ninety (90) days", "six (6) months" or "30 days", as worded, in order."""
    return F.regexp_extract_all(quote, F.lit(PERIOD), F.lit(0))


def phrase_days(phrase: Column) -> Column:
    """About how many days a phrase names (30 to a month, 365 to a year); null if too large."""
    number = F.regexp_extract(phrase, "([0-9]+)", 1).try_cast("int")
    unit = F.lower(phrase)
    factor = F.when(unit.contains("year"), 365).when(unit.contains("month"), 30).when(unit.contains("week"), 7).otherwise(1)
    return F.try_multiply(number, factor)


def shortest_days(quote: Column) -> Column:
    """The least day count among the phrases of a quote; null without one."""
    return F.array_min(F.transform(period_phrases(quote), phrase_days))
