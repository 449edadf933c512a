"""Screening of a stream of chunks: the batch expressions as they are, and a windowed count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.screening import select_candidates


def screen_stream(chunks: DataFrame, **options) -> DataFrame:
    """A streaming chunks table -> candidates. Screening keeps no state, so the batch operator runs
    on a stream unchanged; any sink and output mode will do."""
    if not chunks.isStreaming:
        raise ValueError("chunks is not a stream")
    return select_candidates(chunks, **options)


def candidates_per_window(candidates: DataFrame, time: str = "arrived", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candidates by clause hint and time window; rows later than the watermark are left out."""
    hinted = candidates.withWatermark(time, late).select(F.window(time, length).alias("window"), F.explode("clause_hints").alias("clause_type"))
    return hinted.groupBy("window", "clause_type").agg(F.count("*").alias("candidates"))
