"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    whole = frame[sorted(frame.columns)].convert_dtypes()
    return sorted(tuple(map(cell, row)) for row in whole.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_locate_quotes_that_overlap(spark, tmp_path):
    passage = "the first of many words that stand in this passage é and on"
    items = [(1, passage), (2, passage[6:]), (3, passage[:9]), (4, passage[:30]), (5, None), (6, "not here"), (7, passage), (8, "on")]
    docs = [(1, "😀 " * 300 + passage), (2, passage * 2), (3, None), (4, ""), (5, passage[3:20])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    for name in ("benchmark", "documents"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    ours, theirs = entry.queries()["locate_quotes"](spark, f"file://{tmp_path}").toPandas(), connection.sql(entry.oracle_sql()["locate_quotes"]).df()
    assert len(theirs) > 10 and plain(ours) == plain(theirs)


def test_batch_candidates_is_whole(spark):
    """Every candidate that is left comes, also where these are more than a batch."""
    whole = SF.replace("0.001", "0.01")
    ((left,),) = duckdb.sql(f"SELECT count(*) FROM '{whole}/orders.parquet' WHERE o_orderkey % 3 <> 0").fetchall()
    rows = entry.queries()["batch_candidates"](spark, whole)
    assert rows.distinct().count() == rows.count() == left > 500
