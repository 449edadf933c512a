"""A contract portfolio derived from orders, customers and nations, in SQL that Spark and DuckDB share.

A customer is a contract, an order is a page of it; each page has one clause whose wording follows
from the order. Findings cite these clauses; some are spoiled, by the order's number, so that every
reason of the citation gate occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = """
SELECT doc_id, page_no, party, nation, k, days, standard, clause_type, clause_text,
  CASE WHEN page_no = 1 THEN 'Master supply agreement with ' || party || chr(10) || chr(10) ELSE '' END
    || clause_text || chr(10) || chr(10) || 'Sheet ' || CAST(k AS STRING) || ' is kept with the signed copy of ' || party || '.' AS page_text
FROM (
  SELECT *,
    CASE k % 8 WHEN 0 THEN 'change_of_control' WHEN 1 THEN 'anti_assignment' WHEN 2 THEN 'mfn' WHEN 3 THEN 'indemnity_cap'
      WHEN 4 THEN 'auto_renewal' WHEN 5 THEN 'termination_convenience' WHEN 6 THEN 'exclusivity' ELSE 'governing_law' END AS clause_type,
    CASE k % 8
      WHEN 0 THEN 'Upon a change of control of ' || party || ', notice of not less than ' || days_text || ' shall be given.'
      WHEN 1 THEN 'This agreement shall not be assigned without prior written consent, ' || standard || '.'
      WHEN 2 THEN 'The customer shall have most favored customer pricing and no less favorable terms.'
      WHEN 3 THEN CASE WHEN k % 40 = 3 THEN 'There is unlimited liability for breach of secrecy.'
        ELSE 'Total aggregate liability shall not exceed the fees of the preceding year.' END
      WHEN 4 THEN 'This agreement shall automatically renew for successive one year terms unless either party gives notice ' || days_text || ' before expiry.'
      WHEN 5 THEN CASE WHEN k % 7 = 0 THEN 'The supplier' ELSE 'Either party' END || ' may terminate this agreement for convenience upon not less than ' || days_text || ' notice.'
      WHEN 6 THEN 'The supplier is the exclusive distributor ' || CASE WHEN k % 47 = 0 THEN 'worldwide' ELSE 'in ' || nation END || ' for one (1) year.'
      ELSE 'This agreement shall be governed by the laws of ' || nation || '.' END AS clause_text
  FROM (
    SELECT 'C' || CAST(o_custkey AS STRING) AS doc_id, c_name AS party, n_name AS nation, o_orderkey AS k,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_no,
      CASE o_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 60 ELSE 90 END AS days,
      CASE o_orderkey % 3 WHEN 0 THEN 'thirty (30) days' WHEN 1 THEN 'sixty (60) days' ELSE 'ninety (90) days' END AS days_text,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'given at its sole discretion' WHEN '2' THEN 'not to be unreasonably withheld'
        WHEN '3' THEN 'withheld for any reason' WHEN '4' THEN 'not unreasonably delayed' ELSE 'given in writing' END AS standard
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  ) AS base
) AS worded
"""

# Quotes as the documents hold them, then the spoiled rows.
FINDINGS = """
SELECT 'find-' || substr(sha1(doc_id || '|' || CAST(k AS STRING)), 1, 16) AS finding_id, 'cand-' || CAST(k AS STRING) AS candidate_id, k,
  CASE WHEN k % 50 = 4 THEN 'X' || doc_id ELSE doc_id END AS doc_id, 'Agreement of ' || party AS doc_title, clause_type,
  CAST(CASE WHEN k % 50 = 3 THEN page_no + 1 ELSE page_no END AS INT) AS page,
  CAST(CASE WHEN k % 50 = 1 THEN s + 3 ELSE s END AS INT) AS char_start,
  CAST(CASE k % 50 WHEN 1 THEN s + length(clause_text) + 3 WHEN 6 THEN s + 100000000 WHEN 7 THEN s ELSE s + length(clause_text) END AS INT) AS char_end,
  CASE k % 50 WHEN 2 THEN upper(clause_text) WHEN 5 THEN ' ' WHEN 8 THEN repeat(clause_text, 10)
    WHEN 10 THEN replace(clause_text, ' ', '  ') ELSE clause_text END AS quote,
  CASE WHEN k % 13 = 0 THEN '=SUM of ' || party ELSE 'Clause ' || CAST(k AS STRING) || ' of ' || party END AS summary,
  CASE k % 8
    WHEN 0 THEN '{{"consent_required": ' || CASE WHEN k % 5 < 2 THEN 'true' ELSE 'false' END || ', "termination_right": ' || CASE WHEN k % 5 = 4 THEN '"yes"' ELSE '""' END
      || CASE WHEN k % 5 = 2 THEN ', "notice_days": ' || CAST(days AS STRING) ELSE ', "notice_days": null' END || '}}'
    WHEN 1 THEN '{{"assignment_barred": ' || CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END || ', "consent_required": ' || CASE WHEN k % 5 = 3 THEN 'false' ELSE 'true' END
      || ', "consent_standard": "' || standard || '", "exceptions": "' || CASE WHEN k % 10 = 5 THEN 'affiliates' ELSE '' END || '"}}'
    WHEN 3 THEN '{{"uncapped": ' || CASE WHEN k % 40 = 3 THEN 'true' ELSE 'false' END || '}}'
    ELSE '{{"scope": "all", "note": null}}' END AS terms_json,
  CAST(k % 10 AS DOUBLE) / 10 AS confidence, k % 50 <> 9 AS validated, page_no AS true_page, party, nation, days, standard
FROM (
  SELECT *, coalesce(CAST(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)
    + instr(page_text, clause_text) - 1 AS s
  FROM {pages} AS pages
) AS placed
"""

#: What the gate says of each spoiled row, in SQL over FINDINGS.
REASON = """CASE k % 50 WHEN 4 THEN 'missing_fulltext' WHEN 5 THEN 'empty_quote' WHEN 8 THEN 'quote_too_long' WHEN 7 THEN 'invalid_offsets'
  WHEN 6 THEN 'offsets_past_end_of_document' WHEN 1 THEN 'quote_mismatch' WHEN 2 THEN 'quote_mismatch' END"""


def sql_pages() -> str:
    return PAGES.format(orders="orders", customer="customer", nation="nation")


def sql_findings() -> str:
    return FINDINGS.format(pages=f"({sql_pages()})")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with what they were made from; doc_id, page_no and page_text are the pages table."""
    return spark.sql(PAGES, **_tables(spark, sf_dir))


def contract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as extraction would leave them, with the columns they were made from."""
    rows = spark.sql(FINDINGS, pages=contract_pages(spark, sf_dir))
    return rows.withColumn("terms", F.from_json("terms_json", "map<string,string>")).withColumn("severity", F.lit(None).cast("string"))
