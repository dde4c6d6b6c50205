"""Derived corpora over the driver's tables: the same SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CIRCULARS = """
SELECT o_orderkey AS doc_ord, 'D' || o_orderkey AS doc_id, 'Circular on case ' || o_orderkey AS title, o_orderpriority AS section_path,
 'TC-I/' || year(o_orderdate) || '/' || o_orderkey AS document_number, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_parsed
FROM orders
"""
CHUNKS = """
SELECT 'D' || l_orderkey || '::chunk' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1) AS chunk_id,
 'D' || l_orderkey AS doc_id, CASE WHEN l_linenumber % 4 = 0 THEN (l_linenumber - 1) || '.1' ELSE '' || l_linenumber END AS clause_ref,
 CASE WHEN l_orderkey % 50 = 0 THEN 'superseded' END AS status, CAST(NULL AS STRING) AS status_note
FROM lineitem
"""
REFS = """
SELECT o_orderkey * 2 AS ref_ord, 'D' || o_orderkey AS doc_id,
 CASE o_orderkey % 5 WHEN 0 THEN 'supersession' WHEN 1 THEN 'partial_modification' WHEN 2 THEN 'modification' WHEN 3 THEN 'supersession' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'amendment' ELSE 'continuation' END END AS relation,
 CASE WHEN o_orderkey % 13 = 0 THEN 'Unindexed/1999/' || o_orderkey WHEN o_orderkey % 17 = 0 THEN 'TC-I/' || year(o_orderdate) || '/' || o_orderkey ELSE 'tc-i ' || year(lag(o_orderdate) OVER c) || '.' || lag(o_orderkey) OVER c END AS referenced_number,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '' || (o_orderkey % 7 + 1) END AS referenced_clause
FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
UNION ALL
SELECT o_orderkey * 2 + 1, 'D' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'supersession' ELSE 'amendment' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'TC-I/' || year(lead(o_orderdate) OVER c) || '/' || lead(o_orderkey) OVER c WHEN o_orderkey % 7 < 4 THEN 'TC-I/' || year(lag(o_orderdate, 2) OVER c) || '/' || lag(o_orderkey, 2) OVER c END,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '(' || (o_orderkey % 5 + 1) || ')' END
FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""
LETTERS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'A note without a head. ' ELSE 'Government of Somewhere. ' ||
 CASE o_orderkey % 3 WHEN 0 THEN 'No. ' WHEN 1 THEN 'F.No. ' ELSE 'N o.' END || 'TC-I/' || year(o_orderdate) || '/' || o_orderkey || '. New Delhi, ' ||
 CASE o_orderkey % 4 WHEN 0 THEN 'dated ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) WHEN 1 THEN 'dt.' || day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
  WHEN 2 THEN 'Dated: ' || day(o_orderdate) || 'th ' || CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'February' WHEN 3 THEN 'Mar' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' ELSE 'December' END || ' ' || year(o_orderdate)
  ELSE 'on 35.13.' || year(o_orderdate) END || '. ' END ||
 CASE o_orderkey % 5 WHEN 0 THEN 'In supersession of Commercial Circular No. ' || (o_orderkey % 90 + 1) || ' of 2018 dated 01.01.2018. It holds.' WHEN 1 THEN 'In partial modification of Clause ' || (o_orderkey % 9) || '.2 of Circular No.45/2019 dated 12-06-2019, as said.'
  WHEN 2 THEN 'This amends the fare structure notified earlier. Nothing else.' WHEN 3 THEN 'In continuation of letter no. TC-II/2020/' || o_orderkey || ' dated 3rd March 2020 and in modification of Circular 9/2017.' ELSE 'It clarifies the refund policy.' END AS text
FROM orders
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over the named tables."""
    text = sql
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables})
