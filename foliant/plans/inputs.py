"""Inputs of the registered queries, derived from the tables at hand by expressions that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLE = r"<(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|conversations|labels)>"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables, whose names stand in angle brackets; DuckDB gets it by for_duckdb()."""
    names = set(re.findall(TABLE, sql))
    named = re.sub(TABLE, r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spread(spark.sql(named, **{n: read(spark, sf_dir, n) for n in names}))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in as many pieces at least as tasks can run at once: small files come as one, which one task would work on."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def for_duckdb(sql: str) -> str:
    return re.sub(TABLE, r"\1", sql).replace(" AS STRING)", " AS VARCHAR)")


#: Orders as jobs.
JOBS = """
SELECT CAST(o_orderkey AS STRING) AS job_id, concat('user', CAST(o_custkey AS STRING)) AS owner_username,
       lower(o_orderpriority) AS original_filename,
       CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END END AS status,
       CAST(o_orderdate AS STRING) AS created_at,
       CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate + INTERVAL '1' DAY AS STRING) END AS started_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN CAST(o_orderdate + INTERVAL '3' DAY AS STRING) END AS finished_at,
       CASE WHEN o_orderkey % 5 = 0 THEN 'it broke' END AS error_message,
       CAST(o_orderkey % 101 AS INT) AS progress_percent, 'page' AS progress_note,
       CAST(o_orderkey % 10 AS INT) AS progress_pages_done, 10 AS progress_pages_total,
       concat('{"pdf_vl_failed_pages":[', CAST(o_orderkey % 9 AS STRING), ',"', CAST(o_orderkey % 4 AS STRING), '","x"]}') AS result_extra
FROM <orders>
"""

#: Order lines as pipe tables, one an order: cells are text.
TABLE_ROWS = """
SELECT l_orderkey AS key, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, l_linestatus AS status,
       CAST(CAST(l_quantity AS INT) AS STRING) AS qty, CAST(l_partkey AS STRING) AS part
FROM <lineitem>
"""

#: Ragged pipe tables with a line of text before and after, by part: widths vary with the key.
RAGGED = """
SELECT p_partkey AS key,
       concat('intro ', p_name, chr(10),
              CASE WHEN p_partkey % 7 = 0 THEN '| one |' ELSE concat('| one | two ', chr(92), '| x | three |') END, chr(10),
              CASE WHEN p_partkey % 5 = 0 THEN '|--|---|---|' ELSE '|:---|---:|---|' END, chr(10),
              '| ', p_brand, ' | ', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'b | ' END, CASE WHEN p_partkey % 4 = 0 THEN 'c | d | e |' ELSE 'c |' END, chr(10),
              '| | ', CAST(p_size AS STRING), ' |', chr(10),
              CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'outro' END) AS md
FROM <part>
"""

#: Documents with tables of both kinds, by part.
MIXED = """
SELECT p_partkey AS key,
       concat('# ', p_name, chr(10), CASE WHEN p_partkey % 3 = 0 THEN '| single |' ELSE 'text' END, chr(10), chr(10),
              '| a | b |', chr(10), '| --- | --- |', chr(10), '| ', p_brand, ' | ', CAST(p_size AS STRING), ' |', chr(10),
              CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_type, chr(10)) END,
              '<TABLE border=1>', chr(10), '<tr><th colspan="', CAST(p_partkey % 4 AS STRING), '">h</th><td>x</td></tr><tr><td>1</td></tr>',
              CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(chr(10), '</table>') END, chr(10),
              '| t | u |', chr(10), '|---|---|') AS md
FROM <part>
"""

#: Markdown with image references, by part.
PICTURES = """
SELECT p_partkey AS key,
       concat('Intro ', p_name, chr(10), '![', p_brand, '](img/', CAST(p_partkey AS STRING), '.png) and ![](b', CAST(p_size AS STRING), '.jpg "t")', chr(10),
              CASE WHEN p_partkey % 3 = 0 THEN concat('图 ', CAST(p_size AS STRING), '.1-2 view', chr(10)) ELSE concat('line', chr(10), chr(10)) END,
              '| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10),
              CASE WHEN p_partkey % 2 = 0 THEN 'tail ![alt text](http://x.org/a b.png)' ELSE concat('![c](c.png)', chr(10), '图 A3 end [[position: 左上]]') END) AS md
FROM <part>
"""
