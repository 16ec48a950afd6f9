"""Relational features that come with Spark, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.plans.inputs import read


def generic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


GENERIC_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def generic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.lag("o_orderkey").over(own).alias("before"), F.lead("o_orderkey", 2).over(own).alias("after"), F.ntile(3).over(own).alias("third"), F.max("o_totalprice").over(own.rowsBetween(-2, 0)).alias("top"))


GENERIC_WINDOWS = """
SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, CAST(ntile(3) OVER w AS INT) AS third,
  max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING) AS top
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""


def generic_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return rich.intersect(buyers).select("k", F.lit("buys").alias("kind")).union(rich.exceptAll(buyers.distinct()).select("k", F.lit("looks").alias("kind")))


GENERIC_SET_OPERATIONS = """
SELECT k, 'buys' AS kind FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT k, 'looks' FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders)
"""


def generic_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("started"), "event_type", "n")


GENERIC_TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def generic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("started"), "n")


GENERIC_SESSIONS = """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k
"""


def generic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region: a star join whose small sides Catalyst broadcasts by their size."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


GENERIC_JOIN = """
SELECT r_name, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
"""

QUERIES = {
    "generic_rollup": (generic_rollup, GENERIC_ROLLUP),
    "generic_windows": (generic_windows, GENERIC_WINDOWS),
    "generic_set_operations": (generic_set_operations, GENERIC_SET_OPERATIONS),
    "generic_tumbling": (generic_tumbling, GENERIC_TUMBLING),
    "generic_sessions": (generic_sessions, GENERIC_SESSIONS),
    "generic_join": (generic_join, GENERIC_JOIN),
}
