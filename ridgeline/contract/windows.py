"""Windowed semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.contract.base import DAY, Tables, day, query, rounded
from ridgeline.operators import quant


@query("""
WITH c AS (SELECT l_partkey % 20 AS utr, l_partkey AS row_id, l_suppkey AS cell, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT utr, row_id, cell, round(v / sum(v) OVER (PARTITION BY utr, cell), 6) AS psi FROM c
""")
def psi(t: Tables):
    c = t.lineitem.groupBy((F.col("l_partkey") % 20).alias("utr"), F.col("l_partkey").alias("row_id"), F.col("l_suppkey").alias("cell")).agg(F.sum("l_quantity").alias("v"))
    return quant.psi(c, "utr", "row_id", "cell", "v").select("utr", "row_id", "cell", rounded("psi").alias("psi"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def tally_window(t: Tables):
    return t.events.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")).alias("n"))


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, n, round(100.0 * n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS pct FROM n")
def pct_of_group(t: Tables):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("c_nationkey"))))


@query("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - count(*) OVER (PARTITION BY p_brand) // 2)::BIGINT AS pos FROM part")
def centered_row_index(t: Tables):
    w = Window.partitionBy("p_brand")
    pos = F.row_number().over(w.orderBy("p_partkey")) - F.floor(F.count(F.lit(1)).over(w) / 2)
    return t.part.select("p_brand", "p_partkey", pos.cast("long").alias("pos"))


@query(f"""
WITH g AS (SELECT o_custkey % 200 AS gene, o_custkey AS iso, min({DAY}) AS st, max({DAY}) + 30 AS en FROM orders GROUP BY 1, 2)
SELECT gene, iso, row_number() OVER (PARTITION BY gene ORDER BY st, en, iso)::INT AS idx FROM g
""")
def rank_isoforms(t: Tables):
    g = t.orders.groupBy((F.col("o_custkey") % 200).alias("gene"), F.col("o_custkey").alias("iso")).agg(F.min(day()).alias("st"), (F.max(day()) + 30).alias("en"))
    return g.select("gene", "iso", F.row_number().over(Window.partitionBy("gene").orderBy("st", "en", "iso")).alias("idx"))
