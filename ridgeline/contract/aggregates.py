"""Aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.contract.base import SECONDS, Tables, query, rounded, seconds
from ridgeline.operators import quant, reads

TYPES = ["click", "error", "purchase", "signup", "view"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT event_type, user_id % 10 AS cell, count(DISTINCT CAST(floor(value) AS BIGINT)) AS n FROM events GROUP BY 1, 2")
def umi_count_distinct(t: Tables):
    hits = t.events.select("event_type", (F.col("user_id") % 10).alias("cell"), F.floor("value").alias("umi"))
    return quant.molecule_counts(hits, ["event_type"], ["cell"], "umi")


@query("SELECT event_type, count(DISTINCT event_id) AS n_names, count(*) AS n_records FROM events GROUP BY event_type")
def bulk_count(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("event_id").alias("n_names"), F.count(F.lit(1)).alias("n_records"))


def _pick(order: str, key: str) -> str:
    return f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM events) SELECT {key}, event_id FROM r WHERE rn = 1"


@query(_pick("ts, event_id", "user_id, event_type"))
def first_per_key(t: Tables):
    return reads.first_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(_pick("ts DESC, event_id DESC", "user_id, event_type"))
def last_per_key(t: Tables):
    rows = t.events.select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return reads.last_per_key(rows, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


@query("WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS umi FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, umi ORDER BY ts, event_id) AS rn FROM e) SELECT user_id, umi, event_id FROM r WHERE rn = 1")
def umi_dedup_first(t: Tables):
    return reads.deduplicated(t.events.withColumn("umi", F.floor("value")), ["user_id"], "umi", ["ts", "event_id"]).select("user_id", "umi", "event_id")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY p_brand")
def group_collect_set(t: Tables):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"))


@query("""
WITH i AS (SELECT p_brand, p_type, string_agg(p_partkey::VARCHAR, '+' ORDER BY p_partkey) AS parts FROM part GROUP BY 1, 2)
SELECT p_brand, string_agg(p_type || '=' || parts, ';' ORDER BY p_type) AS nested FROM i GROUP BY p_brand
""")
def nested_collect(t: Tables):
    inner = t.part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    text = F.concat_ws("=", "p_type", F.array_join(F.transform("parts", lambda x: x.cast("string")), "+"))
    return inner.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("nested"))


@query("SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN min(o_totalprice) ELSE max(o_totalprice) END AS tss FROM orders GROUP BY o_custkey")
def strand_min_max(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return g.select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("tss"))


@query("""
WITH x AS (SELECT user_id, event_type AS v FROM events UNION SELECT doc_id, 'q' || quality FROM labels)
SELECT user_id, string_agg(DISTINCT v, ',' ORDER BY v) AS ids FROM x GROUP BY user_id
""")
def collect_set_join(t: Tables):
    one = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    two = t.labels.groupBy(F.col("doc_id").alias("user_id")).agg(F.collect_set(F.concat(F.lit("q"), F.col("quality"))).alias("b"))
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("a", none), F.coalesce("b", none))
    return one.join(two, "user_id", "full").select("user_id", F.array_join(F.array_sort(both), ",").alias("ids"))


@query(f"SELECT event_type, ({SECONDS} // 86400) % 50 AS pos, count(*) AS n FROM events GROUP BY 1, 2")
def position_histogram(t: Tables):
    return t.events.groupBy("event_type", (F.floor(seconds() / 86400) % 50).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 600")
def having_sum_min(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("total")).filter("total > 600")


@query("SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END)::BIGINT AS \"{k}\"" for k in TYPES) + " FROM events GROUP BY user_id")
def pivot_wide(t: Tables):
    return quant.wide(t.events, ["user_id"], "event_type", TYPES, F.count(F.lit(1)))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS psi FROM c)
SELECT user_id, """ + ", ".join(f"coalesce(round(max(CASE WHEN event_type = '{k}' THEN psi END), 6), 0) AS \"{k}\"" for k in TYPES) + " FROM p GROUP BY user_id")
def pivot_wide_psi(t: Tables):
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("psi", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return quant.wide(p, ["user_id"], "event_type", TYPES, F.first(rounded("psi")), 0.0)


@query("""
SELECT l_returnflag, l_linestatus, """ + ", ".join(f"coalesce(round(avg(CASE WHEN p_type = '{k}' THEN l_quantity END), 6), 0) AS \"{k}\"" for k in PART_TYPES) + """
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def pivot_mean_multi(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return quant.wide(rows, ["l_returnflag", "l_linestatus"], "p_type", PART_TYPES, rounded(F.avg("l_quantity")), 0.0)


@query("SELECT p_partkey, 'size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot_long(t: Tables):
    return quant.long(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"], "variable", "value")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY event_type")
def freq_pct(t: Tables):
    total = t.events.agg(F.count(F.lit(1))).scalar()
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", "n", rounded(100.0 * F.col("n") / total).alias("pct"))


@query("WITH s AS (SELECT o_custkey, count(*) AS n_sites FROM orders GROUP BY 1) SELECT n_sites, count(*) AS n FROM s GROUP BY n_sites")
def list_len_dist(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_sites")).groupBy("n_sites").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'row' AS axis, l_partkey AS k, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'col', l_suppkey, sum(l_quantity) FROM lineitem GROUP BY l_suppkey")
def row_col_sums(t: Tables):
    side = lambda name, c: t.lineitem.groupBy(F.col(c).alias("k")).agg(F.sum("l_quantity").alias("total")).select(F.lit(name).alias("axis"), "k", "total")
    return side("row", "l_partkey").unionByName(side("col", "l_suppkey"))


@query("SELECT event_type, round(median(value), 6) AS med FROM events GROUP BY event_type")
def median_by_group(t: Tables):
    return t.events.groupBy("event_type").agg(rounded(F.median("value")).alias("med"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag")
def mean_sd(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(rounded(F.avg("l_extendedprice"), 4).alias("mean"), rounded(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query("SELECT event_type, CASE WHEN value > 50 THEN 'Up' ELSE 'Down' END AS direction, CASE WHEN value > 50 THEN count(*) ELSE -count(*) END AS n FROM events GROUP BY event_type, value > 50")
def signed_counts(t: Tables):
    up = F.col("value") > 50
    n = t.events.groupBy("event_type", F.when(up, "Up").otherwise("Down").alias("direction")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", "direction", F.when(F.col("direction") == "Up", F.col("n")).otherwise(-F.col("n")).alias("n"))


@query("WITH u AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, CAST(pos - 33 AS INT) AS relpos, round(avg(v), 6) AS avg_signal FROM u GROUP BY label, pos")
def avg_profile(t: Tables):
    u = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    return u.groupBy("label", (F.col("pos") - 32).cast("int").alias("relpos")).agg(rounded(F.avg("v")).alias("avg_signal"))


@query("SELECT d.lang, round(avg(CASE WHEN (d.n_chars > 1000) = (l.quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def accuracy_metric(t: Tables):
    hit = (F.col("n_chars") > 1000) == (F.col("quality") == 1)
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id").groupBy("lang").agg(rounded(F.avg(hit.cast("double"))).alias("accuracy"))
