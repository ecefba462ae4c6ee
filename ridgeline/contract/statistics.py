"""Correlation, rank tests, normalisation, posteriors, neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.contract.base import DAY, Tables, day, query, rounded
from ridgeline.functions import numeric
from ridgeline.operators import intervals, quant

R = "round((covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 6)"


@query("""
WITH v AS (SELECT l_partkey AS row_id, l_suppkey % 50 AS cell, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_partkey <= a.p_partkey + 100),
c AS (SELECT range AS cell FROM range(50)),
g AS (SELECT p.a, p.b, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y FROM p CROSS JOIN c LEFT JOIN v x ON x.row_id = p.a AND x.cell = c.cell LEFT JOIN v y ON y.row_id = p.b AND y.cell = c.cell)
SELECT a, b, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS r FROM g GROUP BY a, b
""")
def pair_correlation(t: Tables):
    """Every pair of neighbours (at most 100 apart in one group), over all cells, absent ones as 0, without making the dense vectors."""
    v = t.lineitem.groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_suppkey") % 50).alias("cell")).agg(F.sum("l_quantity").alias("v"))
    side = lambda k: t.part.select("p_brand", F.col("p_partkey").alias(k))
    pairs = intervals.band_join(side("a"), side("b"), ["p_brand"], 100, "a", "b").filter("a < b").select("a", "b")
    return quant.sparse_correlation(v, pairs, "row_id", "cell", "v", 50).select("a", "b", rounded("r").alias("r"))


@query(f"WITH g AS (SELECT l_returnflag AS grp, l_suppkey % 10 AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT grp, k, count(*) AS n, {R} AS r FROM g GROUP BY grp, k")
def group_correlation(t: Tables):
    g = t.lineitem.select(F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 10).alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return quant.correlation(g, ["grp", "k"], "x", "y").withColumn("r", rounded("r"))


RANKED = "rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0"


@query(f"""
WITH g AS (SELECT p_brand, p_partkey, {RANKED.format(g='p_brand', v='p_size')} AS x, {RANKED.format(g='p_brand', v='p_retailprice')} AS y FROM part)
SELECT p_brand, {R} AS rho FROM g GROUP BY p_brand
""")
def spearman_rank(t: Tables):
    rank = lambda v: quant.average_rank(t.part, ["p_brand"], v)
    return quant.correlation(t.part.select("p_brand", rank("p_size").alias("x"), rank("p_retailprice").alias("y")), ["p_brand"], "x", "y").select("p_brand", rounded("r").alias("rho"))


RANK_SUM = f"""
WITH g AS (SELECT event_type AS k, user_id % 2 = 0 AS one, value AS v FROM events),
r AS (SELECT *, {RANKED.format(g='k', v='v')} AS rk, count(*) OVER (PARTITION BY k, v) AS ties FROM g),
s AS (SELECT k, sum(one::INT)::BIGINT AS n1, sum((NOT one)::INT)::BIGINT AS n2, sum(CASE WHEN one THEN rk ELSE 0 END) AS rs, sum(ties::DOUBLE * ties - 1) AS tt FROM r GROUP BY k),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS u FROM s)
"""


def _rank_sum(t: Tables):
    return quant.rank_sum(t.events.select(F.col("event_type").alias("k"), "user_id", F.col("value").alias("v")), ["k"], F.col("user_id") % 2 == 0, "v")


@query(RANK_SUM + "SELECT k, n1, n2, round(u, 6) AS u, round((u - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u")
def ranksum_markers(t: Tables):
    return _rank_sum(t).select("k", "n1", "n2", rounded("u").alias("u"), rounded("z").alias("z"))


@query(RANK_SUM + "SELECT k, round(u / (n1 * n2), 6) AS auc FROM u")
def rank_auc(t: Tables):
    return _rank_sum(t).select("k", rounded("auc").alias("auc"))


EXPRESSED = "WITH v AS (SELECT l_partkey AS gene, l_suppkey AS cell, l_suppkey % 2 AS grp, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT s_suppkey % 2 AS grp, count(*)::DOUBLE AS n FROM supplier GROUP BY 1)"


def _expressed(t: Tables):
    return t.lineitem.groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell"), (F.col("l_suppkey") % 2).alias("grp")).agg(F.sum("l_quantity").alias("v"))


def _cells(t: Tables):
    return F.broadcast(t.supplier.groupBy((F.col("s_suppkey") % 2).alias("grp")).agg(F.count(F.lit(1)).alias("cells")))  # two rows


@query(EXPRESSED + " SELECT gene, grp, round(count(*) / max(c.n), 6) AS pct FROM v JOIN c USING (grp) GROUP BY gene, grp")
def pct_expressed(t: Tables):
    return _expressed(t).join(_cells(t), "grp").groupBy("gene", "grp").agg(rounded(F.count(F.lit(1)) / F.max("cells")).alias("pct"))


@query(EXPRESSED + ", m AS (SELECT gene, grp, sum(v) / max(c.n) AS m FROM v JOIN c USING (grp) GROUP BY gene, grp) SELECT gene, round(ln(coalesce(max(CASE WHEN grp = 1 THEN m END), 0) + 1) - ln(coalesce(max(CASE WHEN grp = 0 THEN m END), 0) + 1), 6) AS log_fc FROM m GROUP BY gene")
def log_fold_change(t: Tables):
    m = _expressed(t).join(_cells(t), "grp").groupBy("gene", "grp").agg((F.sum("v") / F.max("cells")).alias("m"))
    of = lambda g: F.log1p(F.coalesce(F.max(F.when(F.col("grp") == g, F.col("m"))), F.lit(0.0)))
    return m.groupBy("gene").agg(rounded(of(1) - of(0)).alias("log_fc"))


@query(EXPRESSED + " SELECT gene, cell, round(ln(1 + v / sum(v) OVER (PARTITION BY cell) * 10000), 6) AS norm FROM v")
def log_normalise(t: Tables):
    return _expressed(t).select("gene", "cell", rounded(F.log1p(F.col("v") / F.sum("v").over(Window.partitionBy("cell")) * 10_000)).alias("norm"))


@query(EXPRESSED + " SELECT gene, cell, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) AS z FROM v WINDOW w AS (PARTITION BY gene)")
def zscore_rows(t: Tables):
    w = Window.partitionBy("gene")
    return _expressed(t).select("gene", "cell", rounded(F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_samp("v").over(w))).alias("z"))


@query("SELECT l_suppkey, round(100 * sum(CASE WHEN contains(p_name, '1') THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def pct_feature(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_suppkey").agg(rounded(100 * F.sum(F.when(F.col("p_name").rlike("1"), F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")).alias("pct"))


@query("""
WITH v AS (SELECT l_partkey AS gene, l_suppkey % 5 AS tissue, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), m AS (SELECT gene, max(x) AS mx, sum(x) AS sx FROM v GROUP BY gene)
SELECT gene, round((5 - sx / mx) / 4.0, 6) AS tau FROM m
""")
def tau_specificity(t: Tables):
    v = t.lineitem.groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 5).alias("tissue")).agg(F.sum("l_quantity").alias("x"))
    return v.groupBy("gene").agg(rounded((5 - F.sum("x") / F.max("x")) / 4).alias("tau"))


@query("SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value < 100 GROUP BY 1, 2")
def binned_histogram(t: Tables):
    return t.events.filter("value < 100").groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, vec_id, round(list_sum(embedding) / 64, 6) AS mean_signal, round(embedding[1]::DOUBLE, 6) AS at_start, round(coalesce(embedding[200], 0)::DOUBLE, 6) AS beyond FROM embeddings")
def window_feature_vector(t: Tables):
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x) / 64
    return t.embeddings.select("label", "vec_id", rounded(mean).alias("mean_signal"), rounded(F.get("embedding", F.lit(0)).cast("double")).alias("at_start"), rounded(F.coalesce(F.get("embedding", F.lit(199)), F.lit(0)).cast("double")).alias("beyond"))


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 50 <> 0),
d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, r.label, round(list_sum([(q.embedding[i] - r.embedding[i]) ** 2 for i in generate_series(1, 64)]), 6) AS d FROM q CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rn FROM d), v AS (SELECT qid, label, count(*) AS n FROM k WHERE rn <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS rn FROM v)
SELECT qid AS vec_id, label AS predicted FROM b WHERE rn = 1
""")
def knn_predict(t: Tables):
    """Exact vote of the five nearest; the stated query set is sent to all rows in blocks."""
    from ridgeline.plans.classify import nearest_votes

    e = t.embeddings
    return nearest_votes(e.filter("vec_id % 50 = 0").select("vec_id", "embedding"), e.filter("vec_id % 50 <> 0"), 5)


@query(f"""
WITH f AS (SELECT o_custkey AS frag, o_orderkey AS iso, 250 + ({DAY} % 300) AS len FROM orders),
p AS (SELECT *, exp(-0.5 * ((len - 300) / 50.0) ** 2) / (50 * sqrt(2 * pi())) AS p FROM f)
SELECT frag, iso, round(p / sum(p) OVER (PARTITION BY frag), 6) AS post FROM p
""")
def posterior_normalise(t: Tables):
    p = numeric.normal_pdf((F.lit(250) + day() % 300).cast("double"), 300, 50)
    f = t.orders.select(F.col("o_custkey").alias("frag"), F.col("o_orderkey").alias("iso"), p.alias("p"))
    return f.select("frag", "iso", rounded(F.try_divide("p", F.sum("p").over(Window.partitionBy("frag")))).alias("post"))


@query(f"""
WITH f AS (SELECT o_custkey AS frag, o_orderkey AS iso, {DAY} % 300 AS len FROM orders), m AS (SELECT *, max(len) OVER (PARTITION BY frag) AS mx, count(*) OVER (PARTITION BY frag) AS n FROM f)
SELECT frag, iso, round(1.0 / n, 6) AS w FROM m WHERE mx < 280
""")
def equal_split_short(t: Tables):
    w = Window.partitionBy("frag")
    f = t.orders.select(F.col("o_custkey").alias("frag"), F.col("o_orderkey").alias("iso"), (day() % 300).alias("len"))
    return f.select("frag", "iso", F.max("len").over(w).alias("mx"), rounded(1 / F.count(F.lit(1)).over(w)).alias("w")).filter("mx < 280").drop("mx")


@query("SELECT a.conv_id, a.turn, length(a.text) + length(b.text) AS frag_len FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND length(a.text) + length(b.text) < 1000")
def fragment_length(t: Tables):
    one = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("a"))
    two = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("b"))
    return one.join(two, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("a") + F.col("b")).cast("long").alias("frag_len")).filter("frag_len < 1000")
