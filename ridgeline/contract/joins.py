"""Equi joins, semi joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.contract.base import Tables, query, rounded
from ridgeline.operators import reads
from ridgeline.plans import simulate


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, o.o_totalprice FROM lineitem l JOIN orders o
ON l.l_orderkey = o.o_orderkey AND l.l_quantity >= 10 AND l.l_extendedprice < o.o_totalprice
""")
def equi_plus_range_join(t: Tables):
    l = t.lineitem.filter("l_quantity >= 10")  # noqa: E741
    return l.join(t.orders, (l.l_orderkey == F.col("o_orderkey")) & (F.col("l_extendedprice") < F.col("o_totalprice"))).select("l_orderkey", "l_linenumber", "l_suppkey", "o_totalprice")


@query("""
WITH b AS (SELECT s_suppkey, 5 + s_suppkey % 10 AS lo, 40 + s_suppkey % 10 AS hi FROM supplier)
SELECT l_orderkey, count(*) AS n_parts FROM lineitem JOIN b ON l_suppkey = s_suppkey
GROUP BY l_orderkey HAVING count(*) = sum(CASE WHEN l_quantity BETWEEN lo AND hi THEN 1 ELSE 0 END)
""")
def relational_division(t: Tables):
    """Orders all of whose lines lie within their supplier's bounds."""
    b = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.lit(5) + F.col("s_suppkey") % 10).alias("lo"), (F.lit(40) + F.col("s_suppkey") % 10).alias("hi"))
    hit = F.when((F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") <= F.col("hi")), 1).otherwise(0)
    return t.lineitem.join(b, "l_suppkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(hit).alias("n_hit")).filter("n_parts = n_hit").drop("n_hit")


MATES = "SELECT a.conv_id, a.turn, length(a.text) AS len_1, length(b.text) AS len_2 FROM conversations a {} JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'"


def _mates(t: Tables, how: str):
    one = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("len_1"))
    two = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("len_2"))
    return one.join(two, ["conv_id", "turn"], how)


@query(MATES.format(""))
def mate_pair_inner(t: Tables):
    return _mates(t, "inner").select("conv_id", "turn", "len_1", "len_2")


@query(f"SELECT conv_id, turn, least(len_1, coalesce(len_2, len_1)) AS frag_start, greatest(len_1, coalesce(len_2, len_1)) AS frag_end FROM ({MATES.format('LEFT')})")
def mate_merge_left(t: Tables):
    return _mates(t, "left").select("conv_id", "turn", F.least("len_1", "len_2").alias("frag_start"), F.greatest("len_1", "len_2").alias("frag_end"))


@query("""
WITH a AS (SELECT user_id, event_id % 100 AS iso FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id % 100 AS iso FROM events WHERE event_type = 'view')
SELECT user_id, CAST(iso AS BIGINT) AS iso FROM a INTERSECT SELECT user_id, CAST(iso AS BIGINT) FROM b
""")
def array_intersect_explode(t: Tables):
    side = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.collect_set(F.col("event_id") % 100).alias(kind))
    return side("click").join(side("view"), "user_id").select("user_id", F.explode(F.array_intersect("click", "view")).alias("iso"))


@query("""
SELECT p_partkey AS name, round(p_retailprice - l_extendedprice / l_quantity, 6) AS distance FROM part JOIN lineitem ON l_partkey = p_partkey
""")
def truth_distance(t: Tables):
    """Every part's price against each price it was sold at."""
    truth = t.part.select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("site"))
    found = t.lineitem.select(F.col("l_partkey").alias("name"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("site"))
    return simulate.distances(truth, found).withColumn("distance", rounded("distance"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def name_semi_join(t: Tables):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_whitelist(t: Tables):
    return t.events.join(t.labels.filter("quality = 1").select(F.col("doc_id").alias("user_id")), "user_id", "left_semi").select("event_id", "user_id")


#: Rows of one task where sums of many keys are held.
ROWS_A_TASK = 500_000


@query("""
SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 700)
GROUP BY l_partkey, l_suppkey
""")
def having_semi_join(t: Tables):
    """Tasks of about ROWS_A_TASK rows, however many there are: rows are dealt by part once, for the sums of both kinds."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity").filter("l_partkey IS NOT NULL")
    dealt = rows.repartition(max(1, -(-t.lineitem.count() // ROWS_A_TASK)), "l_partkey")
    v = dealt.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return v.withColumn("whole", F.sum("v").over(Window.partitionBy("l_partkey"))).filter("whole > 700").drop("whole")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_join_rename(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_align(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("""
WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS qa FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey AS k, sum(l_quantity) AS qr FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k, qa, qr FROM a JOIN r USING (k)
""")
def inner_join_align(t: Tables):
    side = lambda f, n: t.lineitem.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(n))
    return side("A", "qa").join(side("R", "qr"), "k")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_update(t: Tables):
    new = F.when(F.col("toxic") == 1, "flagged").otherwise(F.col("source"))
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", new.alias("source"))


@query("""
WITH z AS (SELECT c_custkey, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS n_nationkey, unnest(['home', 'next']) AS kind FROM customer)
SELECT c_custkey, kind, n_name FROM z JOIN nation USING (n_nationkey)
""")
def zip_explode_lookup(t: Tables):
    zipped = F.arrays_zip(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25).alias("n"), F.array(F.lit("home"), F.lit("next")).alias("kind"))
    z = t.customer.select("c_custkey", F.explode(zipped).alias("z")).select("c_custkey", F.col("z.n").alias("n_nationkey"), F.col("z.kind").alias("kind"))
    return z.join(t.nation, "n_nationkey").select("c_custkey", "kind", "n_name")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON 'chr' || c.c_nationkey = 'chr' || n.n_nationkey")
def key_normalise_join(t: Tables):
    """Names with and without a prefix meet after the prefix is taken off both sides."""
    plain = lambda c: F.when(c.startswith("chr"), F.substring(c, 4, 1000)).otherwise(c)
    left = t.customer.select("c_custkey", plain(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string"))).alias("k"))
    return left.join(t.nation.select("n_name", plain(F.col("n_nationkey").cast("string")).alias("k")), "k").select("c_custkey", "n_name")


@query("""
WITH x AS (SELECT c.c_nationkey % 5 AS win, n.n_regionkey AS gene, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0 GROUP BY 1, 2)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey % 97 IN (SELECT o_custkey % 97 FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3)
""")
def unique_owner_having(t: Tables):
    """Rows of windows with exactly so many owners."""
    wins = t.orders.groupBy((F.col("o_custkey") % 97).alias("w")).agg(F.count_distinct("o_orderstatus").alias("n")).filter("n = 3")
    return t.customer.withColumn("w", F.col("c_custkey") % 97).join(wins, "w", "left_semi").select("c_custkey")


@query("SELECT DISTINCT c_nationkey AS k, c_mktsegment AS seg FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def dedup_semi(t: Tables):
    known = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).distinct().join(known, "k", "left_semi")


@query("SELECT e.event_id, l.quality AS grp FROM events e JOIN labels l ON e.user_id = l.doc_id")
def group_filter_join(t: Tables):
    return t.events.join(t.labels.select(F.col("doc_id").alias("user_id"), F.col("quality").alias("grp")), "user_id").select("event_id", "grp")


@query("SELECT l_partkey, l_suppkey, l_quantity AS v FROM lineitem WHERE l_quantity > 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def triples_scan_filtered(t: Tables):
    cells = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.select("l_partkey", "l_suppkey", F.col("l_quantity").alias("v")).filter("v > 0").join(cells, "l_suppkey", "left_semi")


@query("SELECT c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_all(t: Tables):
    return t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SELECT 'events' AS label, event_id AS id FROM events UNION ALL SELECT 'orders', o_orderkey FROM orders")
def union_with_label(t: Tables):
    """The label is a file's base name."""
    side = lambda df, c: df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet", 1).alias("label"), F.col(c).alias("id"))
    return side(t.events, "event_id").unionByName(side(t.orders, "o_orderkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(t: Tables):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS INT) AS l_linenumber FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def isin_notin(t: Tables):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O")).join(poor, "o_custkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS flag FROM events), q AS (SELECT * FROM e WHERE (flag & 4) = 0 AND user_id IN (SELECT doc_id FROM labels)),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS rn FROM q)
SELECT user_id, event_type, count(*) AS n FROM d WHERE rn = 1 GROUP BY user_id, event_type
""")
def reads_pipeline(t: Tables):
    """Flag filter, whitelist, molecule dedup and counting in one plan."""
    e = t.events.withColumn("flag", F.get_json_object("props", "$.k").cast("long")).withColumn("umi", F.floor("value"))
    q = e.filter(~reads.has(F.col("flag"), reads.UNMAPPED)).join(t.labels.select(F.col("doc_id").alias("user_id")), "user_id", "left_semi")
    return reads.deduplicated(q, ["user_id"], "umi", ["ts", "event_id"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
