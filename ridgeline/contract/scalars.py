"""Scalar, array and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.contract.base import DAY, Tables, day, query, rounded
from ridgeline.functions import numeric, text

KEY = f"'chr' || (o_custkey % 22) || ':' || {DAY} || '-' || ({DAY} + 30) || ':' || CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END"


def _key():
    strand = F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-")
    return text.region_key(F.concat(F.lit("chr"), F.col("o_custkey") % 22), day(), day() + 30, strand)


@query(f"SELECT o_orderkey, {KEY} AS region FROM orders")
def format_region_key(t: Tables):
    return t.orders.select("o_orderkey", _key().alias("region"))


@query(f"SELECT o_orderkey, 'chr' || (o_custkey % 22) AS chrom, {DAY} AS st, {DAY} + 30 AS en, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders")
def parse_region_key(t: Tables):
    keys = t.orders.select("o_orderkey", _key().alias("region"))
    return keys.select("o_orderkey", *[c.alias(n) for n, c in zip(("chrom", "st", "en", "strand"), text.parse_region(F.col("region")), strict=True)])


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', 2) AS tail, len(string_split(c_name, '0'))::BIGINT AS n FROM customer")
def split_parts(t: Tables):
    part = lambda i: F.coalesce(F.get(F.split("c_name", "#"), F.lit(i)), F.lit(""))
    return t.customer.select("c_custkey", part(0).alias("head"), part(1).alias("tail"), F.size(F.split("c_name", "0")).cast("long").alias("n"))


@query("SELECT c_custkey, regexp_replace(replace(c_name, 'C', 'K'), '[0-9]+$', '') AS name FROM customer")
def regex_clean(t: Tables):
    return t.customer.select("c_custkey", F.regexp_replace(F.replace("c_name", F.lit("C"), F.lit("K")), "[0-9]+$", "").alias("name"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-D]') AND regexp_matches(text, '[0-9]')")
def regex_filter(t: Tables):
    return t.documents.filter(F.col("text").rlike("^[A-D]") & F.col("text").rlike("[0-9]")).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus || '_' || o_custkey AS swapped FROM orders")
def token_swap(t: Tables):
    part = F.split(F.concat_ws("_", "o_custkey", "o_orderstatus"), "_")
    return t.orders.select("o_orderkey", F.concat_ws("_", F.get(part, F.lit(1)), F.get(part, F.lit(0))).alias("swapped"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[^\n -~]', '?', 'g') AS s FROM documents), c AS (SELECT doc_id, unnest([substr(s, i * 10 + 1, 10) for i in generate_series(0, length(s) // 10 - 1)]) AS chunk FROM d)
SELECT DISTINCT doc_id FROM c WHERE levenshtein(chunk, 'the of and') < 7
""")
def fuzzy_chunk_match(t: Tables):
    """Whole texts, in chunks of ten; other than plain characters are question marks (SQL's distance counts bytes)."""
    near = text.any_chunk_near(F.regexp_replace("text", r"[^\n -~]", "?"), F.lit("the of and"), 10, 7)
    return t.documents.filter(near).select("doc_id")


@query("SELECT c_custkey, reverse(translate(upper(c_mktsegment), 'ACGT', 'TGCA')) AS rc FROM customer")
def translate_reverse(t: Tables):
    return t.customer.select("c_custkey", text.reverse_complement(F.upper("c_mktsegment")).alias("rc"))


@query("WITH a AS (SELECT DISTINCT upper(lang) AS g FROM documents), b AS (SELECT DISTINCT upper(substr(n_name, 1, 2)) AS g FROM nation) SELECT g, CASE WHEN ends_with(g, 'N') THEN 'n' ELSE 'other' END AS label FROM a WHERE g IN (SELECT g FROM b UNION ALL SELECT 'EN')")
def upper_intersect(t: Tables):
    known = t.nation.select(F.upper(F.substring("n_name", 1, 2)).alias("g")).unionByName(t.spark.range(1).select(F.lit("EN").alias("g")))
    return t.documents.select(F.upper("lang").alias("g")).distinct().join(known, "g", "left_semi").select("g", F.when(F.col("g").endswith("N"), "n").otherwise("other").alias("label"))


@query("SELECT event_id, round(exp(-0.5 * ((value - 50) / 20) ** 2) / (20 * sqrt(2 * pi())), 6) AS density FROM events")
def norm_pdf(t: Tables):
    return t.events.select("event_id", rounded(numeric.normal_pdf(F.col("value"), 50, 20)).alias("density"))


@query("""
WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10 AS b FROM customer)
SELECT c_custkey, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p FROM x
""")
def softmax_array(t: Tables):
    z = F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10)
    return t.customer.select("c_custkey", rounded(numeric.softmax(z)[0]).alias("p"))


@query("WITH n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY user_id")
def entropy_agg(t: Tables):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("n"))
    return n.select("user_id", rounded(numeric.entropy(F.col("n"))).alias("entropy"))


@query("SELECT user_id, round(-2 * sum(ln(1 + value)) + (3 * 2 + 1) * ln(count(*)), 6) AS bic FROM events GROUP BY user_id")
def bic_expr(t: Tables):
    return t.events.groupBy("user_id").agg(rounded(numeric.bic(F.sum(F.log1p("value")), 2, F.count(F.lit(1)))).alias("bic"))


@query("SELECT event_id, CAST(least(50, greatest(5, ceil(value / 5 - 0.5) * 5)) AS BIGINT) AS sigma FROM events")
def snap_to_grid(t: Tables):
    return t.events.select("event_id", numeric.snap(F.col("value"), 5, 5, 50).alias("sigma"))


@query(f"SELECT o_orderkey, ({DAY} + {DAY} + 31) // 2 AS mid FROM orders")
def midpoint(t: Tables):
    return t.orders.select("o_orderkey", numeric.midpoint(day(), day() + 31).alias("mid"))


@query("SELECT c_custkey, greatest(c_acctbal, 1) AS bal FROM customer")
def clamp(t: Tables):
    return t.customer.select("c_custkey", F.greatest(F.col("c_acctbal"), F.lit(1.0)).alias("bal"))


@query("SELECT vec_id, round(list_sum([abs(embedding[i + 1] - embedding[i]) for i in generate_series(1, 63)]), 6) AS rough FROM embeddings")
def zip_with_diff(t: Tables):
    steps = F.zip_with(F.slice("embedding", 2, 63), F.slice("embedding", 1, 63), lambda a, b: F.abs(a - b))
    return t.embeddings.select("vec_id", rounded(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).alias("rough"))


@query("SELECT p_partkey, repeat(p_size || ',', p_size % 4) || 'end' AS rep FROM part")
def array_repeat_flatten(t: Tables):
    rep = F.flatten(F.array(F.array_repeat(F.col("p_size").cast("string"), F.col("p_size") % 4), F.array(F.lit("end"))))
    return t.part.select("p_partkey", F.array_join(rep, ",").alias("rep"))


@query("""
WITH g AS (SELECT c_custkey, c_nationkey, unnest(generate_series(0, 90, 10)) AS x FROM customer)
SELECT c_custkey, round(sum(0.7 * exp(-0.5 * ((x - c_nationkey * 4) / 10.0) ** 2) / (10 * sqrt(2 * pi())) + 0.3 / 100), 6) AS total FROM g GROUP BY c_custkey
""")
def mixture_density(t: Tables):
    d = numeric.mixture_density(F.sequence(F.lit(0), F.lit(90), F.lit(10)), F.array(F.struct((F.col("c_nationkey") * 4).cast("double").alias("alpha"), F.lit(10.0).alias("beta"), F.lit(0.7).alias("w"))), F.lit(0.3), 100)
    return t.customer.select("c_custkey", rounded(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 100.0 WHEN user_id % 10 = 1 THEN -100.0 ELSE value END AS clipped FROM events")
def clip_infinity(t: Tables):
    x = F.when(F.col("user_id") % 10 == 0, F.lit(float("inf"))).when(F.col("user_id") % 10 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", numeric.finite(x, 100.0).alias("clipped"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(-log10(value / 1000), 6) END AS score FROM events")
def neg_log10(t: Tables):
    p = F.col("value") / 1000
    return t.events.select("event_id", F.when(p > 0, rounded(-F.log10(p))).alias("score"))
