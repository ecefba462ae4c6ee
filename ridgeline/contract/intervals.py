"""Interval joins, merges, segments, lifts: orders as [day, day + 30), events as points in seconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.contract.base import DAY, SECONDS, Tables, day, query, rounded, seconds
from ridgeline.operators import intervals as iv

SECONDS_OF_DAY = f"({DAY} * 86400 + o_orderkey * 7919 % 86400)"
SPANS = f"SELECT o_orderkey, o_custkey, {DAY} AS st, {DAY} + 30 AS en FROM orders"


def spans(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", day().alias("st"), (day() + 30).alias("en"))


@query(f"""
WITH a AS (SELECT o_orderkey, o_custkey % 10 AS k, {DAY} AS st, {DAY} + 30 AS en FROM orders),
b AS (SELECT event_id, user_id % 10 AS k, 8035 + event_id % 2400 AS bs, 8035 + event_id % 2400 + 1 + user_id % 5 AS be FROM events)
SELECT event_id, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first_order
FROM b JOIN a ON a.k = b.k AND a.st < b.be AND a.en > b.bs GROUP BY event_id
""")
def interval_join_overlap(t: Tables):
    a = spans(t).select("o_orderkey", (F.col("o_custkey") % 10).alias("k"), "st", "en")
    at = F.lit(8035) + F.col("event_id") % 2400
    b = t.events.select("event_id", (F.col("user_id") % 10).alias("k"), at.alias("bs"), (at + 1 + F.col("user_id") % 5).alias("be"))
    found = iv.overlap_summary(a, b, ["k"], 30, ("st", "en"), ("bs", "be"), "o_orderkey", "event_id")
    return found.select("event_id", "n", F.col("first").alias("first_order"))


LENGTHS = "CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 90 ELSE 1 + o_orderkey % 40 END"


@query(f"""
WITH a AS (SELECT o_orderkey, o_custkey % 3 AS k, {DAY} AS st, {DAY} + {LENGTHS} AS en FROM orders),
b AS (SELECT c_custkey, c_custkey % 3 AS k, CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 8035 + c_nationkey * 90 END AS bs,
 CASE WHEN c_custkey % 50 = 0 THEN 20000 ELSE 8035 + c_nationkey * 90 + 1 + c_custkey % 13 END AS be FROM customer)
SELECT c_custkey, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first_order, CAST(sum(least(en, be) - greatest(st, bs)) AS BIGINT) AS shared
FROM b JOIN a ON a.k = b.k AND a.st < b.be AND a.en > b.bs GROUP BY c_custkey
""")
def overlap_any_length(t: Tables):
    """Intervals of one day up to the whole axis, in nested bins: no row is copied by its length."""
    order, cust = F.col("o_orderkey") % 5, F.col("c_custkey")
    length = F.when(order == 0, 1).when(order == 1, 7).when(order == 2, 90).otherwise(1 + F.col("o_orderkey") % 40)
    a = t.orders.select("o_orderkey", (F.col("o_custkey") % 3).alias("k"), day().alias("st"), (day() + length).alias("en"))
    at, whole = F.lit(8035).cast("long") + F.col("c_nationkey") * 90, cust % 50 == 0
    b = t.customer.select("c_custkey", (cust % 3).alias("k"), F.when(whole, 0).otherwise(at).alias("bs"), F.when(whole, 20000).otherwise(at + 1 + cust % 13).alias("be"))
    found = iv.overlap_summary(a, b, ["k"], None, ("st", "en"), ("bs", "be"), "o_orderkey", "c_custkey")
    return found.select("c_custkey", "n", F.col("first").alias("first_order"), "shared")


def _islands(touching: bool) -> str:
    return f"""
WITH s AS ({SPANS}), a AS (SELECT *, max(en) OVER (PARTITION BY o_custkey ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM s),
b AS (SELECT *, sum(CASE WHEN pm IS NULL OR NOT (st {'<=' if touching else '<'} pm) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT o_custkey, min(st) AS st, max(en) AS en, count(*) AS n FROM b GROUP BY o_custkey, g
"""


@query(_islands(False))
def interval_merge_islands(t: Tables):
    return iv.merged(spans(t), ["o_custkey"], "st", "en")


@query(_islands(True))
def interval_merge_touching(t: Tables):
    return iv.merged(spans(t), ["o_custkey"], "st", "en", touching=True)


@query(f"""
WITH s AS ({SPANS}), b AS (SELECT o_custkey, st AS p FROM s UNION SELECT o_custkey, en FROM s),
l AS (SELECT o_custkey, p AS seg_start, lead(p) OVER (PARTITION BY o_custkey ORDER BY p) AS seg_end FROM b)
SELECT * FROM l WHERE seg_end IS NOT NULL
""")
def atomic_segments(t: Tables):
    return iv.atomic_segments(spans(t), ["o_custkey"], "st", "en").withColumnsRenamed({"start": "seg_start", "end": "seg_end"})


@query(f"""
WITH s AS (SELECT o_custkey % 2 AS k, {SECONDS_OF_DAY} AS st FROM orders), b AS (SELECT k, st AS p FROM s UNION SELECT k, st + 1 + st % 5000 FROM s),
l AS (SELECT k, p AS seg_start, lead(p) OVER (PARTITION BY k ORDER BY p) AS seg_end FROM b)
SELECT * FROM l WHERE seg_end IS NOT NULL
""")
def atomic_segments_of_axes(t: Tables):
    """Two long axes: the next border is looked for in bins and carried over."""
    at = day() * 86400 + F.col("o_orderkey") * 7919 % 86400
    s = t.orders.select((F.col("o_custkey") % 2).alias("k"), at.alias("st"), (at + 1 + at % 5000).alias("en"))
    return iv.atomic_segments(s, ["k"], "st", "en", width=1 << 16).withColumnsRenamed({"start": "seg_start", "end": "seg_end"})


@query("""
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, round(abs(a.p_retailprice - b.p_retailprice), 6) AS gap
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type <> b.p_type AND a.p_partkey < b.p_partkey
AND abs(a.p_retailprice - b.p_retailprice) <= 20
""")
def band_self_join(t: Tables):
    """Every pair once, from its higher price; the gap is rounded as SQL does it, as that of decimals costs more than the join."""
    near = iv.band_pairs(t.part, ["p_brand"], 20, "p_retailprice", "p_partkey", ["p_type"]).filter("lo_p_type <> hi_p_type")
    gap = F.floor(F.col("gap") * 1e6 + 0.5) / 1e6
    return near.select(F.least("lo_p_partkey", "hi_p_partkey").alias("a_key"), F.greatest("lo_p_partkey", "hi_p_partkey").alias("b_key"), gap.alias("gap"))


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {SECONDS} AS s FROM events)
SELECT event_id, user_id, s FROM e a WHERE event_type = 'error'
AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND abs(a.s - b.s) <= 50000)
""")
def range_anti_join(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", seconds().alias("s"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "s")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("s").alias("p"))
    return iv.band_anti_join(left, right, ["user_id"], 50_000, "s", "p", ["event_id"])


@query(f"""
WITH s AS ({SPANS}), a AS (SELECT o_orderkey, o_custkey, st, en, max(en) OVER (PARTITION BY o_custkey ORDER BY st, en, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ps_en,
 max(st) OVER (PARTITION BY o_custkey ORDER BY st, en, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ps_st FROM s)
SELECT sum((en <= ps_st)::INT)::BIGINT AS n_before, sum((st >= ps_en)::INT)::BIGINT AS n_after, sum((st < ps_st AND en > ps_st AND en < ps_en)::INT)::BIGINT AS n_partial_left,
 sum((st > ps_st AND st < ps_en AND en > ps_en)::INT)::BIGINT AS n_partial_right, sum((st >= ps_st AND en <= ps_en)::INT)::BIGINT AS n_within,
 sum((st <= ps_st AND en >= ps_en)::INT)::BIGINT AS n_contains, sum((st = ps_st AND en = ps_en)::INT)::BIGINT AS n_equal,
 sum((st < ps_en AND en > ps_st)::INT)::BIGINT AS n_overlapping, sum((en = ps_st OR st = ps_en)::INT)::BIGINT AS n_adjacent
FROM a WHERE ps_st IS NOT NULL
""")
def allen_relations(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("st", "en", "o_orderkey")
    rows = spans(t).withColumn("ps", F.lag("st").over(w)).withColumn("pe", F.lag("en").over(w)).filter("ps IS NOT NULL")
    each = iv.relations(F.col("st"), F.col("en"), F.col("ps"), F.col("pe"))
    return rows.agg(*[F.sum(c.cast("long")).alias(f"n_{k}") for k, c in each.items()])


@query(f"""
WITH s AS ({SPANS}) SELECT a.o_orderkey AS outer_key, b.o_orderkey AS inner_key FROM s a JOIN s b
ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.st >= a.st - 3 AND b.en <= a.en + 3
""")
def cover_tolerance(t: Tables):
    a = spans(t).withColumnsRenamed({"o_orderkey": "outer_key", "st": "a_st", "en": "a_en"})
    b = spans(t).withColumnsRenamed({"o_orderkey": "inner_key", "st": "b_st", "en": "b_en"})
    pairs = iv.overlap_join(a, b, ["o_custkey"], 30, ("a_st", "a_en"), ("b_st", "b_en"))
    return pairs.filter((F.col("outer_key") != F.col("inner_key")) & iv.covers(F.col("a_st"), F.col("a_en"), F.col("b_st"), F.col("b_en"))).select("outer_key", "inner_key")


@query(f"""
WITH s AS (SELECT o_custkey % 50 AS gene, o_custkey AS tr, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, {DAY} AS st, {DAY} + 30 AS en FROM orders),
x AS (SELECT gene, strand, tr, CASE WHEN strand = '+' THEN min(st) ELSE max(en) END AS tss FROM s GROUP BY gene, strand, tr),
w AS (SELECT gene, strand, greatest(tss - 20, 1) AS st, tss + 20 AS en FROM x),
a AS (SELECT *, max(en) OVER (PARTITION BY gene, strand ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM w),
b AS (SELECT *, sum(CASE WHEN pm IS NULL OR st >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY gene, strand ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT gene, strand, min(st) AS win_start, max(en) AS win_end, count(*) AS n FROM b GROUP BY gene, strand, g
""")
def tss_windows(t: Tables):
    exons = spans(t).select((F.col("o_custkey") % 50).alias("gene"), F.col("o_custkey").alias("tr"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"), "st", "en")
    return iv.tss_windows(exons, ["gene"], "tr", "st", "en", "strand", 20).withColumnsRenamed({"start": "win_start", "end": "win_end"})


@query(f"""
WITH s AS ({SPANS}), w AS (SELECT o_custkey, min(st) + 40 AS lo, min(st) + 400 AS hi FROM s GROUP BY o_custkey)
SELECT o_orderkey, greatest(st, lo) - lo AS rel_start, least(en, hi) - lo AS rel_end FROM s JOIN w USING (o_custkey) WHERE greatest(st, lo) < least(en, hi)
""")
def clip_to_window(t: Tables):
    s = spans(t)
    w = s.groupBy("o_custkey").agg((F.min("st") + 40).alias("lo"), (F.min("st") + 400).alias("hi"))
    start, end = iv.clipped(F.col("st"), F.col("en"), F.col("lo"), F.col("hi"))
    return s.join(w, "o_custkey").select("o_orderkey", start.alias("rel_start"), end.alias("rel_end")).filter("rel_start IS NOT NULL")


@query(f"""
WITH s AS ({SPANS}), m AS (SELECT o_custkey, min(st) AS st0, max(en) AS en1 FROM s GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN st - st0 ELSE en1 - en END AS rel FROM s JOIN m USING (o_custkey)
WHERE CASE WHEN o_custkey % 2 = 0 THEN st - st0 ELSE en1 - en END BETWEEN 0 AND 999
""")
def relative_offset(t: Tables):
    s = spans(t)
    m = s.groupBy("o_custkey").agg(F.min("st").alias("st0"), F.max("en").alias("en1"))
    rel = F.when(F.col("o_custkey") % 2 == 0, F.col("st") - F.col("st0")).otherwise(F.col("en1") - F.col("en"))
    return s.join(m, "o_custkey").select("o_orderkey", rel.alias("rel")).filter("rel >= 0 AND rel < 1000")


@query(f"""
WITH s AS ({SPANS}), w AS (SELECT c_custkey, 9000 + c_nationkey * 40 AS lo, 9000 + c_nationkey * 40 + 400 AS hi FROM customer)
SELECT o_orderkey, st, en FROM s JOIN w ON o_custkey = c_custkey WHERE st >= lo AND en <= hi
""")
def contained_in_window(t: Tables):
    lo = F.lit(9000) + F.col("c_nationkey") * 40
    w = t.customer.select(F.col("c_custkey").alias("o_custkey"), lo.alias("lo"), (lo + 400).alias("hi"))
    return spans(t).join(w, "o_custkey").filter("st >= lo AND en <= hi").select("o_orderkey", "st", "en")


SEGMENTS = f"""
s AS ({SPANS}), b AS (SELECT o_custkey, st AS p FROM s UNION SELECT o_custkey, en FROM s),
seg AS (SELECT * FROM (SELECT o_custkey, p AS ss, lead(p) OVER (PARTITION BY o_custkey ORDER BY p) AS se FROM b) WHERE se IS NOT NULL),
iso AS (SELECT s.o_custkey, s.o_orderkey, seg.ss, seg.se FROM s JOIN seg ON s.o_custkey = seg.o_custkey AND seg.ss >= s.st AND seg.se <= s.en),
off AS (SELECT *, coalesce(sum(se - ss) OVER (PARTITION BY o_custkey, o_orderkey ORDER BY ss ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS local_start FROM iso)
"""


def _segments_of_isoforms(t: Tables):
    s = spans(t)
    seg = iv.atomic_segments(s, ["o_custkey"], "st", "en").withColumnsRenamed({"start": "ss", "end": "se"})
    iso = iv.overlap_join(s, seg, ["o_custkey"], 30, ("st", "en"), ("ss", "se")).filter("ss >= st AND se <= en")
    before = Window.partitionBy("o_custkey", "o_orderkey").orderBy("ss").rowsBetween(Window.unboundedPreceding, -1)
    return iso.select("o_custkey", "o_orderkey", "ss", "se", F.coalesce(F.sum(F.col("se") - F.col("ss")).over(before), F.lit(0)).alias("local_start"))


@query(f"WITH {SEGMENTS} SELECT * FROM off")
def cumulative_offset(t: Tables):
    return _segments_of_isoforms(t)


@query(f"""
WITH {SEGMENTS}, q AS (SELECT o_custkey, o_orderkey AS read_key, ss, se FROM off),
n AS (SELECT read_key, sum(se - ss) AS len FROM q GROUP BY read_key),
l AS (SELECT q.read_key, off.o_orderkey AS iso, min(off.local_start) AS lift_start, max(off.local_start + off.se - off.ss) AS lift_end, sum(off.se - off.ss) AS got
  FROM q JOIN off ON q.o_custkey = off.o_custkey AND q.ss = off.ss GROUP BY q.read_key, off.o_orderkey)
SELECT read_key, iso, lift_start, lift_end FROM l JOIN n USING (read_key) WHERE got = len AND lift_end - lift_start = len
""")
def coordinate_lift(t: Tables):
    """A read's segments lie in an isoform one after another: all of them, without a break."""
    off = _segments_of_isoforms(t)
    q = off.select("o_custkey", F.col("o_orderkey").alias("read_key"), "ss", (F.col("se") - F.col("ss")).alias("len"))
    whole = q.groupBy("read_key").agg(F.sum("len").alias("whole"))
    lift = q.join(off.withColumnRenamed("o_orderkey", "iso"), ["o_custkey", "ss"]).withColumn("size", F.col("se") - F.col("ss"))
    lift = lift.groupBy("read_key", "iso").agg(F.min("local_start").alias("lift_start"), F.max(F.col("local_start") + F.col("size")).alias("lift_end"), F.sum("size").alias("got"))
    return lift.join(whole, "read_key").filter("got = whole AND lift_end - lift_start = whole").select("read_key", "iso", "lift_start", "lift_end")


@query(f"""
WITH s AS ({SPANS}), x AS (SELECT o_orderkey, st AS exon_start, en AS exon_end, st - 60 + (o_orderkey % 150) AS ats FROM s)
SELECT o_orderkey, CASE WHEN ats > exon_end THEN NULL WHEN ats >= exon_start - 50 AND ats <= exon_end THEN exon_start
 WHEN least(ats + 200, exon_start + 1) > exon_start THEN least(exon_start, greatest(0, ats - 50)) ELSE NULL END AS new_start FROM x
""")
def exon_extension_case(t: Tables):
    """The first exon reaches back to the start site if it lies near enough."""
    ats = F.col("st") - 60 + F.col("o_orderkey") % 150
    s = spans(t).select("o_orderkey", F.col("st").alias("a"), F.col("en").alias("b"), ats.alias("ats"))
    new = (
        F.when(F.col("ats") > F.col("b"), None)
        .when((F.col("ats") >= F.col("a") - 50) & (F.col("ats") <= F.col("b")), F.col("a"))
        .when(F.least(F.col("ats") + 200, F.col("a") + 1) > F.col("a"), F.least(F.col("a"), F.greatest(F.lit(0), F.col("ats") - 50)))
    )
    return s.select("o_orderkey", new.alias("new_start"))


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {SECONDS} AS s FROM events)
SELECT a.event_id, max(b.s) AS nearest FROM e a LEFT JOIN e b ON b.event_type = 'purchase' AND b.user_id = a.user_id AND b.s <= a.s
WHERE a.event_type = 'click' GROUP BY a.event_id
""")
def nearest_feature(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", seconds().alias("s"))
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "s")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("s").alias("p"))
    return iv.nearest_before(left, right, ["user_id"], "s", "p").select("event_id", "nearest")


@query(f"""
WITH e AS (SELECT event_id, user_id % 3 AS k, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type, {SECONDS} AS s FROM events),
a AS (SELECT * FROM e WHERE event_type IN ('click', 'view')), b AS (SELECT DISTINCT k, s AS p FROM e WHERE event_type = 'purchase'),
w AS (SELECT a.event_id, a.strand, a.s, x.p AS before, y.p AS after FROM a ASOF LEFT JOIN b x ON a.k = x.k AND a.s >= x.p ASOF LEFT JOIN b y ON a.k = y.k AND a.s <= y.p),
n AS (SELECT *, CASE WHEN after IS NULL OR s - before <= after - s THEN before ELSE after END AS nearest FROM w)
SELECT event_id, before, after, nearest, nearest - s AS distance, CASE WHEN strand = '+' THEN before ELSE after END AS upstream, CASE WHEN strand = '+' THEN after ELSE before END AS downstream FROM n
""")
def nearest_both_sides(t: Tables):
    """Three long axes: the closest purchase on either side, ties included, found without a window over an axis."""
    e = t.events.select("event_id", (F.col("user_id") % 3).alias("k"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), "event_type", seconds().alias("s"))
    left = e.filter(F.col("event_type").isin("click", "view")).select("event_id", "k", "strand", "s")
    right = e.filter("event_type = 'purchase'").select("k", F.col("s").alias("p"))
    return iv.nearest(left, right, ["k"], "s", "p", "strand").drop("k", "strand", "s")


@query(f"""
WITH s AS ({SPANS}), a AS (SELECT o_orderkey, o_custkey, st, en, lag(en) OVER (PARTITION BY o_custkey ORDER BY st, en, o_orderkey) AS pe, lag(st) OVER (PARTITION BY o_custkey ORDER BY st, en, o_orderkey) AS ps FROM s)
SELECT o_orderkey, CASE WHEN pe = st THEN ps END AS joined_start, CASE WHEN pe = st THEN en END AS joined_end FROM a
""")
def concat_adjacent(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("st", "en", "o_orderkey")
    a = spans(t).withColumn("pe", F.lag("en").over(w)).withColumn("ps", F.lag("st").over(w))
    meet = F.col("pe") == F.col("st")
    return a.select("o_orderkey", F.when(meet, F.col("ps")).alias("joined_start"), F.when(meet, F.col("en")).alias("joined_end"))
