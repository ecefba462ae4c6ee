"""Queries of the numeric kernels: no SQL for these, tests hold them against known cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.contract.base import Tables, query, rounded, seconds


@query()
def ats_mixture(t: Tables):
    """Sites of each event type from the offsets of its events in a window of a day, by the mixture model."""
    from ridgeline.plans.ats import fitted_sites

    windows = t.events.select(F.col("event_type").alias("window"), F.floor(seconds() % 86_400 / 86.4).alias("offset"))
    return fitted_sites(windows, length=1000, max_sites=3, min_reads=20)


@query()
def density_similarity(t: Tables):
    """Correlation of each user group's position counts with their kernel density."""
    from ridgeline.plans.similarity import similarities

    rows = t.events.select((F.col("user_id") % 20).alias("site"), (F.floor(F.col("value")) % 100).alias("pos")).groupBy("site", "pos").agg(F.count(F.lit(1)).alias("n"))
    return similarities(rows, "site", "pos", "n").select("site", rounded("similarity").alias("similarity"))


@query()
def correlation_p_values(t: Tables):
    """Pearson r with its two-sided p value."""
    from ridgeline.functions.tails import correlation_p
    from ridgeline.operators.quant import correlation

    g = t.lineitem.select((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return correlation(g, ["k"], "x", "y").select("k", "n", rounded("r").alias("r"), rounded(correlation_p("r", "n")).alias("p"))


@query("""
WITH p AS (SELECT p_partkey, 30 + p_size % 20 || 'M' || p_size || 'N3S40M2D10M' || CASE WHEN p_partkey % 3 = 0 THEN '7N4I' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '5=6H' ELSE '1D' END AS cigar FROM part),
o AS (SELECT p_partkey, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) AS op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) AS i FROM p),
s AS (SELECT p_partkey, i, right(op, 1) AS k, CAST(regexp_extract(op, '[0-9]+') AS BIGINT) AS n FROM o),
m AS (SELECT s.*, d, CASE WHEN k IN ('M', '=', 'X', 'N') OR (k = 'D' AND d) THEN n ELSE 0 END AS go FROM s, (SELECT unnest([true, false]) AS d)),
c AS (SELECT *, p_partkey * 1000 + sum(go) OVER (w ROWS UNBOUNDED PRECEDING) AS till, sum(CASE WHEN k = 'N' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS part FROM m WINDOW w AS (PARTITION BY p_partkey, d ORDER BY i)),
r AS (SELECT p_partkey, d, part, min(till - go) AS "start", max(till) AS "end" FROM c WHERE k <> 'N' GROUP BY p_partkey, d, part)
SELECT p_partkey, d AS deletions_advance, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM r WHERE "end" > "start"
""")
def cigar_parts(t: Tables):
    """Exon parts of alignments, with deletions that advance (the default: they use up the reference) and that don't."""
    from ridgeline.functions.cigar import exon_parts

    key = F.col("p_partkey")
    text = F.concat((F.lit(30) + F.col("p_size") % 20).cast("string"), F.lit("M"), F.col("p_size").cast("string"), F.lit("N3S40M2D10M"), F.when(key % 3 == 0, "7N4I").otherwise(""), F.when(key % 2 == 0, "5=6H").otherwise("1D"))
    rows = None
    for mode in (True, False):
        part = t.part.select("p_partkey", F.lit(mode).alias("deletions_advance"), F.explode(exon_parts(key * 1000, text, mode)).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("p_partkey", "deletions_advance", "part.start", "part.end")


@query()
def forest_accuracy(t: Tables):
    """A random forest on the signal vectors: how many of each label it gets right."""
    from ridgeline.plans.classify import features

    from pyspark.ml.classification import RandomForestClassifier

    rows = features(t.embeddings)
    model = RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=10, seed=42).fit(rows.filter("vec_id % 3 <> 0"))
    return model.transform(rows.filter("vec_id % 3 = 0")).groupBy("label").agg(rounded(F.avg((F.col("prediction") == F.col("target")).cast("double"))).alias("accuracy"))
