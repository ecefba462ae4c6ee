"""Training rows for the site classifier: positive peaks, and negatives that lie away from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.intervals import band_anti_join


def random_sites(spark, sizes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """chrom, at: ``n`` positions drawn over chromosomes (chrom, size) by their sizes, the same for a seed whatever the partitions."""
    from pyspark.sql import Window

    # chromosomes are few; their running sums place a number on one of them
    upto = sizes.withColumn("hi", F.sum("size").over(Window.orderBy("chrom"))).withColumn("lo", F.col("hi") - F.col("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    draws = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("g"))
    return draws.join(F.broadcast(upto), (F.col("g") >= F.col("lo")) & (F.col("g") < F.col("hi"))).select("chrom", (F.col("g") - F.col("lo")).alias("at"))


def labelled(positives: DataFrame, negatives: DataFrame, span: int = 500) -> DataFrame:
    """chrom, at, label: all positives, and negatives with no positive within ``span``. Inputs: chrom, at."""
    away = band_anti_join(negatives.distinct(), positives.select("chrom", F.col("at").alias("p")), ["chrom"], span, "at", "p", ["chrom", "at"])
    return positives.select("chrom", "at").distinct().withColumn("label", F.lit(1)).unionByName(away.select("chrom", "at").withColumn("label", F.lit(0)))


def balanced(rows: DataFrame, per_label: int, seed: int = 42) -> DataFrame:
    """At most ``per_label`` rows of each label, drawn by hash."""
    from functools import reduce

    draw = lambda y: rows.filter(F.col("label") == y).orderBy(F.xxhash64("chrom", "at", F.lit(seed))).limit(per_label)
    return reduce(DataFrame.unionByName, [draw(0), draw(1)])
