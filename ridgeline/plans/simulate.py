"""Simulated fragments around known sites, and the distance of inferred sites from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulated(sites: DataFrame, low: int = 50, high: int = 1000, spread: float = 30, read: int = 150, seed: int = 42) -> DataFrame:
    """chrom, strand, name, start, end: between ``low`` and ``high`` fragments of normally placed starts for each site (chrom, strand, site)."""
    many = F.lit(low) + F.pmod(F.xxhash64("chrom", "site", F.lit(seed)), F.lit(high - low))
    rows = sites.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), many)))
    uniform = lambda k: (F.pmod(F.xxhash64("chrom", "site", "i", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * 3.141592653589793 * uniform(2))
    at = F.round(F.col("site") + normal * spread).cast("long")
    start = F.when(F.col("strand") == "+", at).otherwise(at - read)
    return rows.select("chrom", "strand", F.concat_ws(":", "chrom", "site", "i").alias("name"), start.alias("start"), (start + read).alias("end"))


def distances(truth: DataFrame, found: DataFrame) -> DataFrame:
    """name, distance: every true site against every inferred site of its name. Inputs: name, site."""
    return truth.select("name", F.col("site").alias("t")).join(found.select("name", F.col("site").alias("f")), "name").select("name", (F.col("t") - F.col("f")).alias("distance"))


def distinct_sites(spark: SparkSession, exons: DataFrame, total: int | None = None) -> DataFrame:
    """chrom, site, strand of the annotation's transcripts, each once; ``total`` of them if given."""
    t = exons.groupBy("chrom", "strand", "transcript_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    sites = t.select("chrom", F.when(F.col("strand") == "+", F.col("lo")).otherwise(F.col("hi")).alias("site"), "strand").distinct()
    return sites if total is None else sites.orderBy("chrom", "site", "strand").limit(total)
