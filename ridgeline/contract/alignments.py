"""Alignment files made from the events: written sorted with indexes, then read by region or by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.contract.base import Tables, query
from ridgeline.sources import bam, register, shared

LENGTH = 1_000_000
START = f"(event_id * 104729 + user_id * 7919) % {LENGTH}"
READS = f"SELECT event_id, event_type AS chrom, {START} AS st, {START} + 30 + event_id % 90 AS en, user_id FROM events"


def _written(t: Tables) -> tuple[str, list[tuple[str, int]]]:
    """The folder of the events as alignments: a reference for each type, a cell for each user."""
    register(t.spark)
    references = sorted((r[0], LENGTH + 200) for r in t.events.select("event_type").distinct().collect())  # as few as chromosomes
    at = (F.col("event_id") * 104729 + F.col("user_id") * 7919) % LENGTH
    rows = t.events.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("name"), F.when(F.col("user_id") % 2 == 0, 0).otherwise(16).alias("flag"), F.col("event_type").alias("chrom"), at.alias("start"),
        F.lit(60).alias("mapq"), F.concat((30 + F.col("event_id") % 90).cast("string"), F.lit("M")).alias("cigar"), F.lit(1).alias("nh"), F.concat(F.lit("C"), F.col("user_id")).alias("cb"),
    )
    path = shared.folder(t.spark, "alignments")
    bam.write_bam(rows, path, references)
    return path, references


@query(f"""
WITH r AS ({READS}) SELECT chrom, 'C' || user_id AS cb, count(*) AS n, CAST(min(st) AS BIGINT) AS first_start, CAST(max(en) AS BIGINT) AS last_end FROM r
WHERE chrom = 'click' AND st < 320000 AND en > 300000 GROUP BY chrom, user_id
""")
def indexed_region_fetch(t: Tables):
    """Filters on place reach the reader, which opens only the blocks that the index names."""
    path, _ = _written(t)
    reads = t.spark.read.format("bam").load(path).filter("chrom = 'click' AND start < 320000 AND end > 300000")
    return reads.groupBy("chrom", "cb").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(f"""
WITH r AS ({READS}) SELECT 'e' || event_id AS name, chrom, CAST(st AS BIGINT) AS start_at, CAST(en AS BIGINT) AS end_at FROM r WHERE event_id IN (SELECT doc_id FROM labels)
""")
def bam_name_subset(t: Tables):
    """The records of given names, written byte for byte and read again."""
    path, _ = _written(t)
    names = t.labels.select(F.concat(F.lit("e"), F.col("doc_id")).alias("name"))
    out = shared.folder(t.spark, "subset")
    bam.subset(t.spark, path, names, out)
    return t.spark.read.format("bam").load(out).select("name", "chrom", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
