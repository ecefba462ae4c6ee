"""Molecules per site and cell, bulk counts, ratios, wide matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import intervals, quant, reads


def hits(alignments: DataFrame, sites: DataFrame, width: int = 1000) -> DataFrame:
    """Sound alignments over each site. sites: utr, row_id, chrom, start, end, strand."""
    rows = alignments.filter(reads.passes_qc(F.col("flag"), F.col("nh"))).withColumn("strand", reads.strand(F.col("flag")))
    s = sites.select("utr", "row_id", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e"))
    return intervals.overlap_join(rows, s, ["chrom", "strand"], width, ("start", "end"), ("s", "e"))


def counts(alignments: DataFrame, sites: DataFrame, labels: dict[str, str] | None = None, bulk: bool = False, records: bool = False) -> DataFrame:
    """utr, row_id, col_id, value.

    Cells: distinct molecules of the first read of each name that has both tags; col_id is the
    barcode, with _label if the file has one, so files without a label are taken together.
    bulk: distinct names (``records``: alignments) of each file."""
    rows = hits(alignments, sites)
    name = F.element_at(F.split("file", "/"), -1)
    label = F.lit("")
    for path, tag in (labels or {}).items():
        label = F.when(F.col("file") == path, F.lit(tag)).otherwise(label)
    rows = rows.withColumn("label", label)
    if bulk:
        n = F.count(F.lit(1)) if records else F.count_distinct("name")
        return rows.groupBy("utr", "row_id", F.when(F.col("label") != "", F.col("label")).otherwise(name).alias("col_id")).agg(n.alias("value"))
    tagged = rows.filter(F.col("cb").isNotNull() & F.col("ub").isNotNull())
    first = tagged.groupBy("utr", "row_id", "file", "label", "name").agg(F.min_by(F.struct("cb", "ub"), F.struct("start", "flag", "cb", "ub")).alias("t"))
    cell = F.when(F.col("label") != "", F.concat_ws("_", "t.cb", "label")).otherwise(F.col("t.cb"))
    return quant.molecule_counts(first.select("utr", "row_id", cell.alias("col_id"), F.col("t.ub").alias("ub")), ["utr", "row_id"], ["col_id"], "ub").withColumnRenamed("n", "value")


def psi(counted: DataFrame, more_sites_than: int = 0) -> DataFrame:
    """utr, row_id, col_id, value: each count's share of its utr and cell."""
    return quant.psi(counted, "utr", "row_id", "col_id", "value", more_sites_than).select("utr", "row_id", "col_id", F.col("psi").alias("value"))


def transcripts_as_sites(annotation: DataFrame) -> DataFrame:
    """Sites from an annotation's transcripts: one row for each of a gene's ranges."""
    t = annotation.filter("feature = 'transcript'")
    return t.select(F.col("gene_name").alias("utr"), F.concat_ws("_", "gene_name", "transcript_id").alias("row_id"), "chrom", "start", "end", "strand").distinct()


def sites_as_rows(sites: DataFrame) -> DataFrame:
    """The sites table as counting needs it: row_id is utr and site."""
    return sites.select("utr", F.concat_ws("_", "utr", "end").alias("row_id"), "chrom", "start", "end", "strand")
