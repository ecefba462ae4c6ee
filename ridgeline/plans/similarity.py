"""How well counts by position agree with their kernel density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import intervals, reads


def similarities(counts: DataFrame, site: str, position: str, n: str) -> DataFrame:
    """site, similarity: Pearson of each site's counts with the density at the same positions.

    Null under three positions or for constant values. counts: one row for each site and position."""
    kind = dict(counts.dtypes)[site]

    def run(pdf):
        import numpy as np
        import pandas as pd

        from ridgeline.plans.mixture import density

        x, w = pdf[position].to_numpy(float), pdf[n].to_numpy(float)
        value = None
        if len(x) >= 3:
            smooth = density(x - x.min(), w, x - x.min())
            if w.std() > 0 and smooth.std() > 0:
                value = float(np.corrcoef(w, smooth)[0, 1])
        return pd.DataFrame({site: [pdf[site].iloc[0]], "similarity": pd.Series([value], dtype=object)})

    return counts.select(site, position, n).groupBy(site).applyInPandas(run, f"{site} {kind}, similarity double")


def start_histograms(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """utr, end, pos, n: where the reads over each site begin (end, on the minus strand); one read for each molecule.

    sites: utr, chrom, strand, start, end."""
    rows = alignments.filter(reads.passes_qc(F.col("flag"), F.col("nh"))).withColumn("strand", reads.strand(F.col("flag")))
    at = sites.select("utr", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    over = intervals.overlap_join(rows.select("chrom", "strand", "name", "ub", "start", "end"), at, ["chrom", "strand"], 1000, ("start", "end"), ("s", "e"))
    one = reads.first_per_key(over.withColumn("umi", F.coalesce("ub", "name")), ["utr", "e", "umi"], ["start", "end", "name"])
    pos = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    return one.groupBy("utr", F.col("e").alias("end"), pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
