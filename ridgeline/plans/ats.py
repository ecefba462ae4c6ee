"""From reads in windows to start sites."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import intervals, reads


def offsets(fragments: DataFrame, windows: DataFrame, width: int = 1000) -> DataFrame:
    """window, strand, offset of every fragment that lies in a window whole.

    fragments: chrom, strand, start, end; windows: chrom, strand, win_start, win_end, window."""
    inside = intervals.overlap_join(fragments, windows, ["chrom", "strand"], width, ("start", "end"), ("win_start", "win_end"))
    inside = inside.filter((F.col("start") >= F.col("win_start")) & (F.col("end") <= F.col("win_end")))
    at = F.when(F.col("strand") == "+", F.col("start") - F.col("win_start")).otherwise(F.col("win_end") - F.col("end"))
    return inside.select("window", "strand", at.alias("offset"))


def fitted_sites(rows: DataFrame, length: int = 500, max_sites: int = 5, min_sites: int = 1, min_weight: float = 0.01, min_reads: int = 10, max_beta: int = 50, max_uniform: float = 0.1) -> DataFrame:
    """window, number_of_reads, alpha, beta, ws (comma-joined; ws ends with the uniform part), bic.

    rows: window, offset. Offsets are counted before the shuffle, so a window sends at most
    ``length`` rows, however deep it is. Each window is seeded by its name."""
    counts = rows.filter((F.col("offset") >= 0) & (F.col("offset") < length)).groupBy(F.col("window").cast("string").alias("window"), "offset").agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf):
        import numpy as np
        import pandas as pd

        from ridgeline.plans.mixture import Window

        name, total = str(pdf["window"].iloc[0]), int(pdf["n"].sum())
        columns = ["window", "number_of_reads", "alpha", "beta", "ws", "bic"]
        if total < max(2, min_reads):
            return pd.DataFrame([], columns=columns)
        pdf = pdf.sort_values("offset")
        window = Window(pdf["offset"].to_numpy(), length, max_beta, max_uniform, zlib.crc32(name.encode()), pdf["n"].to_numpy())
        best = window.fit(max_sites, min_sites, min_weight)
        join = lambda v, f: ",".join(f.format(x) for x in v)
        return pd.DataFrame([[name, total, join(np.rint(best.alpha), "{:.0f}"), join(best.beta, "{:.0f}"), join(best.weight, "{:.6f}"), float(best.bic)]], columns=columns)

    return counts.groupBy("window").applyInPandas(fit, "window string, number_of_reads long, alpha string, beta string, ws string, bic double")


def site_positions(fits: DataFrame, windows: DataFrame) -> DataFrame:
    """The sites table: fits with utr, genomic sites (start + alpha, or end - alpha on the other strand)."""
    rows = fits.join(windows, "window")
    alpha = F.transform(F.split("alpha", ","), lambda x: x.cast("long"))
    sites = F.transform(alpha, lambda a: F.when(F.col("strand") == "+", F.col("win_start") + a).otherwise(F.col("win_end") - a))
    utr = F.concat("chrom", F.lit(":"), "win_start", F.lit("-"), "win_end", F.lit(":"), "strand")
    return rows.select(
        utr.alias("utr"), "gene_name", "transcript_name", "number_of_reads", F.array_join(F.transform(sites, lambda s: s.cast("string")), ",").alias("inferred_sites"),
        F.col("alpha").alias("alpha_arr"), F.col("beta").alias("beta_arr"), "ws", (F.col("win_end") - F.col("win_start")).alias("L"),
    )


def infer(alignments: DataFrame, exons: DataFrame, span: int = 500, barcodes: DataFrame | None = None, deduplicate: bool = False, **options) -> DataFrame:
    """The sites table from alignments (see sources.bam) and annotation exons (see sources.gtf)."""
    single = exons.filter(~F.col("gene_name").contains(","))
    windows = intervals.tss_windows(single, ["chrom", "gene_name"], "transcript_id", "start", "end", "strand", span)
    names = single.groupBy("chrom", "gene_name").agg(F.array_join(F.array_sort(F.collect_set("transcript_name")), ",").alias("transcript_name"))
    windows = windows.withColumnsRenamed({"start": "win_start", "end": "win_end"}).join(names, ["chrom", "gene_name"], "left")
    windows = windows.withColumn("window", F.concat_ws(":", "chrom", "win_start", "win_end", "strand"))
    rows = alignments.filter(reads.passes_qc(F.col("flag"), F.col("nh")) & ~reads.has(F.col("flag"), reads.MATE_UNMAPPED)).withColumn("strand", reads.strand(F.col("flag")))
    if barcodes is not None:
        rows = rows.join(barcodes.select(F.col("barcode").alias("cb")), "cb", "left_semi")
    if deduplicate:
        rows = reads.deduplicated(rows.filter(~reads.has(F.col("flag"), reads.READ2)), ["file", "chrom", "strand"], "ub", ["start", "name"]).select("name").distinct().join(rows, "name")
    one = rows.withColumn("first", ~reads.has(F.col("flag"), reads.READ2))
    key = ["chrom", "strand", "name"]
    fragments = one.groupBy(*key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.col("first").cast("int")).alias("has_first")).filter("has_first = 1")
    return site_positions(fitted_sites(offsets(fragments, windows, 2 * span), length=2 * span, **options), windows)
