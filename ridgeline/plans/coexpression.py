"""Correlation of nearby sites on opposite strands over all cells, of all cells or of each group of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.tails import correlation_p
from ridgeline.functions.text import parse_region
from ridgeline.operators import intervals, quant


def located(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] row_id, chrom, strand, at of every site; row_id is ``chrom:start-end:strand_site``."""
    utr = F.regexp_extract("row_id", r"^(.*)_(\d+)$", 1)
    chrom, _, _, strand = parse_region(utr)
    at = F.expr("try_cast(nullif(regexp_extract(row_id, '_(\\\\d+)$', 1), '') AS bigint)")
    return counts.select(*by, "row_id").distinct().select(*by, "row_id", chrom.alias("chrom"), strand.alias("strand"), at.alias("at")).filter("at IS NOT NULL")


def neighbours(sites: DataFrame, distance: int, by: tuple[str, ...] = ()) -> DataFrame:
    """[by,] a, b: pairs of sites at most ``distance`` apart on one chromosome's two strands."""
    side = lambda s, k: sites.filter(F.col("strand") == s).select(*by, "chrom", F.col("row_id").alias(k), F.col("at").alias(f"{k}_at"))
    return intervals.band_join(side("+", "a"), side("-", "b"), [*by, "chrom"], distance, "a_at", "b_at").select(*by, "a", "b")


def ranked(counts: DataFrame, n: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Values as ranks among all cells, less the rank that the zeros share: absent cells stay 0 and correlations are Spearman's.

    n: [by,] n, the cells there are. Ranks are those of distinct values, so a site with any number of cells spreads over tasks."""
    rows = counts.filter("value <> 0")
    ranks = quant.value_ranks(rows, [*by, "row_id"], "value", {}).drop("n")
    there = rows.groupBy(*by, "row_id").agg(F.count(F.lit(1)).alias("_there"))
    there = there.join(n, list(by)) if by else there.join(F.broadcast(n))  # one row
    zeros = F.col("n") - F.col("_there")
    out = rows.join(ranks, [*by, "row_id", "value"]).join(there, [*by, "row_id"])
    return out.select(*by, "row_id", "col_id", (zeros + F.col("rank") - (zeros + 1) / 2).alias("value"))


def coexpression(counts: DataFrame, distance: int = 1000, spearman: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """[group,] a, b, r, p. counts: row_id, col_id, value (values above 0); groups: barcode, group. All groups are keys of one plan."""
    by: tuple[str, ...] = ()
    if groups is not None:
        by = ("group",)
        counts = counts.join(groups.select("group", F.col("barcode").alias("col_id")).distinct(), "col_id")
    n = counts.groupBy(*by).agg(F.count_distinct("col_id").alias("n"))
    values = ranked(counts, n, by) if spearman else counts
    pairs = neighbours(located(counts, by), distance, by)
    if by:
        r = quant.sparse_correlation(values, pairs.join(n, "group").withColumnRenamed("n", "n_cells"), "row_id", "col_id", "value", F.col("n_cells"), by)
        return r.withColumn("p", correlation_p("r", "n")).select("group", "a", "b", "r", "p")
    total = n.first()["n"]
    r = quant.sparse_correlation(values, pairs, "row_id", "col_id", "value", total)
    return r.withColumn("p", correlation_p("r", F.lit(total)))
