"""Which isoforms a start site's fragments come from.

A fragment fits an isoform if all exon parts of its reads lie in the isoform's exons; its
length there is measured along the exons. Lengths have a normal distribution, which gives each
fragment a posterior over the isoforms it fits; their sums, normalised, weigh the isoforms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numeric import normal_pdf
from ridgeline.operators import intervals

TOLERANCE = 5


def extended(exons: DataFrame, sites: DataFrame) -> DataFrame:
    """ats, isoform, start, end: each isoform's exons, made to hold the start site.

    exons: gene_id, isoform, start, end along the gene's direction; sites: ats, gene_id, at.
    An isoform whose first exon ends before the site is left out; if the site lies within 50 of
    the first exon, all stays; else a stretch from 50 before the site is joined to that exon if it reaches it."""
    first = exons.groupBy("gene_id", "isoform").agg(F.min(F.struct("start", "end")).alias("f"))
    at = F.col("at")
    s, e = F.col("f.start"), F.col("f.end")
    fits = (at >= s - 50) & (at <= e)
    reaches = F.least(at + 200, s + 1) > s
    new = F.when(at > e, None).when(fits, s).when(reaches, F.least(s, F.greatest(F.lit(0), at - 50)))
    moved = sites.join(first, "gene_id").select("ats", "gene_id", "isoform", s.alias("first"), new.alias("new")).filter("new IS NOT NULL")
    return moved.join(exons, ["gene_id", "isoform"]).select("ats", "isoform", F.when(F.col("start") == F.col("first"), F.col("new")).otherwise(F.col("start")).alias("start"), "end")


def fragment_lengths(parts: DataFrame, exons: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """ats, frag, isoform, length: fragments all of whose parts lie in exons of the isoform, joined parts in neighbouring ones.

    parts: ats, frag, read, part (number), n_parts (of the read), start, end; exons: ats, isoform, start, end."""
    before = Window.partitionBy("ats", "isoform").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    number = F.row_number().over(Window.partitionBy("ats", "isoform").orderBy("start"))
    e = exons.select("ats", "isoform", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)).alias("offset"), number.alias("exon"))
    inside = (F.col("start") >= F.col("e_start") - tolerance) & (F.col("end") <= F.col("e_end") + tolerance)
    hit = parts.join(e, "ats").filter(inside)
    lo = F.col("offset") + F.greatest("start", "e_start") - F.col("e_start")
    hi = F.col("offset") + F.least("end", "e_end") - F.col("e_start")
    whole = hit.groupBy("ats", "frag", "read", "isoform").agg(
        F.count_distinct("part").alias("n"), F.max("n_parts").alias("n_parts"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), (F.max("exon") - F.min("exon") + 1).alias("exons")
    ).filter("n = n_parts AND exons = n_parts")
    reads = parts.groupBy("ats", "frag").agg(F.count_distinct("read").alias("reads"))
    both = whole.groupBy("ats", "frag", "isoform").agg(F.count(F.lit(1)).alias("found"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.join(reads, ["ats", "frag"]).filter("found = reads").select("ats", "frag", "isoform", (F.col("hi") - F.col("lo")).alias("length"))


def weights(lengths: DataFrame, mu: float = 300, sigma: float = 50, min_length: int = 200) -> DataFrame:
    """ats, isoform, weight. Fragments under ``min_length`` everywhere are split evenly; lengths of 0 and impossible fragments count nowhere."""
    w = Window.partitionBy("ats", "frag")
    p = F.when(F.col("length") > 0, normal_pdf(F.col("length").cast("double"), mu, sigma)).otherwise(0.0)
    rows = lengths.withColumn("p", p).withColumn("longest", F.max("length").over(w)).withColumn("many", F.count(F.lit(1)).over(w)).withColumn("all", F.sum("p").over(w))
    post = F.when(F.col("longest") < min_length, 1 / F.col("many")).otherwise(F.coalesce(F.try_divide("p", "all"), F.lit(0.0)))
    sums = rows.groupBy("ats", "isoform").agg(F.sum(post).alias("s"))
    total = sums.groupBy("ats").agg(F.sum("s").alias("t"))
    return sums.join(total, "ats").select("ats", "isoform", F.coalesce(F.try_divide("s", "t"), F.lit(0.0)).alias("weight"))


def assigned(alignments: DataFrame, annotation: DataFrame, sites: DataFrame, mu: float = 300, sigma: float = 50, min_length: int = 200) -> DataFrame:
    """ats, gene_id, transcript_ids, ws for each site that lies in one gene only (see sources.text for the inputs)."""
    from ridgeline.functions.cigar import exon_parts
    from ridgeline.operators import reads
    from ridgeline.sources.text import exons as exons_of

    e = exons_of(annotation).select("chrom", "strand", "gene_id", F.col("transcript_id").alias("isoform"), "start", "end")
    span = e.groupBy("chrom", "strand", "gene_id").agg(F.min("start").alias("g_start"), F.max("end").alias("g_end"))
    s = sites.select(F.concat_ws("_", "utr", "end").alias("ats"), "chrom", "strand", "start", "end").distinct()
    at_gene = intervals.overlap_join(s, span.withColumn("g_start", F.col("g_start") - 1000).withColumn("g_end", F.col("g_end") + 1000), ["chrom", "strand"], 10_000, ("start", "end"), ("g_start", "g_end"))
    one = at_gene.groupBy("ats").agg(F.count_distinct("gene_id").alias("genes")).filter("genes = 1")
    at_gene = at_gene.join(one, "ats", "left_semi")
    # along the gene's direction: minus-strand coordinates are turned round
    flip = lambda a, b, strand: (F.when(strand == "+", a).otherwise(-b), F.when(strand == "+", b).otherwise(-a))
    fs, fe = flip(F.col("start"), F.col("end"), F.col("strand"))
    along = e.select("gene_id", "isoform", (fs + F.lit(1 << 40)).alias("start"), (fe + F.lit(1 << 40)).alias("end"))
    moved = extended(along, at_gene.select("ats", "gene_id", (fs + F.lit(1 << 40)).alias("at")))
    rows = alignments.filter(reads.passes_qc(F.col("flag"), F.col("nh"))).withColumn("strand", reads.strand(F.col("flag")))
    window = at_gene.select("ats", "chrom", "strand", F.col("g_start").alias("ws"), F.col("g_end").alias("we"))
    near = intervals.overlap_join(rows, window, ["chrom", "strand"], 10_000, ("start", "end"), ("ws", "we"))
    parts = near.select("ats", F.col("name").alias("frag"), F.col("flag").bitwiseAND(F.lit(reads.READ2)).alias("read"), "strand", exon_parts(F.col("start"), F.col("cigar")).alias("parts"))
    parts = parts.select("ats", "frag", "read", "strand", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "x"))
    ps, pe = flip(F.col("x.start"), F.col("x.end"), F.col("strand"))
    parts = parts.select("ats", "frag", "read", "part", "n_parts", (ps + F.lit(1 << 40)).alias("start"), (pe + F.lit(1 << 40)).alias("end"))
    w = weights(fragment_lengths(parts, moved), mu, sigma, min_length)
    listed = w.groupBy("ats").agg(F.array_sort(F.collect_list(F.struct("isoform", "weight"))).alias("l"))
    genes = at_gene.select("ats", "gene_id").distinct()
    return genes.join(listed, "ats", "left").select("ats", "gene_id", F.transform("l", lambda x: x["isoform"]).alias("transcript_ids"), F.transform("l", lambda x: F.round(x["weight"], 6)).alias("ws"))
