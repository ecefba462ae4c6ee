"""Readers of the tab-separated formats. All give half-open, 0-based intervals in long columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.text import attributes


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain or gzipped file, comments and empty lines left out."""
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))


def is_gtf(spark: SparkSession, path: str) -> bool:
    """Has the first line of data eight fields or more, and attributes in one of the two forms?"""
    first = _lines(spark, path).limit(1).collect()
    if not first:
        return False
    part = first[0]["value"].split("\t")
    import re

    return len(part) >= 8 and bool(re.search(r'[\w.]+ "[^"]*"|[\w.]+=[^;]+', part[-1]))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, start, end, strand, attrs map, and the usual ids; features with RNA in their name are transcripts."""
    part = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.size(part) >= 9)
    feature = F.get(part, F.lit(2))
    attrs = attributes(F.get(part, F.lit(8)))
    rows = rows.select(
        F.get(part, F.lit(0)).alias("chrom"), F.when(feature.contains("RNA"), "transcript").otherwise(feature).alias("feature"),
        (F.get(part, F.lit(3)).cast("long") - 1).alias("start"), F.get(part, F.lit(4)).cast("long").alias("end"), F.get(part, F.lit(6)).alias("strand"), attrs.alias("attrs"),
    )
    first = lambda *names: F.coalesce(*[F.col("attrs")[n] for n in names])
    plain = lambda c: F.element_at(F.split(c, ":"), -1)
    return rows.select(
        "*", plain(first("gene_id", "Parent")).alias("gene_id"), first("gene_name", "Parent", "gene_id").alias("gene_name"),
        plain(first("transcript_id", "Parent", "ID")).alias("transcript_id"), first("transcript_name", "Name", "transcript_id").alias("transcript_name"),
        first("exon_id", "ID").alias("exon_id"),
    )


def exons(annotation: DataFrame) -> DataFrame:
    return annotation.filter("feature = 'exon'")


def genes(annotation: DataFrame) -> DataFrame:
    """chrom, strand, gene_id, start, end, transcripts (by first start, last end), each with its exons in order."""
    e = exons(annotation)
    one = e.groupBy("chrom", "strand", "gene_id", "transcript_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    return one.groupBy("chrom", "strand", "gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end"), "transcript_id", "exons"))).alias("transcripts"))


def transcript_ranges(annotation: DataFrame) -> DataFrame:
    """gene_name, ranges: the distinct ranges of a gene's transcripts."""
    return annotation.filter("feature = 'transcript'").groupBy("gene_name").agg(F.array_sort(F.collect_set(F.struct("chrom", "start", "end", "strand"))).alias("ranges"))


def sorted_copy(annotation: DataFrame, path: str, parts: int = 8) -> None:
    """A range-partitioned, sorted Parquet copy: what an index is to a text file."""
    annotation.repartitionByRange(parts, "chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(path)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, id, strand of lines with three, four or six fields; others fail the query."""
    part = F.split("value", "\t")
    n = F.size(part)
    field = lambda i: F.get(part, F.lit(i))
    fine = n.isin(3, 4, 6)
    checked = F.when(fine, field(0)).otherwise(F.raise_error(F.concat(F.lit("not 3, 4 or 6 fields: "), F.col("value"))))
    strand: Column = F.when(n == 4, field(3)).when(n == 6, field(5)).otherwise("+")
    return _lines(spark, path).select(
        checked.alias("chrom"), field(1).cast("long").alias("start"), field(2).cast("long").alias("end"),
        F.when(n == 6, field(4)).otherwise(".").alias("name"), F.when(n == 6, field(3)).otherwise(".").alias("id"), strand.alias("strand"),
    )


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The sites table, one row for each inferred site: utr, gene_name, chrom, start, end, strand. Genes with several names and bad numbers are left out."""
    rows = spark.read.csv(path, sep="\t", header=True).filter(~F.col("gene_name").contains(","))
    at = F.expr("try_cast(site AS bigint)")
    part = F.split("utr", ":")
    return (
        rows.select("*", F.explode(F.split("inferred_sites", ",")).alias("site")).withColumn("end", at).filter("end IS NOT NULL")
        .select("utr", "gene_name", F.get(part, F.lit(0)).alias("chrom"), (F.col("end") - 1).alias("start"), "end", F.get(part, F.lit(2)).alias("strand"))
    )


def triples(spark: SparkSession, path: str, barcodes: DataFrame | None = None) -> DataFrame:
    """row_id, col_id, value of a count or ratio file, plain or gzipped."""
    rows = spark.read.csv(path, sep="\t", schema="row_id string, col_id string, value double")
    return rows if barcodes is None else rows.join(barcodes.select(F.col("barcode").alias("col_id")), "col_id", "left_semi")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("barcode")).filter("barcode <> ''").distinct()


def groups(spark: SparkSession, path: str) -> DataFrame:
    """barcode, group: the first field that is a barcode and the one after it."""
    part = F.split(F.trim("value"), r"\s+")
    is_barcode = F.transform(part, lambda x: x.rlike(r"^[ATCG]+(-\d+)?$"))
    at = F.array_position(is_barcode, True).cast("int")
    rows = spark.read.text(path).select(part.alias("part"), at.alias("at")).filter("at > 0")
    return rows.select(F.get("part", F.col("at") - 1).alias("barcode"), F.get("part", F.col("at")).alias("group")).filter("group IS NOT NULL")


def bam_list(spark: SparkSession, path: str, sep: str = "\t") -> list[tuple[str, str]]:
    """(path, label) of each line; without a label the label is empty. A short list by nature."""
    rows = spark.read.csv(path, sep=sep, schema="path string, label string").collect()
    return [(r["path"], r["label"] or "") for r in rows if r["path"]]


def peaks(spark: SparkSession, path: str, chroms: DataFrame | None = None) -> DataFrame:
    """chrom, start, end of distinct peaks, of known chromosomes only if ``chroms`` is given."""
    part = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.size(part) >= 3).select(F.get(part, F.lit(0)).alias("chrom"), F.get(part, F.lit(1)).cast("long").alias("start"), F.get(part, F.lit(2)).cast("long").alias("end")).distinct()
    return rows if chroms is None else rows.join(chroms, "chrom", "left_semi")


def numbered(lines: DataFrame, column: str) -> DataFrame:
    """lines with ``column``: 1, 2, ... in the file's order. Partitions are counted first, so no task sees all lines."""
    at = lines.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn(column, _gapless(at, "_at") + 1).drop("_at")


def _gapless(rows: DataFrame, at: str) -> Column:
    """A column of increasing ids (partition and row) as numbers from 0, from the number of rows of each partition."""
    sizes = {r["p"]: r["n"] for r in rows.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    known = F.array(*[F.lit(n).cast("long") for n in offsets or [0]])
    return F.get(known, F.shiftright(at, 33).cast("int")) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))


def _one_of(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The lines of the first of these files that there is, plain or gzipped."""
    from pyspark.errors import AnalysisException

    for name in [f"{path}/{n}{z}" for n in names for z in (".gz", "")]:
        try:
            return spark.read.text(name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"{path} has none of {', '.join(names)}, plain or gzipped")


def matrix_directory(spark: SparkSession, path: str, sample: str = "", names: bool = False) -> DataFrame:
    """feature, barcode, value, and with ``names`` also name, of a directory with matrix.mtx, features.tsv (or genes.tsv) and barcodes.tsv, each plain or
    gzipped; barcodes end in _sample. A list's second field is the feature's name."""
    part = F.split("value", "\t")
    features = numbered(_one_of(spark, path, "features.tsv", "genes.tsv"), "feature_no").select("feature_no", part[0].alias("feature"), F.coalesce(F.get(part, F.lit(1)), part[0]).alias("name"))
    barcodes = numbered(_one_of(spark, path, "barcodes.tsv"), "barcode_no").select("barcode_no", part[0].alias("barcode"))
    lines = _one_of(spark, path, "matrix.mtx").filter(~F.col("value").startswith("%")).withColumn("at", F.monotonically_increasing_id())
    p = F.split(F.trim("value"), r"\s+")
    entries = lines.filter(F.col("at") > 0).select(p[0].cast("long").alias("feature_no"), p[1].cast("long").alias("barcode_no"), p[2].cast("double").alias("value"))
    out = entries.join(features, "feature_no").join(barcodes, "barcode_no")
    return out.select("feature", F.concat("barcode", F.lit(f"_{sample}" if sample else "")).alias("barcode"), "value", *(["name"] if names else []))


def shuffled(rows: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """rows with ``place``: 0, 1, ... in an order that depends only on ``key`` (unique) and the seed."""
    from ridgeline.sources.shared import stored

    order = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    mixed = stored(rows.withColumn("_order", order).orderBy("_order", key).drop("_order").withColumn("_stored_at", F.monotonically_increasing_id()), "shuffled")
    return mixed.withColumn("place", _gapless(mixed, "_stored_at")).drop("_stored_at")


def result_sites(spark: SparkSession, path: str) -> DataFrame:
    """name (gene_transcript), site of a results file: its header names the columns; sites that are no numbers are left out."""
    rows = spark.read.csv(path, sep="\t", header=True)
    sites = "inferred_sites" if "inferred_sites" in rows.columns else "infered_sites"
    each = rows.select(F.concat_ws("_", "gene_name", "transcript_name").alias("name"), F.explode(F.split(sites, ",")).alias("_site"))
    return each.select("name", F.expr("try_cast(trim(_site) AS bigint)").alias("site")).filter("site IS NOT NULL")


def fastq_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, reads: lines by four."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path).groupBy(name.alias("file")).agg((F.count(F.lit(1)) / 4).cast("long").alias("reads"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, md5 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"))


def wide_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """row_id, col_id, value of a wide file: first column the row ids (made unique by .1, .2, ...), one column for each cell."""
    from pyspark.sql import Window

    rows = spark.read.csv(path, sep=sep, header=True)
    first, *cells = rows.columns
    at = F.monotonically_increasing_id()
    numbered = rows.withColumn("_at", at).withColumn("_n", F.row_number().over(Window.partitionBy(first).orderBy("_at")) - 1)
    name = F.when(F.col("_n") == 0, F.col(f"`{first}`")).otherwise(F.concat_ws(".", F.col(f"`{first}`"), "_n"))
    return numbered.withColumn("row_id", name).unpivot("row_id", [F.col(f"`{c}`") for c in cells], "col_id", "value").select("row_id", "col_id", F.col("value").cast("double").alias("value"))


def truth_sites(spark: SparkSession, path: str) -> DataFrame:
    """name, site of a simulated truth file: the start, or on the minus strand the end."""
    part = F.split("value", "\t")
    field = lambda i: F.get(part, F.lit(i))
    return _lines(spark, path).select(field(3).alias("name"), F.when(field(5) == "+", field(1)).otherwise(field(2)).cast("long").alias("site"))
