"""python -m ridgeline.cli COMMAND: ats, isoform, count, coexp, train, filter, format."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ridgeline import sources
from ridgeline.session import session
from ridgeline.sources import sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ridgeline")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if value is bool:
                sub.add_argument(flag, action="store_true")
            elif value is str:
                sub.add_argument(flag, required=True)
            else:
                sub.add_argument(flag, default=value, type=type(value) if value is not None else str)
        return sub

    ats = command("ats", gtf=str, output=str, utr_length=500, n_max_ats=5, n_min_ats=1, min_ws=0.01, min_reads=10, max_unif_ws=0.1, max_beta=50, barcodes=None, remove_duplicate_umi=bool)
    ats.add_argument("bams", nargs="+")
    iso = command("isoform", ats=str, gtf=str, output=str, mu_f=300.0, sigma_f=50.0, min_frag_length=200, compress=bool)
    iso.add_argument("bams", nargs="+")
    command("count", ats=str, bam_list=str, output=str, delimiter="\t", compress=bool, bulk=bool)
    command("coexp", input=str, output=str, distance=1000, barcode=None, spearman=bool, group_info=None)
    command("train", atac=str, cage=str, output=str, genome=str, sample_size=1000, test_size=0.3, classifier="rf")
    kept = command("filter", infile=str, bigwig=None, output=str, classifier=None)
    kept.add_argument("bams", nargs="*")
    command("format", input=str, output=str, psi=None, min=0.0, reference=None)
    return top


def load(spark, bams: list[str]):
    return spark.read.format("bam").load(",".join(bams))


def run_ats(spark, a) -> None:
    from ridgeline.plans.ats import infer

    barcodes = text.whitelist(spark, a.barcodes) if a.barcodes else None
    found = infer(
        load(spark, a.bams), text.exons(text.gtf(spark, a.gtf)), a.utr_length, barcodes, a.remove_duplicate_umi,
        max_sites=a.n_max_ats, min_sites=a.n_min_ats, min_weight=a.min_ws, min_reads=a.min_reads, max_beta=a.max_beta, max_uniform=a.max_unif_ws,
    )
    sinks.table(found, a.output)


def run_isoform(spark, a) -> None:
    from ridgeline.plans.isoform import assigned

    sinks.isoforms(assigned(load(spark, a.bams), text.gtf(spark, a.gtf), text.sites(spark, a.ats), a.mu_f, a.sigma_f, a.min_frag_length), a.output, a.compress)


def run_count(spark, a) -> None:
    from ridgeline.plans import counting

    listed = text.bam_list(spark, a.bam_list, a.delimiter)
    sites = counting.transcripts_as_sites(text.gtf(spark, a.ats)) if a.ats.removesuffix(".gz").endswith(("gtf", "gff")) else counting.sites_as_rows(text.sites(spark, a.ats))
    found = counting.counts(load(spark, [p for p, _ in listed]), sites, dict(listed), a.bulk).persist()
    sinks.counts(found, a.output + ".count", a.compress)
    sinks.counts(counting.psi(found), a.output + ".psi", a.compress)
    found.unpersist()


def run_coexp(spark, a) -> None:
    from ridgeline.plans.coexpression import coexpression

    barcodes = text.whitelist(spark, a.barcode) if a.barcode else None
    groups = text.groups(spark, a.group_info) if a.group_info else None
    sinks.table(coexpression(text.triples(spark, a.input, barcodes), a.distance, a.spearman, groups), a.output, header=False)


def centres(peaks):
    return peaks.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("at")).distinct()


def run_train(spark, a) -> None:
    from ridgeline.plans import classify, peaks
    from ridgeline.sources.bigwig import window_vectors

    sizes = spark.read.csv(a.genome, sep="\t", schema="chrom string, size long")
    positive = centres(text.peaks(spark, a.cage, sizes.select("chrom")))
    negative = peaks.random_sites(spark, sizes, a.sample_size * 4)
    rows = peaks.balanced(peaks.labelled(positive, negative), a.sample_size)
    vectors = window_vectors(rows, a.atac).withColumnRenamed("features", "embedding")
    model, accuracy = classify.train_test(vectors, a.classifier, a.test_size)
    model.write().overwrite().save(a.output)
    print(f"accuracy on held-out rows: {accuracy:.4f}")


def run_filter(spark, a) -> None:
    from pyspark.ml.util import DefaultParamsReader

    from ridgeline.plans.classify import features
    from ridgeline.plans.similarity import similarities, start_histograms
    from ridgeline.sources.bigwig import window_vectors

    if not (a.classifier and a.bigwig) and not a.bams:
        raise SystemExit("give a classifier and its signal, or alignments")
    sites = text.sites(spark, a.infile)
    if a.classifier:
        model = DefaultParamsReader.loadParamsInstance(a.classifier, spark.sparkContext)
        vectors = window_vectors(sites.select("chrom", F.col("end").alias("at")).distinct(), a.bigwig).withColumnRenamed("features", "embedding")
        said = model.transform(features(vectors.withColumn("label", F.lit(0)))).select("chrom", F.col("at").alias("end"), F.when(F.col("prediction") == 1, "true").otherwise("false").alias("predict"))
        sites = sites.join(said, ["chrom", "end"], "left")
    else:
        sites = sites.withColumn("predict", F.lit(None).cast("string"))
    if a.bams:
        hist = start_histograms(load(spark, a.bams), sites).withColumn("site", F.concat_ws("_", "utr", "end"))
        near = similarities(hist, "site", "pos", "n")
        sites = sites.withColumn("site", F.concat_ws("_", "utr", "end")).join(near, "site", "left")
    else:
        sites = sites.withColumn("similarity", F.lit(None).cast("double"))
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("na")).alias(c)
    out = sites.groupBy("utr", "gene_name").agg(F.array_sort(F.collect_list(F.struct("end", text_or("predict"), text_or("similarity")))).alias("x"))
    join = lambda f: F.array_join(F.transform("x", lambda v: v[f].cast("string")), ",").alias(f)
    sinks.table(out.select("utr", "gene_name", join("end").alias("inferred_sites"), join("predict"), join("similarity")), a.output)


def run_format(spark, a) -> None:
    counts = text.triples(spark, a.input)
    columns = [r["barcode"] for r in text.whitelist(spark, a.reference).orderBy("barcode").collect()] if a.reference else [r["col_id"] for r in counts.select("col_id").distinct().orderBy("col_id").collect()]
    sinks.wide_matrix(counts, a.output, columns, a.min)
    if a.psi:
        valid = counts.groupBy("row_id").agg(F.sum("value").alias("t")).filter(F.col("t") > a.min)
        sinks.wide_matrix(text.triples(spark, a.psi).join(valid, "row_id", "left_semi"), a.output + ".psi", columns, -1)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session(f"ridgeline {a.command}")
    sources.register(spark)
    globals()[f"run_{a.command}"](spark, a)


if __name__ == "__main__":
    main()
