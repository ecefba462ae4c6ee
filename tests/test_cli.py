"""The commands end to end on small files, and the stream extension."""

import random

import pytest
from test_sources import record, write_bam, write_bigwig

from ridgeline import cli, sources


@pytest.fixture()
def world(spark, tmp_path):
    """One gene on each strand, with reads around their start sites."""
    sources.register(spark)
    gtf = []
    for gene, strand, exons in (("ga", "+", [(1001, 1300), (2001, 2300)]), ("gb", "-", [(4001, 4300), (5001, 5300)])):
        for n, (s, e) in enumerate(exons):
            gtf.append(f'chr1\tx\texon\t{s}\t{e}\t.\t{strand}\t.\tgene_id "{gene}"; gene_name "{gene}"; transcript_id "t{gene}"; transcript_name "T{gene}"; exon_id "{gene}{n}";')
        s, e = exons[0][0], exons[-1][1]
        gtf.append(f'chr1\tx\ttranscript\t{s}\t{e}\t.\t{strand}\t.\tgene_id "{gene}"; gene_name "{gene}"; transcript_id "t{gene}"; transcript_name "T{gene}";')
    (tmp_path / "a.gtf").write_text("\n".join(gtf) + "\n")
    rng = random.Random(2)
    tags = lambda i: b"NHC\x01CBZ" + random.Random(i).choice([b"ACGT-1", b"GGTT-1"]) + b"\0UBZU%d\0" % (i % 40)
    rows = [record(f"p{i}", max(0, round(rng.gauss(1010, 8))), [(40, "M")], 0, 0, tags(i)) for i in range(200)]
    rows += [record(f"m{i}", round(rng.gauss(5250, 8)), [(40, "M")], 16, 0, tags(i)) for i in range(200)]
    write_bam(tmp_path / "x.bam", rows)
    return tmp_path


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_ats_count_isoform_coexp(spark, world):
    out = lambda n: str(world / n)
    cli.main(["ats", "--gtf", out("a.gtf"), "--output", out("sites"), "--n-max-ats", "2", out("x.bam")])
    header, *rows = [x for x in lines(world / "sites")]
    assert header.split("\t")[:3] == ["utr", "gene_name", "transcript_name"]
    rows = [r for r in rows if r != header]
    found = {r.split("\t")[1]: int(r.split("\t")[4].split(",")[0]) for r in rows}
    assert abs(found["ga"] - 1010) < 10 and abs(found["gb"] - 5290) < 10

    (world / "list").write_text(out("x.bam") + "\tS1\n")
    cli.main(["count", "--ats", out("sites"), "--bam-list", out("list"), "--output", out("n")])
    counts = [r.split("\t") for r in lines(world / "n.count")]
    assert {c[1] for c in counts} <= {"ACGT-1_S1", "GGTT-1_S1"} and all(0 < float(c[2]) <= 40 for c in counts)
    psi = [r.split("\t") for r in lines(world / "n.psi")]
    assert all(0 < float(p[2]) <= 1 for p in psi)

    cli.main(["isoform", "--ats", out("sites"), "--gtf", out("a.gtf"), "--output", out("iso"), out("x.bam")])
    iso = [r.split("\t") for r in lines(world / "iso")]
    assert ["ga", "tga"] in [i[1:3] for i in iso]

    cli.main(["coexp", "--input", out("n.count"), "--output", out("co"), "--distance", "10000"])
    assert all(len(r.split("\t")) in (2, 3, 4) for r in lines(world / "co"))

    cli.main(["format", "--input", out("n.count"), "--output", out("wide"), "--psi", out("n.psi"), "--min", "1"])
    assert list((world / "wide").glob("part-*.gz")) and list((world / "wide.psi").glob("part-*.gz"))


def test_train_and_filter(spark, tmp_path):
    sources.register(spark)
    write_bigwig(tmp_path / "x.bw")
    (tmp_path / "genome").write_text("chr1\t100000\nchr2\t100000\n")
    (tmp_path / "cage.bed").write_text("".join(f"chr{1 + i % 2}\t{i * 7 % 200}\t{i * 7 % 200 + 10}\n" for i in range(60)) + "chrZ\t1\t2\n")
    out = lambda n: str(tmp_path / n)
    cli.main(["train", "--atac", out("x.bw"), "--cage", out("cage.bed"), "--output", out("model"), "--genome", out("genome"), "--sample-size", "40", "--classifier", "dt"])
    (tmp_path / "s.tsv").write_text("utr\tgene_name\tinferred_sites\nchr1:5-99:+\tg\t20,90000\n")
    cli.main(["filter", "--infile", out("s.tsv"), "--bigwig", out("x.bw"), "--output", out("f"), "--classifier", out("model")])
    assert lines(tmp_path / "f")[1].split("\t")[2:] == ["20,90000", "true,false", "na,na"]
    with pytest.raises(SystemExit):
        cli.main(["filter", "--infile", out("s.tsv"), "--output", out("f")])


def test_filter_by_similarity(spark, world):
    (world / "s.tsv").write_text("utr\tgene_name\tinferred_sites\nchr1:500-1600:+\tga\t1030,9000\n")
    cli.main(["filter", "--infile", str(world / "s.tsv"), "--output", str(world / "f"), str(world / "x.bam")])
    site, empty = lines(world / "f")[1].split("\t")[4].split(",")
    assert float(site) > 0.5 and empty == "na"


def test_simulation_and_distance(spark):
    from pyspark.sql import functions as F

    from ridgeline.plans import simulate

    sites = spark.createDataFrame([("1", 1000, "+"), ("1", 5000, "-")], "chrom string, site long, strand string")
    reads = simulate.simulated(sites)
    assert reads.count() == simulate.simulated(sites.repartition(3)).count()
    near = reads.filter("strand = '+'").agg(F.avg("start")).first()[0]
    assert abs(near - 1000) < 10
    truth = spark.createDataFrame([("g", 10), ("h", 5)], "name string, site long")
    assert sorted(map(tuple, simulate.distances(truth, spark.createDataFrame([("g", 7), ("g", 12)], "name string, site long")).collect())) == [("g", -2), ("g", 3)]


def test_stream_counts(spark, tmp_path):
    import datetime as dt

    from ridgeline.streaming.molecules import molecule_counts

    at = dt.datetime(2024, 1, 1)
    rows = [(at, "s", "u1"), (at + dt.timedelta(minutes=5), "s", "u1"), (at + dt.timedelta(minutes=9), "s", "u2"), (at + dt.timedelta(days=3), "s", "u3")]
    spark.createDataFrame(rows, "ts timestamp_ntz, site string, umi string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, site string, umi string").parquet(str(tmp_path / "in"))
    q = molecule_counts(stream, "ts", ["site"], "umi").writeStream.outputMode("update").format("memory").queryName("molecules").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("molecules").collect()) == [1, 2]
