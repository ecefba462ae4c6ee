import gzip
import struct
import zlib

import pytest

from ridgeline import sources
from ridgeline.sources import bam, bigwig, text

GTF = """#!genome
1\tx\tgene\t101\t900\t.\t+\t.\tgene_id "g1"; gene_name "A b";
1\tx\tmRNA\t101\t900\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; gene_name "A b";
1\tx\texon\t101\t200\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_id "e1";
1\tx\texon\t801\t900\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_id "e2";
2\tx\texon\t11\t20\t.\t-\t.\tID=e3;Parent=transcript:t2;gene_id=gene:g2
"""


def bgzf(data: bytes, size: int = 60_000) -> bytes:
    out = b""
    for at in [*range(0, len(data), size), None]:
        part = b"" if at is None else data[at : at + size]
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = pack.compress(part) + pack.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name: str, pos: int, ops, flag=0, ref=0, tags=b"") -> bytes:
    n = name.encode() + b"\0"
    seq = sum(k for k, o in ops if o in "MIS=X")
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(n), 60, 0, len(ops), flag, seq, -1, -1, 0) + n
    body += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(o)) for k, o in ops) + b"\x11" * ((seq + 1) // 2) + b"\xff" * seq + tags
    return struct.pack("<i", len(body)) + body


def write_bam(path, records):
    refs = b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", 10_000) for n in (b"chr1", b"chr2"))
    path.write_bytes(bgzf(b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 2) + refs + b"".join(records), 700))


@pytest.fixture()
def reads(tmp_path):
    tags = b"NHC\x01CBZACGT-1\0UBZTTTT\0XBBi\x02\0\0\0\x01\0\0\0\x02\0\0\0"
    rows = [record(f"read{i}", i * 3, [(20, "M"), (5, "D"), (10, "M")] if i % 2 else [(15, "M"), (100, "N"), (15, "M")], 0 if i % 5 else 16, i % 2, tags if i % 3 else b"") for i in range(300)]
    write_bam(tmp_path / "x.bam", rows)
    return str(tmp_path / "x.bam")


def test_bam(spark, reads):
    sources.register(spark)
    got = spark.read.format("bam").load(reads).collect()
    assert len(got) == 300
    r = {x.name: x for x in got}
    assert (r["read1"].chrom, r["read1"].start, r["read1"].end, r["read1"].cigar) == ("chr2", 3, 38, "20M5D10M")
    assert (r["read2"].end, r["read2"].nh, r["read2"].cb, r["read2"].ub) == (6 + 130, 1, "ACGT-1", "TTTT")
    assert r["read3"].cb is None and r["read5"].flag == 16


def test_bam_in_parts_gives_each_record_once(spark, reads):
    sources.register(spark)
    df = spark.read.format("bam").option("split_bytes", "900").load(reads)
    assert df.rdd.getNumPartitions() > 3
    assert sorted(r.name for r in df.select("name").collect()) == sorted(f"read{i}" for i in range(300))
    assert df.filter("chrom = 'chr2'").count() == 150


def test_not_bam(tmp_path):
    (tmp_path / "y.bam").write_bytes(bgzf(b"nothing to see"))
    with pytest.raises(ValueError):
        bam.header(str(tmp_path / "y.bam"))


def test_gtf(spark, tmp_path):
    path = tmp_path / "a.gtf.gz"
    path.write_bytes(gzip.compress(GTF.encode()))
    rows = text.gtf(spark, str(path))
    by = {(r.feature, r.exon_id): r for r in rows.collect()}
    assert by["gene", None].gene_name == "A b" and by["gene", None].start == 100 and by["gene", None].end == 900
    assert by["transcript", None].transcript_id == "t1"
    assert by["exon", "e3"].transcript_id == "t2" and by["exon", "e3"].gene_id == "g2"
    genes = {r.gene_id: r for r in text.genes(rows).collect()}
    assert genes["g1"].start == 100 and genes["g1"].end == 900 and [tuple(e) for e in genes["g1"].transcripts[0].exons] == [(100, 200), (800, 900)]
    assert text.is_gtf(spark, str(path))
    (tmp_path / "b.txt").write_text("a\tb\n")
    assert not text.is_gtf(spark, str(tmp_path / "b.txt"))


def test_bed_arities(spark, tmp_path):
    (tmp_path / "a.bed").write_text("1\t2\t9\n1\t3\t8\t-\n2\t1\t4\tid\tname\t-\n")
    got = sorted(map(tuple, text.bed(spark, str(tmp_path / "a.bed")).collect()))
    assert got == [("1", 2, 9, ".", ".", "+"), ("1", 3, 8, ".", ".", "-"), ("2", 1, 4, "name", "id", "-")]
    (tmp_path / "b.bed").write_text("1\t2\n")
    with pytest.raises(Exception, match="not 3, 4 or 6"):
        text.bed(spark, str(tmp_path / "b.bed")).collect()


def test_sites_triples_groups(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("utr\tgene_name\tinferred_sites\n1:5-99:+\tg\t10,x,30\n1:5-99:+\tg,h\t7\n")
    assert [(r.start, r.end, r.strand) for r in text.sites(spark, str(tmp_path / "s.tsv")).orderBy("end").collect()] == [(9, 10, "+"), (29, 30, "+")]
    (tmp_path / "t.gz").write_bytes(gzip.compress(b"r\tAC-1\t2\nr\tGG-1\t0.5\n"))
    white = spark.createDataFrame([("AC-1",)], "barcode string")
    assert [tuple(r) for r in text.triples(spark, str(tmp_path / "t.gz"), white).select("row_id", "col_id", "value").collect()] == [("r", "AC-1", 2.0)]
    (tmp_path / "g.txt").write_text("1 ACGT-1 Tcell\n2 GGCA Bcell x\nno barcode\n")
    assert sorted(map(tuple, text.groups(spark, str(tmp_path / "g.txt")).collect())) == [("ACGT-1", "Tcell"), ("GGCA", "Bcell")]


def test_matrix_directory(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 5\n2 2 7\n")
    (tmp_path / "features.tsv").write_text("g1\tA\ng2\tB\n")
    (tmp_path / "barcodes.tsv").write_text("AC\nGT\n")
    assert sorted(map(tuple, text.matrix_directory(spark, str(tmp_path), "s").collect())) == [("g1", "AC_s", 5.0), ("g2", "GT_s", 7.0)]


def write_bigwig(path):
    """Two chromosomes, one block each: bedGraph and fixed steps."""
    blocks = [
        struct.pack("<IIIIIBBH", 0, 10, 30, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 10, 20, 1.5, 25, 30, 2.0),
        struct.pack("<IIIIIBBH", 1, 100, 115, 5, 5, 3, 0, 3) + struct.pack("<fff", 1, 2, 3),
    ]
    packed = [zlib.compress(b) for b in blocks]
    tree = struct.pack("<IIIIQQ", bigwig.CHROM_TREE, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chr1" + struct.pack("<II", 0, 1000) + b"chr2" + struct.pack("<II", 1, 1000)
    data_at = 64 + len(tree)
    index_at = data_at + 4 + sum(map(len, packed))
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX, 256, 2, 0, 10, 1, 115, 0, 1, 0) + struct.pack("<BBH", 1, 0, 2)
    index += struct.pack("<IIIIQQ", 0, 10, 0, 30, data_at + 4, len(packed[0])) + struct.pack("<IIIIQQ", 1, 100, 1, 115, data_at + 4 + len(packed[0]), len(packed[1]))
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 4096, 0)
    path.write_bytes(head + tree + struct.pack("<I", 2) + b"".join(packed) + index)


def test_bigwig(spark, tmp_path):
    write_bigwig(tmp_path / "x.bw")
    sources.register(spark)
    df = spark.read.format("bigwig").load(str(tmp_path / "x.bw"))
    assert sorted(map(tuple, df.collect())) == [("chr1", 10, 20, 1.5), ("chr1", 25, 30, 2.0), ("chr2", 100, 105, 1.0), ("chr2", 105, 110, 2.0), ("chr2", 110, 115, 3.0)]
    centres = spark.createDataFrame([("chr1", 20), ("chr2", 900)], "chrom string, at long")
    got = {r.chrom: r.features for r in bigwig.feature_vectors(df, centres, 10).collect()}
    assert got["chr1"] == [1.5] * 10 + [0.0] * 5 + [2.0] * 5 and got["chr2"] == [0.0] * 20


def test_prefix(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("chr1",), ("2",)], "c string")
    assert [r.x for r in df.select(bam.same_prefix(F.col("c"), "chrX").alias("x")).collect()] == ["chr1", "chr2"]
    assert [r.x for r in df.select(bam.same_prefix(F.col("c"), "X").alias("x")).collect()] == ["1", "2"]


def test_wide_matrix_and_truth(spark, tmp_path):
    (tmp_path / "w.csv").write_text(",c1,c.2\ng,1,2\ng,3,4\nh,5,\n")
    got = sorted(map(tuple, text.wide_matrix(spark, str(tmp_path / "w.csv")).filter("value IS NOT NULL").collect()))
    assert got == [("g", "c.2", 2.0), ("g", "c1", 1.0), ("g.1", "c.2", 4.0), ("g.1", "c1", 3.0), ("h", "c1", 5.0)]
    (tmp_path / "t.bed").write_text("1\t5\t9\tg_t\t0\t+\n1\t5\t9\th_t\t1\t-\n")
    assert sorted(map(tuple, text.truth_sites(spark, str(tmp_path / "t.bed")).collect())) == [("g_t", 5), ("h_t", 9)]


def test_matrix_directory_gzipped(spark, tmp_path):
    for name, body in (("matrix.mtx.gz", "%%MatrixMarket matrix\n%c\n2 2 2\n1 1 5\n2 2 7\n"), ("features.tsv.gz", "g1\tA\tGene Expression\ng2\tB\tGene Expression\n"), ("barcodes.tsv.gz", "AC\nGT\n")):
        (tmp_path / name).write_bytes(gzip.compress(body.encode()))
    assert sorted(map(tuple, text.matrix_directory(spark, str(tmp_path), names=True).collect())) == [("g1", "AC", 5.0, "A"), ("g2", "GT", 7.0, "B")]
    with pytest.raises(FileNotFoundError, match="genes.tsv"):
        text.matrix_directory(spark, str(tmp_path / "nowhere"))


def test_lines_are_numbered_over_partitions(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{i} {j}\n" for j in range(40)))
    rows = text.numbered(spark.read.text(str(tmp_path)).repartitionByRange(5, "value").sortWithinPartitions("value"), "no").collect()
    assert [r.no for r in sorted(rows, key=lambda r: r.value)] == list(range(1, 121))


def test_shuffled_is_a_permutation_that_the_seed_decides(spark):
    rows = spark.range(500)
    one, two = (sorted((r.place, r.id) for r in text.shuffled(df, df.id).collect()) for df in (rows, rows.repartition(7)))
    assert one == two and [p for p, _ in one] == list(range(500)) and [i for _, i in one] != list(range(500))
    assert one != sorted((r.place, r.id) for r in text.shuffled(rows, rows.id, 7).collect())


def test_result_sites(spark, tmp_path):
    (tmp_path / "r.txt").write_text("gene_name\ttranscript_name\tinfered_sites\ng\tt\t5, 9\ng\tu\tx\n")
    assert sorted(map(tuple, text.result_sites(spark, str(tmp_path / "r.txt")).collect())) == [("g_t", 5), ("g_t", 9)]
