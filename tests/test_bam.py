"""Damage, regions by index, and writing of BAM files."""

import random
import struct

import pytest
from test_sources import bgzf as packed
from test_sources import record, write_bam

from ridgeline import sources
from ridgeline.sources import bai, bam, bgzf, files

REFS = [("chr1", 200_000_000), ("chr2", 50_000), ("chrM", 16_000)]


def made(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chrom = rng.choice(["chr1", "chr1", "chr2", "chrM"])
        at = rng.randrange(dict(REFS)[chrom] - 1000) if rng.random() < 0.5 else rng.randrange(2000)
        cigar = rng.choice(["50M", "20M5D10M", "10M3000N10M", "10M2I30M"])
        rows.append((f"r{i}", rng.choice([0, 16, 99, 147]), chrom, at, 60, cigar, rng.choice([None, 1, 2]), rng.choice([None, "ACGT-1"]), rng.choice([None, "TTT"])))
    return rows + [(f"u{i}", 4, None, None, 0, "*", None, None, None) for i in range(20)]


COLUMNS = "name string, flag int, chrom string, start long, mapq int, cigar string, nh int, cb string, ub string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sources.register(spark)
    path = str(tmp_path_factory.mktemp("bam") / "out")
    bam.write_bam(spark.createDataFrame(made(), COLUMNS), path, REFS, parts=3)
    return path


def read(spark, path, **options):
    return spark.read.format("bam").options(**options).load(path)


def keyed(df):
    return sorted(map(tuple, df.select("name", "flag", "chrom", "start", "end", "mapq", "cigar", "nh", "cb", "ub").collect()), key=repr)


def test_written_reads_back(spark, folder):
    want = sorted([(*r[:4], None if r[3] is None else r[3] + {"50M": 50, "20M5D10M": 35, "10M3000N10M": 3020, "10M2I30M": 40}[r[5]], *r[4:]) for r in made()], key=repr)
    assert keyed(read(spark, folder)) == want
    found = files.listed(folder, ".bam")
    assert len(found) == 3 and all(files.size(f + ".bai") > 0 for f in found)
    last = (-1, -1)
    for f in found:  # one order over all files; nothing left of the tasks
        with bgzf.Blocks(f) as blocks:
            assert blocks.whole()
            refs, first, place = bam.header(f)
            for _, _, raw in bam.Records(blocks, len(refs), first << 16 | place, True):
                ref, lo, _ = bam.span(raw)
                key = (ref if ref >= 0 else 99, lo)
                assert key >= last
                last = key
    assert [i for i in files.store(folder)[0].get_file_info(files.pafs.FileSelector(folder)) if i.type.name == "Directory"] == []


REGIONS = [("chr1", 0, 500), ("chr1", 1_000_000, 150_000_000), ("chr2", 4_000, 4_001), ("chrM", 15_999, 20_000), ("chr1", 190_000_000, 1 << 29), ("chr3", 1, 2)]


@pytest.mark.parametrize("chrom, lo, hi", REGIONS)
def test_region_equals_filtered_scan(spark, folder, chrom, lo, hi):
    rule = f"chrom = '{chrom}' AND start < {hi} AND end > {lo}"
    want = keyed(read(spark, folder).selectExpr("*", "1 AS x").persist().filter(rule))
    assert keyed(read(spark, folder).filter(rule)) == want
    assert keyed(read(spark, folder, index="none").filter(rule)) == want
    assert keyed(read(spark, folder, regions=f"{chrom}:{lo}-{hi}")) == want


def test_several_regions_give_each_record_once(spark, folder):
    got = keyed(read(spark, folder, regions="chr1:0-300,chr1:200-900,chr2:1-2000,chrM"))
    want = keyed(read(spark, folder).filter("chrom = 'chr1' AND start < 900 AND end > 0 OR chrom = 'chr2' AND start < 2000 AND end > 1 OR chrom = 'chrM'"))
    assert got == want


def opened(path, regions, index="use"):
    """Blocks that a read inflates, besides headers, and those in the file."""
    reader = bam.BamReader({"path": path, "regions": regions, "index": index}, bam._Names(()))
    n = 0
    for part in reader.partitions():
        if part.path:
            blocks = bgzf.Blocks(part.path)
            list(reader.rows(part, blocks))
            n += blocks.opened
    return n


def test_region_opens_only_its_blocks(spark, tmp_path):
    sources.register(spark)
    rows = [(f"r{i:06d}" + "x" * 150, 0, "chr1", i * 300, 60, "50M", 1, None, None) for i in range(30_000)]
    bam.write_bam(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "o"), REFS, parts=1)
    path = files.listed(str(tmp_path / "o"), ".bam")[0]
    every, few = opened(path, None), opened(path, "chr1:4500000-4510000")
    assert every > 90 and few <= 4
    assert opened(path, "chr1:4500000-4510000", "none") == every and opened(path, "chr2:1-50000") == 0


def test_missing_index_is_made(spark, folder, tmp_path):
    """From a file in many splits; the same answers, and unsorted files are refused."""
    one = files.listed(folder, ".bam")[0]
    (tmp_path / "a.bam").write_bytes(files.read_all(one))
    want = bai.Index.parse(files.read_all(one + ".bai"))
    assert bam.index_of(str(tmp_path / "a.bam")) is None
    old = bam.SPLIT_BYTES
    try:
        bam.SPLIT_BYTES = 9_000
        assert bam.index_bam(spark, str(tmp_path / "a.bam")) == [str(tmp_path / "a.bam")]
    finally:
        bam.SPLIT_BYTES = old
    assert bam.index_bam(spark, str(tmp_path / "a.bam")) == []
    got = bam.index_of(str(tmp_path / "a.bam"))
    for a, b in zip(got.references, want.references, strict=True):
        begins = lambda r: {k: [c[0] for c in bai.joined(v)] for k, v in r.bins.items()}  # noqa: E731  (an end may be a block's end or the next one's start)
        assert a.linear == b.linear and begins(a) == begins(b)
    rule = "chrom = 'chr1' AND start < 70000000 AND end > 100"
    assert keyed(read(spark, str(tmp_path / "a.bam")).filter(rule)) == keyed(read(spark, one, index="none").filter(rule))
    write_bam(tmp_path / "b.bam", [record("a", 50, [(5, "M")]), record("b", 10, [(5, "M")])])
    with pytest.raises(Exception, match="sorted"):
        bam.index_bam(spark, str(tmp_path / "b.bam"))


def test_damage_is_an_error(spark, folder, tmp_path):
    sources.register(spark)
    data = bytearray(files.read_all(files.listed(folder, ".bam")[0]))
    whole = len(data)
    half = tmp_path / "half.bam"
    half.write_bytes(bytes(data[: whole // 2]))
    with pytest.raises(Exception, match="cut short"):
        read(spark, str(half)).count()
    with bgzf.Blocks(str(half)) as blocks, pytest.raises(bgzf.Damaged):
        refs, first, place = bam.header(str(half))
        list(bam.Records(blocks, len(refs), first << 16 | place, True))
    for i in range(40):
        data[whole // 2 + i] ^= 0xFF
    (tmp_path / "hurt.bam").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|checksum|no block"):
        read(spark, str(tmp_path / "hurt.bam")).count()


def test_damage_can_be_skipped(spark, tmp_path):
    sources.register(spark)
    rows = [record(f"read{i}", i * 3, [(20, "M")]) for i in range(6000)]
    write_bam(tmp_path / "x.bam", rows)
    data = bytearray((tmp_path / "x.bam").read_bytes())
    for i in range(20):
        data[len(data) // 2 + i] ^= 0xFF
    (tmp_path / "x.bam").write_bytes(bytes(data))
    got = read(spark, str(tmp_path / "x.bam"), damaged="skip")
    assert 5950 < got.count() < 6000 and got.select("name").distinct().count() == got.count()
    (tmp_path / "x.bam").write_bytes(bytes(data[:-40]))
    assert 5900 < read(spark, str(tmp_path / "x.bam"), damaged="skip").count() < 6000


def test_record_cut_at_a_block_border(tmp_path):
    body = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100) + record("a", 1, [(5, "M")])
    (tmp_path / "x.bam").write_bytes(packed(body[:-7]))
    with bgzf.Blocks(str(tmp_path / "x.bam")) as blocks, pytest.raises(bgzf.Damaged, match="within a record"):
        list(bam.Records(blocks, 1, bam.header(str(tmp_path / "x.bam"))[1] << 16 | bam.header(str(tmp_path / "x.bam"))[2], True))


def test_subset_keeps_records_whole(spark, folder, tmp_path):
    names = spark.createDataFrame([(f"r{i}",) for i in range(0, 3000, 7)] + [("u3",), ("nobody",)], "name string")
    bam.subset(spark, folder, names, str(tmp_path / "s"))
    raw = lambda p: {r.name: bytes(r.raw) for r in read(spark, p, raw="true").collect()}
    every, some = raw(folder), raw(str(tmp_path / "s"))
    assert some == {n: every[n] for n in [f"r{i}" for i in range(0, 3000, 7)] + ["u3"]}
    bam.subset(spark, folder, names.filter("name = 'nobody'"), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")).count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    sources.register(spark)
    with pytest.raises(Exception, match="no such reference"):
        bam.write_bam(spark.createDataFrame(made(), COLUMNS).selectExpr("*").replace("chrM", "chrX", "chrom"), str(tmp_path / "o"), REFS, parts=2)
    assert list(tmp_path.glob("o/*")) == []
    bam.write_bam(spark.createDataFrame(made(n=10), COLUMNS), str(tmp_path / "o"), REFS)
    bam.write_bam(spark.createDataFrame(made(n=20), COLUMNS), str(tmp_path / "o"), REFS, mode="overwrite")
    assert read(spark, str(tmp_path / "o")).count() == 40


def test_bins_of_the_format():
    rng = random.Random(3)
    for _ in range(2000):
        lo = rng.randrange(bai.LONGEST - 1)
        hi = min(bai.LONGEST, lo + 1 + int(rng.expovariate(1e-4)))
        a = rng.randrange(bai.LONGEST - 1)
        b = min(bai.LONGEST, a + 1 + int(rng.expovariate(1e-6)))
        if lo < b and hi > a:
            assert bai.bin_of(lo, hi) in bai.bins_over(a, b)
    assert bai.bin_of(0, 1) == 4681 and bai.bin_of(0, 1 << 29) == 0 and bai.bins_over(0, 1)[-1] == 4681
