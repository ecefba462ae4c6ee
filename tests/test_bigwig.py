"""BigWig files with a tree of two levels and zoom levels: what is asked for is read, and nothing else."""

import random
import struct
import zlib

import numpy as np
import pytest

from ridgeline import sources
from ridgeline.sources import bigwig
from ridgeline.sources.bigwig import BigWig

CHROMS = [("chr1", 400_000), ("chr2", 90_000)]
ZOOM = 100


def tree(entries, at, fan=8):
    """Index bytes for blocks (chrom, start, end, offset, size), in leaves of ``fan`` under one root."""
    leaves = [entries[i : i + fan] for i in range(0, len(entries), fan)]
    head = struct.pack("<IIQIIIIQII", bigwig.INDEX, 256, len(entries), 0, 0, 1, 1 << 31, 0, 1, 0)
    place, root, body = at + 48 + 4 + 24 * len(leaves), b"", b""
    for leaf in leaves:
        root += struct.pack("<IIIIQ", leaf[0][0], leaf[0][1], leaf[-1][0], leaf[-1][2], place + len(body))
        body += struct.pack("<BBH", 1, 0, len(leaf)) + b"".join(struct.pack("<IIIIQQ", c, s, c, e, o, n) for c, s, e, o, n in leaf)
    return head + struct.pack("<BBH", 0, 0, len(leaves)) + root + body


def write(path, signal, per=40):
    """signal: chromosome -> values by position (NaN: none). Blocks of ``per`` runs of equal values."""
    chroms = struct.pack("<IIIIQQ", bigwig.CHROM_TREE, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"".join(n.encode() + struct.pack("<II", i, size) for i, (n, size) in enumerate(CHROMS))
    data, blocks, zoom, at = b"", [], [], 64 + 24 + len(chroms) + 4
    for number, (name, _) in enumerate(CHROMS):
        x = signal[name]
        cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))]))
        runs = [(int(s), int(e), float(x[s])) for s, e in zip(cut, np.append(cut[1:], len(x)), strict=True) if not np.isnan(x[s])]
        for i in range(0, len(runs), per):
            some = runs[i : i + per]
            raw = zlib.compress(struct.pack("<IIIIIBBH", number, some[0][0], some[-1][1], 0, 0, 1, 0, len(some)) + b"".join(struct.pack("<IIf", *r) for r in some))
            blocks.append((number, some[0][0], some[-1][1], at + len(data), len(raw)))
            data += raw
        for s in range(0, len(x), ZOOM):
            v = x[s : s + ZOOM][~np.isnan(x[s : s + ZOOM])]
            if len(v):
                zoom.append((number, s, min(s + ZOOM, len(x)), len(v), v.min(), v.max(), v.sum(), (v * v).sum()))
    index_at = at + len(data)
    index = tree(blocks, index_at)
    zoom_at, zdata, zblocks = index_at + len(index) + 4, b"", []
    for number in (0, 1):
        mine = [z for z in zoom if z[0] == number]
        for i in range(0, len(mine), 64):
            raw = zlib.compress(b"".join(struct.pack("<IIIIffff", *z) for z in mine[i : i + 64]))
            zblocks.append((number, mine[i][1], mine[i : i + 64][-1][2], zoom_at + len(zdata), len(raw)))
            zdata += raw
    zindex = tree(zblocks, zoom_at + len(zdata))
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 1, 64 + 24, at - 4, index_at, 0, 0, 0, 0, 4096, 0)
    head += struct.pack("<IIQQ", ZOOM, 0, zoom_at - 4, zoom_at + len(zdata))
    path.write_bytes(head + chroms + struct.pack("<I", len(blocks)) + data + index + struct.pack("<I", len(zoom)) + zdata + zindex)


@pytest.fixture(scope="module")
def signal():
    rng = random.Random(4)
    out = {}
    for name, size in CHROMS:
        x = np.full(size, np.nan)
        at = 0
        while at < size:
            n = rng.randrange(5, 120)
            if rng.random() < 0.8:
                x[at : at + n] = rng.randrange(1, 50) / 4
            at += n
        out[name] = x
    return out


@pytest.fixture(scope="module")
def path(tmp_path_factory, signal):
    at = tmp_path_factory.mktemp("bw") / "x.bw"
    write(at, signal)
    return str(at)


def at(x, lo, hi):
    return np.array([0.0 if p < 0 or p >= len(x) or np.isnan(x[p]) else x[p] for p in range(lo, hi)])


def test_whole_and_regions(spark, path, signal):
    sources.register(spark)
    every = spark.read.format("bigwig").load(path)
    assert every.selectExpr("sum((end - start) * value)").first()[0] == pytest.approx(sum(np.nansum(x) for x in signal.values()))
    want = sorted(tuple(r) for r in every.collect() if r.chrom == "chr1" and r.start < 120_000 and r.end > 100_000)
    assert sorted(map(tuple, every.filter("chrom = 'chr1' AND start < 120000 AND end > 100000").collect())) == want
    by_option = spark.read.format("bigwig").option("regions", "chr1:100000-120000,chr1:110000-120000").load(path)
    assert [r for r in sorted(map(tuple, by_option.collect())) if r[1] < 120_000 and r[2] > 100_000] == want and by_option.count() < 2 * len(want) + 100
    assert spark.read.format("bigwig").option("regions", "chr9").load(path).count() == 0


def test_filters_cut_the_tree(path):
    reader = bigwig.BigWigReader({"path": path, "regions": "chr1:100000-100500"})
    few, every = sum(len(p.blocks) for p in reader.partitions()), sum(len(p.blocks) for p in bigwig.BigWigReader({"path": path}).partitions())
    assert few <= 2 and every > 80
    with BigWig(path) as f:
        f.blocks(0, 100_000, 100_500)
        assert f.nodes <= 3
        f.blocks()
        assert f.nodes > 10


def test_vectors_open_few_blocks(path, signal):
    with BigWig(path) as f:
        for lo in (-200, 0, 777, 200_000, 399_800):
            assert (f.vector("chr1", lo, lo + 1000) == at(signal["chr1"], lo, lo + 1000)).all()
        assert f.opened <= 12
        assert (f.vector("2", 50, 90) == at(signal["chr2"], 50, 90)).all() and not f.vector("chrX", 0, 50).any()


def test_window_vectors_equal_the_join(spark, path, signal):
    sources.register(spark)
    rng = random.Random(1)
    rows = [(rng.choice(["chr1", "chr2"]), rng.randrange(90_000), i) for i in range(40)] + [("chr1", 399_990, 90), ("chr1", 3, 91), ("chr7", 50, 92), (None, 5, 93), ("chr1", None, 94)]
    centres = spark.createDataFrame(rows, "chrom string, at long, features long")
    got = {(r.chrom, r["at"]): r.features for r in bigwig.window_vectors(centres.withColumn("i", centres.features), path, 50).collect()}
    assert len(got) == len(rows) and got["chr1", None] is None
    for c, p, _ in rows:
        if p is not None:
            assert got[c, p] == at(signal.get(c, np.zeros(0)), p - 50, p + 50).tolist()
    plain = bigwig.feature_vectors(spark.read.format("bigwig").load(path), centres.drop("features").filter("chrom IN ('chr1', 'chr2') AND at > 60 AND at < 90000"), 50)
    assert all(got[r.chrom, r["at"]] == r.features for r in plain.collect())


def test_means_by_zoom(spark, path, signal):
    def plain(c, lo, hi, bins):
        cuts = [signal[c][lo + (hi - lo) * i // bins : lo + (hi - lo) * (i + 1) // bins] for i in range(bins)]
        return [np.nanmean(v) for v in cuts]

    with BigWig(path) as f:
        assert f.means("chr1", 10_000, 11_000, 10, exact=True) == pytest.approx(plain("chr1", 10_000, 11_000, 10))
        before = f.opened
        assert f.means("chr1", 0, 400_000, 8) == pytest.approx(plain("chr1", 0, 400_000, 8), rel=1e-5)
        assert f.opened - before <= 70  # summaries, not values
        assert f.means("chr1", 20_050, 60_050, 10) == pytest.approx(plain("chr1", 20_050, 60_050, 10), rel=0.02)
        assert np.isnan(f.means("chrX", 0, 100, 2)).all()
    centres = spark.createDataFrame([("chr1", 30_000), ("chr2", 45_000)], "chrom string, at long")
    got = {r.chrom: r.means for r in bigwig.window_means(centres, path, 20_000, 4).collect()}
    assert got["chr1"] == pytest.approx(plain("chr1", 10_000, 50_000, 4), rel=1e-5)


def test_damaged(path, tmp_path):
    data = open(path, "rb").read()
    (tmp_path / "cut.bw").write_bytes(data[: len(data) // 5])
    with pytest.raises(ValueError):
        bigwig.BigWigReader({"path": str(tmp_path / "cut.bw")}).partitions()
    (tmp_path / "no.bw").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no BigWig"):
        BigWig(str(tmp_path / "no.bw"))
