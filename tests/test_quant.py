import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import quant, reads
from ridgeline.plans import coexpression, isoform, peaks

TRIPLES = [("u1", "a", "c1", 2), ("u1", "b", "c1", 6), ("u1", "a", "c2", 5), ("u2", "z", "c1", 4)]


def test_psi_sums_to_one(spark):
    df = spark.createDataFrame(TRIPLES, "utr string, row string, cell string, v long")
    out = quant.psi(df, "utr", "row", "cell", "v")
    assert {(r.row, r.cell): r.psi for r in out.collect()} == {("a", "c1"): 0.25, ("b", "c1"): 0.75, ("a", "c2"): 1.0, ("z", "c1"): 1.0}
    assert all(abs(r.s - 1) < 1e-12 for r in out.groupBy("utr", "cell").agg(F.sum("psi").alias("s")).collect())
    assert {r.utr for r in quant.psi(df, "utr", "row", "cell", "v", 1).collect()} == {"u1"}


def test_psi_of_zero_total_is_null(spark):
    df = spark.createDataFrame([("u", "a", "c", 0)], "utr string, row string, cell string, v long")
    assert quant.psi(df, "utr", "row", "cell", "v").first().psi is None


def test_sparse_correlation_counts_absent_cells(spark):
    import numpy as np

    values = [("a", 0, 1.0), ("a", 1, 2.0), ("b", 1, 4.0), ("b", 2, 1.0), ("c", 0, 1.0)]
    df = spark.createDataFrame(values, "row string, cell long, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zero")], "a string, b string")
    got = {r.b: r.r for r in quant.sparse_correlation(df, pairs, "row", "cell", "v", 4).collect()}
    a = [1, 2, 0, 0]
    assert got["b"] == pytest.approx(np.corrcoef(a, [0, 4, 1, 0])[0, 1]) and got["c"] == pytest.approx(np.corrcoef(a, [1, 0, 0, 0])[0, 1])
    assert got["zero"] is None


def test_spearman_with_implicit_zeros(spark):
    import numpy as np

    dense = {"chr1:0-9:+_5": [3, 0, 0, 1, 1], "chr1:0-9:-_8": [2, 0, 1, 0, 2]}
    rows = [(r, f"c{i}", float(v)) for r, vs in dense.items() for i, v in enumerate(vs) if v]
    got = coexpression.coexpression(spark.createDataFrame(rows + [("chr9:0-1:+_1", "c1", 1.0)], "row_id string, col_id string, value double"), 100, True).collect()

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    assert len(got) == 1 and got[0].r == pytest.approx(np.corrcoef(*map(rank, dense.values()))[0, 1])


def test_first_last_dedup_pairs(spark):
    df = spark.createDataFrame([(1, "a", 5, "u"), (1, "b", 3, "u"), (2, "c", 1, None)], "k long, name string, at long, ub string")
    assert {r.name for r in reads.first_per_key(df, ["k"], ["at"]).collect()} == {"b", "c"}
    assert {r.name for r in reads.last_per_key(df, ["k"], "at").collect()} == {"a", "c"}
    assert [r.name for r in reads.deduplicated(df, ["k"], "ub", ["at"]).collect()] == ["b"]
    mates = spark.createDataFrame([("r", True, 1, 5), ("r", False, 8, 12), ("s", True, 2, 6)], "name string, first boolean, start long, end long")
    assert sorted(map(tuple, reads.paired(mates, "name", F.col("first"), "left").collect())) == [("r", 1, 12), ("s", 2, 6)]
    assert [tuple(r) for r in reads.paired(mates, "name", F.col("first")).collect()] == [("r", 1, 12)]


def test_flags(spark):
    df = spark.createDataFrame([(0, 1), (4, 1), (1, 1), (3, 1), (3, 2), (512, None)], "flag int, nh int")
    assert [r.ok for r in df.select(reads.passes_qc(F.col("flag"), F.col("nh")).alias("ok")).collect()] == [True, False, False, True, False, False]


def test_rank_sum_of_separated_groups(spark):
    df = spark.createDataFrame([("k", i, i < 3) for i in range(6)], "k string, v long, one boolean")
    r = quant.rank_sum(df, ["k"], F.col("one"), "v").first()
    assert (r.n1, r.n2, r.u, r.auc) == (3, 3, 0.0, 0.0) and r.z < -1.9


def test_value_ranks(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(60)) for _ in range(500)]
    got = {(r.k, r.v): r.rank for r in quant.value_ranks(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", {}, 8).collect()}
    for k, v in rows:
        mine = [y for x, y in rows if x == k]
        assert got[k, v] == sum(y < v for y in mine) + (mine.count(v) + 1) / 2


def test_isoform_weights(spark):
    exons = spark.createDataFrame([("s", "i1", 0, 100), ("s", "i1", 200, 400), ("s", "i2", 0, 100), ("s", "i2", 300, 500)], "ats string, isoform string, start long, end long")
    parts = spark.createDataFrame(
        [("s", "f1", 0, 0, 1, 10, 60), ("s", "f1", 128, 0, 1, 310, 390), ("s", "f2", 0, 0, 2, 50, 100), ("s", "f2", 0, 1, 2, 200, 240), ("s", "f3", 0, 0, 1, 120, 150)],
        "ats string, frag string, read int, part int, n_parts int, start long, end long",
    )
    lengths = {(r.frag, r.isoform): r.length for r in isoform.fragment_lengths(parts, exons).collect()}
    assert lengths == {("f1", "i1"): 280, ("f1", "i2"): 180, ("f2", "i1"): 90}
    w = {r.isoform: r.weight for r in isoform.weights(isoform.fragment_lengths(parts, exons)).collect()}
    assert w["i1"] > w["i2"] and sum(w.values()) == pytest.approx(1)


def test_exon_extension(spark):
    exons = spark.createDataFrame([("g", "near", 1000, 1100), ("g", "far", 3000, 3100), ("g", "past", 100, 200)], "gene_id string, isoform string, start long, end long")
    sites = spark.createDataFrame([("s", "g", 960)], "ats string, gene_id string, at long")
    assert {r.isoform: r.start for r in isoform.extended(exons, sites).collect()} == {"near": 1000}


def test_peaks(spark):
    pos = spark.createDataFrame([("1", 1000)], "chrom string, at long")
    neg = spark.createDataFrame([("1", 1400), ("1", 1501), ("2", 1000)], "chrom string, at long")
    assert sorted((r.chrom, r.at, r.label) for r in peaks.labelled(pos, neg).collect()) == [("1", 1000, 1), ("1", 1501, 0), ("2", 1000, 0)]
    sizes = spark.createDataFrame([("1", 100), ("2", 300)], "chrom string, size long")
    drawn = peaks.random_sites(spark, sizes, 200).collect()
    assert len(drawn) == 200 and all(0 <= r.at < {"1": 100, "2": 300}[r.chrom] for r in drawn) and {r.chrom for r in drawn} == {"1", "2"}


def test_cells(spark):
    import numpy as np

    from ridgeline.plans import cells

    rng = np.random.default_rng(1)
    dense = rng.poisson(2, (6, 30)) * np.repeat([[1, 4]], 15, axis=0).reshape(1, 30)
    rows = [(f"r{i}", f"c{j}", float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    df = spark.createDataFrame(rows, "row_id string, col_id string, value double")
    m = {r.row_id: (r.mean, r.variance) for r in cells.moments(df, 30).collect()}
    assert all(np.allclose(m[f"r{i}"], (dense[i].mean(), dense[i].var(ddof=1))) for i in range(6))
    norm = cells.log_normalised(df)
    assert cells.variable_rows(norm, 30, 3).count() == 3
    out = cells.principal_components(norm, [f"r{i}" for i in range(6)], 2).collect()
    assert len(out) == 30 and all(len(r.pca) == 2 for r in out)


@pytest.mark.parametrize("spearman", [False, True])
def test_grouped_coexpression_equals_each_group_alone(spark, spearman):
    rng = random.Random(2)
    sites = ["chr1:0-500:+_100", "chr1:0-500:-_150", "chr1:0-500:-_190", "chr1:0-500:+_180"]
    rows = [(s, f"c{c}", float(rng.randrange(1, 5))) for s in sites for c in range(30) if rng.random() < 0.6]
    counts = spark.createDataFrame(rows, "row_id string, col_id string, value double")
    groups = spark.createDataFrame([(f"c{c}", "ab"[c % 2]) for c in range(28)], "barcode string, group string")
    got = {(r.group, r.a, r.b): (r.r, r.p) for r in coexpression.coexpression(counts, 100, spearman, groups).collect()}
    for g in "ab":
        mine = counts.join(groups.filter(F.col("group") == g).select(F.col("barcode").alias("col_id")), "col_id", "left_semi")
        alone = {(g, r.a, r.b): (r.r, r.p) for r in coexpression.coexpression(mine, 100, spearman).collect()}
        assert {k: v for k, v in got.items() if k[0] == g} == {k: (pytest.approx(v[0]), pytest.approx(v[1])) for k, v in alone.items()} and alone


def test_adjusted_p(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 0.01, 0.5, round(rng.random(), 3)])) for k in "ab" for i in range(300)]
    got = {(r.k, r.i): r.p_adj for r in quant.adjusted(spark.createDataFrame(rows, "k string, i long, p double"), ["k"], "p").collect()}
    for k in "ab":
        known = sorted(((p, i) for kk, i, p in rows if kk == k and p is not None), reverse=True)
        least, want = 1.0, {}
        for at, (p, i) in enumerate(known):
            least = min(least, p * len(known) / (len(known) - at))
            want[i] = least
        for p, i in known:
            want[i] = min(want[j] for q, j in known if q == p)
        assert {i: v for (kk, i), v in got.items() if kk == k and v is not None} == {i: pytest.approx(v) for i, v in want.items()}
    assert all(got[k, i] is None for k, i, p in rows if p is None)


def test_recovery(spark):
    values = spark.createDataFrame([("g1", "c", 9.0), ("g2", "c", 5.0), ("g3", "c", 5.0), ("g4", "c", 1.0), ("g1", "d", 1.0)], "row_id string, col_id string, value double")
    sets = spark.createDataFrame([("s", "g1"), ("s", "g3"), ("s", "g3"), ("t", "g4"), ("t", "g9")], "set string, row_id string")
    got = {(r.set, r.col_id): r.auc for r in quant.recovery(values, sets, 8, 0.5).collect()}
    assert got == {("s", "c"): pytest.approx((3 + 1) / 8), ("s", "d"): pytest.approx(3 / 8)}  # four ranks; the last has no area left


def test_stabilised_against_plain(spark):
    """Every step in numpy over the dense matrix, local parabolas included."""
    import numpy as np

    from ridgeline.plans import cells

    rng = np.random.default_rng(4)
    n = 60
    x = rng.poisson(np.exp(rng.uniform(-2, 3, 150))[:, None] * rng.choice([0.5, 2], (150, n)))
    counts = spark.createDataFrame([(f"g{i}", f"c{j}", float(x[i, j])) for i in range(150) for j in range(n) if x[i, j]], "row_id string, col_id string, value double")
    got = {r.row_id: (r.expected, r.standardised) for r in cells.stabilised(counts, n, bins=20).collect()}
    mean, variance = x.mean(1), x.var(1, ddof=1)
    keep = np.flatnonzero((mean > 0) & (variance > 0))
    a, b = np.log10(mean[keep]), np.log10(variance[keep])
    which = np.minimum(19, np.floor((a - a.min()) / ((a.max() - a.min()) / 20)).astype(int))
    names = np.unique(which)
    bx, by, bn = (np.array([f(which == w) for w in names]) for f in (lambda m: a[m].mean(), lambda m: b[m].mean(), lambda m: m.sum()))
    near, fit = max(4, int(np.ceil(0.3 * len(bx)))), []
    for at in bx:
        d = np.abs(bx - at)
        w = bn * np.clip(1 - (d / np.sort(d)[near - 1]) ** 3, 0, None) ** 3
        some = w > 0
        fit.append(np.polyval(np.polyfit(bx[some] - at, by[some], min(2, some.sum() - 1), w=np.sqrt(w[some])), 0))
    fit = np.array(fit)
    for g, p in zip(keep, a, strict=True):
        i = int(np.clip(np.searchsorted(bx, p, "right") - 1, 0, len(bx) - 2))
        expected = 10 ** (fit[i] + (fit[i + 1] - fit[i]) / (bx[i + 1] - bx[i]) * (p - bx[i]))
        z = np.minimum((x[g] - mean[g]) / np.sqrt(expected), np.sqrt(n))
        assert got[f"g{g}"] == (pytest.approx(expected, rel=1e-6), pytest.approx((z**2).sum() / (n - 1), rel=1e-6))
