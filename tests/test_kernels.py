import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import numeric, tails
from ridgeline.functions.cigar import exon_parts
from ridgeline.plans.mixture import Window, density, peaks


def recovered(truth, seed, n=400, noise=20):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(t, 10, n) for t in truth] + [rng.uniform(0, 500, noise)])
    return Window(np.rint(x), 500, seed=seed).fit(3)


@pytest.mark.parametrize("truth", [[120], [100, 300], [80, 220, 400]])
def test_mixture_finds_sites(truth):
    got = recovered(truth, 3)
    assert len(got.alpha) == len(truth)
    assert np.abs(got.alpha - np.array(truth)).max() < 8
    assert abs(got.weight.sum() - 1) < 1e-6 and got.weight[-1] <= 0.1 + 1e-9


def test_mixture_is_repeatable_and_small_windows_are_skipped():
    assert recovered([100, 300], 4).bic == recovered([100, 300], 4).bic
    assert Window([5], 500).fit() is None
    assert Window([], 500).fit() is None
    assert Window([7, 7, 7], 500).fit(1) is not None  # one value, no spread


def test_density_integrates_to_one():
    x, n = np.array([10.0, 20.0, 40.0]), np.array([3, 1, 2])
    grid = np.arange(-200, 300, 0.5)
    assert abs(density(x, n, grid).sum() * 0.5 - 1) < 1e-3


def test_peaks_take_plateaus_once():
    assert peaks(np.array([0, 1, 1, 1, 0, 2, 0, 0, 3])).tolist() == [2, 5]
    assert peaks(np.zeros(4)).tolist() == []


def test_sites_by_window(spark):
    from ridgeline.plans.ats import fitted_sites

    rng = np.random.default_rng(1)
    rows = [("w", int(x)) for x in rng.normal(200, 10, 300)] + [("few", 3)] * 3
    got = fitted_sites(spark.createDataFrame(rows, "window string, offset long"), length=500, max_sites=2).collect()
    assert [r.window for r in got] == ["w"] and abs(int(got[0].alpha.split(",")[0]) - 200) < 6 and got[0].number_of_reads == 300


def test_t_tail_values():
    known = [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (12.0, 5, 7.09e-05), (0.0, 7, 1.0)]
    for t, df, p in known:
        assert tails.t_two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, rel=2e-3)


def test_t_tail_against_jvm(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for t, df in [(0.1, 2), (1.3, 4), (3.3, 30), (0.02, 500)]:
        want = 2 * (1 - jvm.TDistribution(float(df)).cumulativeProbability(t))
        assert tails.t_two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(want, rel=1e-8)


def test_correlation_p_nulls(spark):
    df = spark.createDataFrame([(None, 5), (1.0, 5), (0.5, 2), (0.5, 12)], "r double, n long")
    got = [r.p for r in df.select(tails.correlation_p("r", "n").alias("p")).collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] is None and got[3] == pytest.approx(0.0979, abs=1e-3)


@pytest.mark.parametrize(
    "cigar,want",
    [("10M", [(100, 110)]), ("5M10N5M", [(100, 105), (115, 120)]), ("3S5M2I5M4H", [(100, 110)]), ("5M2D5M", [(100, 112)]), ("*", []), (None, []), ("5N5M", [(105, 110)])],
)
def test_cigar(spark, cigar, want):
    df = spark.createDataFrame([(100, cigar)], "s long, c string")
    assert [tuple(p) for p in df.select(exon_parts(F.col("s"), F.col("c")).alias("p")).first().p] == want


def test_cigar_without_deletions(spark):
    df = spark.createDataFrame([(100, "5M2D5M")], "s long, c string")
    assert [tuple(p) for p in df.select(exon_parts(F.col("s"), F.col("c"), False).alias("p")).first().p] == [(100, 110)]


def test_numeric_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    r = df.select(numeric.softmax(F.col("a")).alias("s"), numeric.entropy(F.array(F.lit(1), F.lit(1))).alias("e"), numeric.snap(F.lit(7.5), 5, 5, 50).alias("g")).first()
    assert sum(r.s) == pytest.approx(1) and r.e == pytest.approx(math.log(2)) and r.g == 5
