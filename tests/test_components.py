"""Sparse principal components against dense ones, censored markers against other algorithms on the raw values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.plans import cells, markers


def sparse(spark, dense, slices=3):
    rows = [(f"r{i}", f"c{j:03d}", float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "row_id string, col_id string, value double").repartition(slices)


def plain_components(dense, k, unit):
    z = dense - dense.mean(1, keepdims=True)
    if unit:
        sd = z.std(1, ddof=1, keepdims=True)
        z = np.divide(z, sd, out=np.zeros_like(z), where=sd > 1e-12)
    value, vector = np.linalg.eigh(z @ z.T / (dense.shape[1] - 1))
    vector = vector[:, ::-1][:, :k]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), range(k)])
    return (z.T @ vector), value[::-1][:k], vector


@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("m, n, k", [(6, 40, 6), (60, 90, 4), (25, 12, 3)])
def test_components_equal_dense(spark, monkeypatch, m, n, k, unit):
    monkeypatch.setattr(cells, "AT_ONCE", 300)  # many stretches
    rng = np.random.default_rng(m)
    dense = rng.poisson(0.5, (m, n)) * rng.integers(1, 5, (1, n)) * np.where(np.arange(m) % 3 == 0, 3.0, 1.0)[:, None]
    dense[:, 2] = 0  # a cell without any row
    dense[1] = 0  # a row without any cell
    ids = spark.createDataFrame([(f"c{j:03d}",) for j in range(n)], "col_id string")
    scores, found, loading = cells.components(sparse(spark, dense), [f"r{i}" for i in range(m)], k, unit, ids)
    k = len(found)
    want, variance, vector = plain_components(dense.astype(float), k, unit)
    got = np.array([r.pca for r in scores.orderBy("col_id").collect()])
    assert got.shape == (n, k) and np.allclose(found, variance, rtol=1e-8) and np.allclose(loading, vector, atol=1e-6) and np.allclose(got, want, atol=1e-5)


def test_component_edges(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("b", "y", float("nan")), ("a", "z", 3.0), ("other", "w", 5.0)], "row_id string, col_id string, value double")
    got = {r.col_id: r.pca for r in cells.components(df, ["a", "b", "none"], 2)[0].collect()}
    sd = np.std([1, 0, 3, 0], ddof=1)
    assert {c: round(p[0], 9) for c, p in got.items()} == {c: round((v - 1) / sd, 9) for c, v in (("x", 1), ("y", 0), ("z", 3), ("w", 0))}
    assert all(len(p) == 1 for p in got.values())  # only one row varies
    assert [r.pca for r in cells.components(df, [], 2)[0].collect()] == [[]] * 4
    assert cells.components(df.limit(0), ["a"], 2)[0].count() == 0


def plain_censored(y, group, rounds=20_000):
    """Expectation-maximisation on single values: censored ones stand at their expected value under the limit 0."""
    mean, sd = {g: 0.0 for g in set(group)}, 1.0
    phi = lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    cdf = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
    for _ in range(rounds):
        e, e2 = [], []
        for v, g in zip(y, group, strict=True):
            if v > 0:
                e.append(v), e2.append(v * v)
            else:
                a = -mean[g] / sd
                ratio = phi(a) / cdf(a)
                e.append(mean[g] - sd * ratio), e2.append(mean[g] ** 2 + sd**2 - sd * ratio * mean[g])
        new = {k: float(np.mean([x for x, g in zip(e, group, strict=True) if g == k])) for k in mean}
        spread = math.sqrt(np.mean([x2 - 2 * new[g] * x + new[g] ** 2 for x, x2, g in zip(e, e2, group, strict=True)]))
        done = abs(spread - sd) + sum(abs(new[k] - mean[k]) for k in mean) < 1e-13
        mean, sd = new, spread
        if done:
            break
    at = [math.log(phi((v - mean[g]) / sd) / sd) if v > 0 else math.log(cdf(-mean[g] / sd)) for v, g in zip(y, group, strict=True)]
    return mean, sd, sum(at)


def test_censored_markers_equal_single_values(spark):
    rng = np.random.default_rng(4)
    group = np.arange(60) % 3 == 0
    dense = np.array([np.maximum(0, rng.normal(m + d * group, s)) for m, d, s in ((1, 0, 1), (0.2, 1, 2), (-1, 1.5, 1.0), (30, -3, 9), (-0.5, 0, 0.01 + 1))])
    values = sparse(spark, dense + np.where(dense > 0, 2, 0)).unionByName(spark.createDataFrame([("r0", "alien", 9.0)], "row_id string, col_id string, value double"))
    groups = spark.createDataFrame([(f"c{j:03d}", bool(g)) for j, g in enumerate(group)] + [("alien", None), (None, True)], "col_id string, first boolean")
    got = {r.row_id: r for r in markers.censored_markers(values, groups, limit=2.0).collect()}
    assert len(got) == 5
    for i, y in enumerate(dense):
        mean, sd, full = plain_censored(y, group.tolist())
        _, _, one = plain_censored(y, [0] * 60)
        r = got[f"r{i}"]
        assert r.n1 == (y[group] > 0).sum() and r.n0 == (y[~group] > 0).sum()
        assert np.allclose([r.mean1, r.mean0, r.sigma], [mean[True] + 2, mean[False] + 2, sd], atol=1e-6)
        assert abs(r.lr - 2 * (full - one)) < 1e-6 and abs(r.p - math.erfc(math.sqrt(max(0, full - one)))) < 1e-6
    order = sorted(got.values(), key=lambda r: r.p)
    want = [min(1.0, *(o.p * 5 / (j + 1) for j, o in enumerate(order) if j >= i)) if i < 4 else min(1.0, order[4].p) for i in range(5)]
    assert np.allclose([r.p_adj for r in order], want)


def test_uncensored_is_least_squares_and_edges():
    y1, y0 = np.array([3.0, 4, 6, 5]), np.array([1.0, 2, 2.5])
    n, s, q = np.array([[4.0, 3]]), np.array([[y1.sum(), y0.sum()]]), np.array([[(y1**2).sum(), (y0**2).sum()]])
    r = markers.ratio_test(n, s, q, np.zeros((1, 2)))
    rss, both = ((y1 - y1.mean()) ** 2).sum() + ((y0 - y0.mean()) ** 2).sum(), np.concatenate([y1, y0])
    assert np.allclose([r["mean1"][0], r["mean0"][0], r["sigma"][0], r["lr"][0]], [y1.mean(), y0.mean(), math.sqrt(rss / 7), 7 * math.log(((both - both.mean()) ** 2).sum() / rss)], rtol=1e-9)
    # no spread; an empty group; a group censored whole; one value beside censored ones; large values
    n, s, q = np.array([[2.0, 2], [2, 0], [3, 0], [1, 1], [2, 2]]), np.array([[2.0, 4], [3, 0], [6, 0], [1, 2], [3e8, 5e8]]), np.array([[2.0, 8], [5, 0], [14, 0], [1, 4], [5e16, 13e16]])
    r = markers.ratio_test(n, s, q, np.array([[0.0, 0], [3, 0], [0, 9], [2, 2], [1, 0]]))
    assert [bool(np.isfinite(x)) for x in r["lr"]] == [False, False, True, True, True]
    assert np.isnan(r["mean0"][2]) and abs(r["mean1"][2] - 2) < 1e-6 and abs(r["sigma"][2] - math.sqrt(2 / 3)) < 1e-6 and r["p"][2] < 1e-3


def test_tail_far_out():
    t = np.array([-300.0, -30, -8.001, -7.999, -1, 0, 5, 40])
    log, mills = markers.log_normal_tail(t)
    assert np.allclose(log[4:7], [math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in (-1, 0, 5)]) and abs(log[2] - log[3] + 0.002 * 8.12) < 1e-3
    assert np.allclose(mills[:2], [300 + 1 / 300, 30 + 1 / 30], atol=1e-4) and log[7] == 0 and abs(log[1] - math.log(0.5 * math.erfc(30 / math.sqrt(2)))) < 1e-9


def test_empty(spark):
    none = spark.createDataFrame([], "row_id string, col_id string, value double")
    groups = spark.createDataFrame([("c", True)], "col_id string, first boolean")
    assert markers.censored_markers(none, groups).count() == 0
    one = spark.createDataFrame([("r", "c", 1.0)], "row_id string, col_id string, value double")
    assert markers.censored_markers(one, groups).select("lr", "p_adj").first() == (None, None)
    assert markers.censored_markers(one.withColumn("value", F.lit(0.0)), groups).count() == 0
