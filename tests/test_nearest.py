"""Exact neighbours in blocks and tiles against all pairs."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ridgeline.plans import nearest
from ridgeline.plans.classify import nearest_votes


def table(spark, x):
    return spark.createDataFrame([(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, label int, embedding array<float>")


def test_neighbours_over_many_blocks(spark):
    """Over 2,048 vectors, near copies and ties among them: every neighbour, not most of them."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (2500, 6)).astype(float)  # on a grid: many equal distances
    x = np.unique(x, axis=0)
    x = np.concatenate([x, rng.standard_normal((2500 - len(x), 6)).round(3)])
    got = nearest.exact_neighbours(table(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), 7)
    assert got.rdd.getNumPartitions() > 1
    x = x.astype(np.float32).astype(float)
    want = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1).round(6)
        d[i] = np.inf
        want[i] = np.lexsort((np.arange(len(x)), d))[:7].tolist()
    assert {r.id: [s.id for s in r.near] for r in got.collect()} == want


def test_few_points(spark):
    rows = table(spark, np.eye(4)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    assert {r.id: len(r.near) for r in nearest.exact_neighbours(rows, 7).collect()} == dict.fromkeys(range(4), 3)
    assert nearest.exact_neighbours(rows.limit(0), 7).count() == 0


def test_memory_has_a_bound():
    """4,096 queries and batches of 10,000 rows, 6,000 of them alike: no matrix of all their distances (over 300 MB)."""
    rng = np.random.default_rng(5)
    y = rng.standard_normal((10_000, 8)).astype(np.float32)
    y[:6000] = y[0]
    search = nearest.Nearest(np.arange(-4096, 0), y[rng.integers(0, 10_000, 4096)], 5)
    tracemalloc.start()
    search.add(np.arange(10_000), y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
    copies = [row for ids, _, row, _ in search.found() for row in np.split(row, np.flatnonzero(np.diff(ids)) + 1) if row[0] == 0]
    assert copies and all(row.tolist() == [0, 1, 2, 3, 4] for row in copies)


def test_votes_of_copies(spark):
    """More equal rows than k: the least ids vote."""
    x = np.zeros((60, 4))
    x[40:] = 1
    rows = table(spark, x)
    got = nearest_votes(rows.filter("vec_id % 50 = 0").select("vec_id", "embedding"), rows.filter("vec_id % 50 <> 0").withColumn("label", F.when(F.col("vec_id") > 1, F.col("label"))), 5)
    assert sorted(map(tuple, got.collect())) == [(0, 2), (50, 1)]
