"""Neighbour graphs and communities against exact search and a plain, sequential version."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.plans import graph


def cloud(n, dim=16, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))
    return x.astype(np.float32)


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def exact(x, k):
    x = x.astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(2).round(6)
    np.fill_diagonal(d, np.inf)
    return np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]


def test_small_tables_are_exact(spark):
    x = cloud(300)
    got = {r.id: [s.id for s in r.near] for r in graph.neighbours(table(spark, x), 10).collect()}
    assert got == {i: row for i, row in enumerate(exact(x, 10).tolist())}


def test_forest_recall(spark, monkeypatch):
    """Leaves of 64 of 2,000 vectors: at least 0.9 of the exact neighbours; with one round better than without."""
    monkeypatch.setattr(graph, "LEAF", 64)
    x = cloud(2000)
    want = exact(x, 10)
    recall = []
    for rounds in (0, 1):
        got = {r.id: {s.id for s in r.near} for r in graph.neighbours(table(spark, x), 10, rounds=rounds).collect()}
        recall.append(np.mean([len(got[i] & set(row)) / 10 for i, row in enumerate(want.tolist())]))
    assert recall[1] >= 0.9 and recall[1] >= recall[0]


def test_neighbours_are_exact_at_any_size(spark, monkeypatch):
    """Far over what a leaf holds, and in several tasks; nothing depends on the table's size."""
    monkeypatch.setattr(graph, "LEAF", 64)
    x = cloud(2000)
    got = {r.id: [s.id for s in r.near] for r in graph.neighbours(table(spark, x), 10).collect()}
    assert got == {i: row for i, row in enumerate(exact(x, 10).tolist())}


def test_a_forest_is_the_callers_choice(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAF", 64)
    x = cloud(2000)
    want = exact(x, 10).tolist()
    recall = []
    for rounds in (0, 1):
        got = {r.id: {s.id for s in r.near} for r in graph.neighbours(table(spark, x), 10, trees=6, rounds=rounds).collect()}
        recall.append(np.mean([len(got[i] & set(row)) / 10 for i, row in enumerate(want)]))
    assert 1 > recall[1] >= 0.9 and recall[1] >= recall[0]


def test_found_neighbours_are_stored(spark, monkeypatch):
    """Edges read the neighbours three times; none of them searches again."""
    monkeypatch.setattr(graph, "LEAF", 64)
    near = graph.neighbours(table(spark, cloud(300)), 10)
    plan = graph.shared_neighbours(near)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "InArrow" not in plan


def test_only_pairs_among_the_nearest_leave_a_neighbourhood():
    """Two hubs, cut over batches: a member's pairs up to the distance of its k-th so far, that one included."""
    x = cloud(40)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2).round(6)
    hub, ids = np.repeat([3, 8], 20), np.arange(40)
    worst = np.array([np.sort(np.delete(d[i, hub == hub[i]], i % 20))[4] for i in range(40)])
    rows = pa.RecordBatch.from_pydict({"hub": hub, "id": ids, "x": pa.array(x.tolist(), pa.list_(pa.float32())), "worst": worst})
    got = [p for b in graph._around(iter([rows.slice(0, 13), rows.slice(13, 0), rows.slice(13)]), 15) for p in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert sorted(got) == [(i, j, d[i, j]) for i in range(40) for j in range(40) if i != j and hub[i] == hub[j] and d[i, j] <= worst[i]]


def test_copies_and_gaps(spark):
    x = np.concatenate([cloud(40), np.repeat(cloud(1, seed=5), 500, axis=0)])
    df = table(spark, x).unionByName(spark.createDataFrame([(None, [1.0] * 16), (9000, None)], "vec_id long, embedding array<float>"))
    rows = graph.neighbours(df, 5).collect()
    assert {r.id for r in rows} == set(range(41)) and all(len({s.id for s in r.near}) == 5 for r in rows)
    assert graph.neighbours(df.limit(0), 5).count() == 0 and graph.neighbours(df.filter("vec_id = 3"), 5).count() == 0


def test_shared_neighbours(spark):
    x = cloud(200)
    near = exact(x, 8)
    lists = [{i, *row} for i, row in enumerate(near.tolist())]
    want = {}
    for i, row in enumerate(near.tolist()):
        for j in row:
            n = len(lists[i] & lists[j])
            if n / (18 - n) > 1 / 15:
                want[min(i, j), max(i, j)] = (n, pytest.approx(n / (18 - n)))
    got = {(r.i, r.j): (r.shared, r.weight) for r in graph.shared_neighbours(graph.neighbours(table(spark, x), 8)).collect()}
    assert got == want


def sequential(edges, n, resolution=1.0):
    """One vertex after the other, level by level."""
    w = np.zeros((n, n))
    for i, j, x in edges:
        w[i, j] += x
        w[j, i] += x
    where, m2 = np.arange(n), w.sum()
    while True:
        c, k, moved = np.arange(len(w)), w.sum(1), True
        while moved:
            moved = False
            for u in range(len(w)):
                to = np.bincount(c, w[u] * (np.arange(len(w)) != u), minlength=len(w))
                tot = np.bincount(c, k, minlength=len(w))
                tot[c[u]] -= k[u]
                gain = to - resolution * k[u] * tot / m2
                best = int(np.argmax(gain.round(9)))
                if gain[best] > gain[c[u]] + 1e-9:
                    c[u], moved = best, True
        names, c = np.unique(c, return_inverse=True)
        where = c[where]
        if len(names) == len(w):
            return where
        one = np.eye(len(names))[c]
        w = one.T @ w @ one


def value(edges, c, resolution=1.0):
    m = sum(x for *_, x in edges)
    k = {}
    for i, j, x in edges:
        k[c[i]] = k.get(c[i], 0) + x
        k[c[j]] = k.get(c[j], 0) + x
    return sum(x for i, j, x in edges if c[i] == c[j]) / m - resolution * sum(t * t for t in k.values()) / (4 * m * m)


@pytest.fixture(scope="module")
def ring():
    """Twelve dense groups of 15 with few edges between."""
    rng = random.Random(3)
    edges = [(a + 15 * g, b + 15 * g, rng.choice([0.5, 1.0])) for g in range(12) for a in range(15) for b in range(a) if rng.random() < 0.6]
    edges += [(15 * g + rng.randrange(15), (15 * (g + 1) + rng.randrange(15)) % 180, 0.3) for g in range(12) for _ in range(3)]
    return [(min(i, j), max(i, j), x) for i, j, x in {(min(i, j), max(i, j)): (i, j, x) for i, j, x in edges}.values()]


def test_communities_are_as_good_as_plain(spark, ring):
    df = spark.createDataFrame(ring, "i long, j long, weight double")
    got = {r.id: r.community for r in graph.communities(df).collect()}
    assert value(ring, got) >= 0.98 * value(ring, dict(enumerate(sequential(ring, 180))))
    assert all(got[c] == c <= i for i, c in got.items())
    again = {r.id: r.community for r in graph.communities(df.repartition(7)).collect()}
    assert again == got


def test_modularity(spark, ring):
    df = spark.createDataFrame(ring, "i long, j long, weight double")
    part = spark.createDataFrame([(i, i // 15) for i in range(180)], "id long, community long")
    assert graph.modularity(df, part).first()[0] == pytest.approx(value(ring, [i // 15 for i in range(180)]))


def test_communities_of_nothing(spark):
    none = spark.createDataFrame([], "i long, j long, weight double")
    assert graph.communities(none).count() == 0
