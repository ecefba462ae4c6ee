"""Cell graphs: nearest neighbours, shared-neighbour weights, and communities by modularity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.nearest import exact_neighbours, matrix
from ridgeline.sources.shared import removed, stored

#: Rows that are compared with each other in one leaf of a tree.
LEAF = 2048
#: Rows on which the trees' upper splits are fitted, at most; and rows that one task of a tree holds, at most.
SAMPLE, TASK_ROWS = 50_000, 1 << 17
#: Numbers that are subtracted at a time where distances are measured.
MEASURED = 1 << 18
#: Weights as whole numbers, so that sums don't depend on their order.
UNIT = 1_000_000


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, squared distance) of the k nearest within x, by (distance to six digits, id)."""
    k = min(k, len(x) - 1)
    if k < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    square = (x * x).sum(1)
    rough = square[:, None] + square[None] - 2 * x @ x.T
    np.fill_diagonal(rough, np.inf)
    some = min(len(x) - 1, k + 8)
    near = np.argpartition(rough, some - 1, axis=1)[:, :some]
    step = max(1, MEASURED // some // x.shape[1])
    exact = np.concatenate([((x[i : i + step, None] - x[near[i : i + step]]) ** 2).sum(2) for i in range(0, len(x), step)]).round(6)
    order = np.lexsort((ids[near], exact), axis=1)[:, :k]
    return np.repeat(ids, k), ids[np.take_along_axis(near, order, 1)].ravel(), np.take_along_axis(exact, order, 1).ravel()


def _leaves(rows: np.ndarray, x: np.ndarray, leaf: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Halves by the median along random directions, until they have at most ``leaf`` rows."""
    if len(rows) <= leaf:
        yield rows
        return
    along = x[rows] @ rng.standard_normal(x.shape[1])
    order = np.argsort(along, kind="stable")
    for half in (order[: len(order) // 2], order[len(order) // 2 :]):
        yield from _leaves(rows[half], x, leaf, rng)


def _splits(sample: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(direction, threshold of each node) of the levels of one tree."""
    node, out = np.zeros(len(sample), np.int64), []
    for level in range(depth):
        direction = rng.standard_normal(sample.shape[1])
        along = sample @ direction
        cuts = np.array([np.median(along[node == n]) if (node == n).any() else 0.0 for n in range(1 << level)])
        out.append((direction, cuts))
        node = 2 * node + (along > cuts[node])
    return out


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: each vector once, under its least id; rows without an id or vector are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    known = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).dropna()
    return known.groupBy("x").agg(F.min("id").alias("id")).select("id", "x")


def neighbours(rows: DataFrame, k: int = 20, trees: int = 0, rounds: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """id, near (array of struct d, id: the k nearest other vectors, nearest first, d squared), stored. Of equal vectors the least id takes part.

    Exact, all pairs compared, at any size (see ``exact_neighbours``). Only a caller that asks for ``trees`` gets most of the nearest instead, for less work:
    a forest of so many random-projection trees (upper splits fitted on a sample of at most SAMPLE rows, lower ones in the tasks), exact search in each
    leaf, and ``rounds`` in which the neighbours of each vector are compared among themselves. No pair is compared outside a leaf or a neighbourhood, and of
    a neighbourhood only pairs that may be among the k nearest leave the task."""
    kind = rows.schema[vector_col].dataType.elementType.typeName()  # single precision moves half the bytes
    x = F.col("x").cast("array<float>") if kind == "float" else F.col("x")
    points = distinct_vectors(rows, id_col, vector_col).select("id", x.alias("x"))
    found = _forest(stored(points, "points"), k, trees, rounds, seed) if trees else exact_neighbours(points, k)
    return stored(found, "neighbours")  # whoever makes edges of it reads it three times


def _forest(points: DataFrame, k: int, trees: int, rounds: int, seed: int) -> DataFrame:
    """What ``neighbours`` returns, by a forest."""
    n = points.count()
    depth = 0 if n <= LEAF else int(np.ceil(np.log2(n / LEAF)))
    upper = min(depth, int(np.log2(SAMPLE / 32)))
    one_in = max(1, n // max(1, SAMPLE // 2))
    sample = points.filter(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).limit(SAMPLE).select("x").collect() if depth else []
    known = np.array([r["x"] for r in sample], float)
    rng = np.random.default_rng(seed)
    forest = [_splits(known, upper, rng) for _ in range(trees)] if depth else [[]]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"]).astype(float)
            for tree, levels in enumerate(forest):
                node = np.zeros(len(x), np.int64)
                for direction, cuts in levels:
                    node = 2 * node + (x @ direction > cuts[node])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(node), *batch.columns], names=["tree", "node", "id", "x"])

    leaf = LEAF

    def searched(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        ids, x = table["id"].to_numpy()[order], matrix(table["x"].combine_chunks()).astype(float)[order]
        parts = [_nearest(ids[p], x[p], k) for rows in [np.arange(len(ids))] for p in _leaves(rows, x, leaf, np.random.default_rng([seed, key[0].as_py(), key[1].as_py()]))]
        return pa.table(dict(zip(("id", "to", "d"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))

    pieces = max(1, -(-n // (1 << upper) // TASK_ROWS))  # of a node that is larger than a task's share; the rounds mend what this parts
    dealt = points.select("id", "x").mapInArrow(placed, f"tree int, node long, id long, x {points.schema['x'].dataType.simpleString()}").withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    found = _best(dealt.groupBy("tree", "node", "piece").applyInArrow(searched, "id long, to long, d double"), k)
    for _ in range(rounds if depth else 0):
        before = stored(found, "neighbours")
        members = before.select(F.col("id").alias("hub"), F.explode(F.concat(F.array("id"), F.transform("near", lambda s: s["id"]))).alias("id"))
        pairs = before.select("id", F.explode("near").alias("s")).select("id", F.col("s.id").alias("to"), F.col("s.d").alias("d"))
        worst = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
        known = points.join(before.select("id", worst.alias("worst")), "id")
        around = members.join(known, "id").repartition("hub").sortWithinPartitions("hub", "id").select("hub", "id", "x", "worst").mapInArrow(lambda b: _around(b, k), "id long, to long, d double")
        found = _best(pairs.unionByName(around), k)
    return found


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id's distinct candidates: a few hundred at most, as many as there are trees and hubs that offer some."""
    pairs = pairs.repartition("id").groupBy("id", "to").agg(F.min("d").alias("d"))  # both groupings lie in one shuffle
    near = F.slice(F.array_sort(F.collect_list(F.struct(F.col("d"), F.col("to").alias("id")))), 1, k)
    return pairs.groupBy("id").agg(near.alias("near"))


def _around(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Neighbourhoods (rows of one hub follow one another): the nearest of each member among the others, up to the distance ``worst`` of its k-th so far."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None)

    def done(hub, ids, worst, x):
        cuts = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1], [True]])) if len(hub) else np.zeros(1, int)
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            of, to, d = _nearest(ids[a:b], x[a:b], k)
            near = d <= worst[a:b][np.searchsorted(ids[a:b], of)]
            parts.append((of[near], to[near], d[near]))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["id", "to", "d"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = (batch["hub"].to_numpy(), batch["id"].to_numpy(), batch["worst"].to_numpy(), matrix(batch["x"]).astype(float))
        hub, ids, worst, x = new if held[3] is None else (np.concatenate(c) for c in zip(held, new, strict=True))
        last = int(np.searchsorted(hub, hub[-1]))  # the last hub may go on
        yield from done(hub[:last], ids[:last], worst[:last], x[:last])
        held = (hub[last:], ids[last:], worst[last:], x[last:])
    if held[3] is not None:
        yield from done(*held)


def shared_neighbours(near: DataFrame, prune: float = 1 / 15) -> DataFrame:
    """i < j, shared, weight: for pairs of which one is among the other's neighbours, the Jaccard index of both neighbourhoods
    (each with its own vector), where it is over ``prune``. Linear in the edges: pairs that only share a neighbour aren't made."""
    lists = near.select("id", F.concat(F.array("id"), F.transform("near", lambda s: s["id"])).alias("all"))
    pairs = near.select("id", F.explode(F.transform("near", lambda s: s["id"])).alias("to"))
    pairs = pairs.select(F.least("id", "to").alias("i"), F.greatest("id", "to").alias("j")).distinct()
    both = pairs.join(lists.select(F.col("id").alias("i"), F.col("all").alias("a")), "i").join(lists.select(F.col("id").alias("j"), F.col("all").alias("b")), "j")
    shared = F.size(F.array_intersect("a", "b"))
    rows = both.select("i", "j", shared.cast("long").alias("shared"), (shared / (F.size("a") + F.size("b") - shared)).alias("weight"))
    return rows.filter(F.col("weight") > prune)


def modularity(edges: DataFrame, community: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (id, community) of a graph (i, j, weight; each pair once). Both ends must be in it."""
    at = lambda c: community.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}"))
    rows = edges.join(at("i"), "i").join(at("j"), "j")
    ends = rows.select(F.col("c_i").alias("c"), F.col("weight").alias("w")).unionByName(rows.select(F.col("c_j").alias("c"), F.col("weight").alias("w")))
    inside = rows.agg(F.sum("weight").alias("m"), F.coalesce(F.sum(F.when(F.col("c_i") == F.col("c_j"), F.col("weight"))), F.lit(0.0)).alias("inside"))
    squares = ends.groupBy("c").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("squares"))
    return inside.join(squares).select((F.col("inside") / F.col("m") - resolution * F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 6) -> DataFrame:
    """id, community (its least id): parallel modularity moves, and communities as the vertices of the next, smaller graph.

    edges: i, j, weight, each pair once. In a round half of the vertices (by hash) may go to the neighbouring community of
    largest gain, ties to the least; of all rounds of a level the partition of largest modularity is kept. Weights
    are rounded to whole millionths, so sums, and with them the result, don't depend on their order."""
    whole = edges.filter("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.round(F.col("weight") * UNIT).cast("long").alias("w"))
    graph = stored(whole.unionByName(whole.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")), "graph")
    total = graph.agg(F.sum("w")).first()[0]
    if not total:
        return graph.select(F.col("u").alias("id"), F.col("u").alias("community"))
    member = None
    for level in range(levels):
        state, moved = _moves(graph, total, resolution, rounds, level)
        now = state.select(F.col("u").alias("id"), F.col("c").alias("community"))
        member = now if member is None else stored(member.join(now.withColumnRenamed("id", "c").withColumnRenamed("community", "up"), member["community"] == F.col("c")).select("id", F.col("up").alias("community")), "members")
        if not moved:
            break
        at = lambda c, s=state: s.select(F.col("u").alias(c), F.col("c").alias(f"c_{c}"))
        smaller = stored(graph.join(at("u"), "u").join(at("v"), "v").groupBy(F.col("c_u").alias("u"), F.col("c_v").alias("v")).agg(F.sum("w").alias("w")), "graph")
        removed(graph)
        graph = smaller
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))


def _moves(graph: DataFrame, total: int, resolution: float, rounds: int, level: int) -> tuple[DataFrame, bool]:
    """(u, c of the best partition found, whether anything moved)."""
    state = stored(graph.groupBy("u").agg(F.sum("w").alias("k"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))), F.lit(0)).alias("loop")).withColumn("c", F.col("u")), "state")
    best, most, idle = state, None, 0
    for turn in range(rounds + 1):
        towards = graph.filter("u <> v").join(state.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
        mine = state.select("u", "k", "loop", F.col("c").alias("c0"))
        options = towards.unionByName(state.select("u", "c", F.lit(0).cast("long").alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        tot = state.groupBy("c").agg(F.sum("k").alias("t"))
        gain = F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0)) / total
        rows = options.join(mine, "u").join(tot, "c").withColumn("gain", F.round(gain, 3))
        own = F.col("c") == F.col("c0")
        chosen = rows.groupBy("u", "k", "loop", "c0").agg(
            F.max(F.struct(F.col("gain"), (-F.col("c")).alias("c"))).alias("top"), F.max(F.when(own, F.col("gain"))).alias("stay"), F.max(F.when(own, F.col("w"))).alias("inside"), F.max(F.when(own, F.col("t"))).alias("t")
        )
        goes = (F.col("top.gain") > F.col("stay")) & (F.pmod(F.xxhash64("u", F.lit(turn + 31 * level)), F.lit(2)) == 0)
        chosen = stored(chosen.select("u", "k", "loop", "c0", "inside", F.when(goes, -F.col("top.c")).otherwise(F.col("c0")).alias("c"), (F.col("top.gain") > F.col("stay")).alias("wants")), "moves")
        # the partition before these moves: its modularity, from what has been looked up anyway
        found = chosen.groupBy("c0").agg(F.sum("k").alias("t"), F.sum(F.col("inside") + F.col("loop")).alias("i"), F.sum(F.col("wants").cast("int")).alias("n"))
        row = found.agg(F.sum(F.col("i").cast("double")).alias("i"), F.sum(F.col("t").cast("double") * F.col("t")).alias("s"), F.sum("n").alias("n")).first()
        value = row["i"] / total - resolution * row["s"] / total / total
        idle = 0 if most is None or value > most + 1e-4 else idle + 1
        if most is None or value > most:
            best, most, first = state, value, (turn == 0)
        if not row["n"] or idle >= 3:
            break
        state = chosen.select("u", "k", "loop", "c")
    return best, not first
