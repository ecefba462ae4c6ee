"""Markers between two groups of cells by a censored regression: values at or under a limit say only that they are not above it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.quant import adjusted

_SUMS = [f"{s}{g}" for g in (1, 0) for s in ("n", "s", "q")]
_FOUND = "mean1 double, mean0 double, sigma double, lr double, p double"


def censored_markers(values: DataFrame, groups: DataFrame, limit: float = 0.0, rounds: int = 100) -> DataFrame:
    """row_id, n1, n0 (values over the limit), mean1, mean0, sigma, lr, p, p_adj: a normal model with one mean for each group, censored
    at the limit from below, against one with one mean for both (likelihood ratio, one degree of freedom).

    values: row_id, col_id, value, once each, absent cells at or under the limit; groups: col_id, first (boolean), once each; cells of no
    group are left out. All that the likelihood needs of a row are counts, sums and squares of both groups' values over the limit,
    so the table is aggregated once, and Newton's steps for all rows of a batch run on those six numbers.

    Rows without a value over the limit are absent. The mean of a group that is censored whole has no lower bound and is null. Where the likelihood
    has no maximum (no spread and nothing censored beside it) or a group has no cell, all estimates are null; null and NaN values count as absent."""
    groups = groups.filter(F.col("first").isNotNull() & F.col("col_id").isNotNull()).select("col_id", F.col("first").cast("int").alias("_g"))
    size = {r["_g"]: r["n"] for r in groups.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    v = F.col("value").cast("double") - F.lit(float(limit))
    over = values.select("row_id", "col_id", v.alias("_v")).filter((F.col("_v") > 0) & ~F.isnan("_v")).join(groups, "col_id")
    mine = lambda g, x: F.coalesce(F.sum(F.when(F.col("_g") == g, x)), F.lit(0.0))
    sums = [c for g in (1, 0) for c in (F.count_if(F.col("_g") == g).alias(f"n{g}"), mine(g, F.col("_v")).alias(f"s{g}"), mine(g, F.col("_v") * F.col("_v")).alias(f"q{g}"))]
    rows = over.groupBy("row_id").agg(*sums)
    cells = (size.get(1, 0), size.get(0, 0))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, s, q = (b[[f"{x}1", f"{x}0"]].to_numpy(float) for x in "nsq")
            out = ratio_test(n, s, q, np.array(cells, float) - n, rounds)
            out["mean1"], out["mean0"] = out["mean1"] + limit, out["mean0"] + limit
            found = pd.DataFrame(out).astype(object)
            yield pd.concat([b[["row_id", "n1", "n0"]], found.where(found.notna(), None)], axis=1)

    kind = values.schema["row_id"].dataType.simpleString()
    found = rows.mapInPandas(tested, f"row_id {kind}, n1 long, n0 long, {_FOUND}").withColumn("_one", F.lit(1))
    return adjusted(found, ["_one"], "p").drop("_one")


def ratio_test(n: np.ndarray, s: np.ndarray, q: np.ndarray, c: np.ndarray, rounds: int = 100) -> dict[str, np.ndarray]:
    """The estimates for rows with n values over 0 in each of two groups (columns), their sums s and squares q, and c censored ones."""
    spread = q - np.divide(s * s, n, out=np.zeros_like(s), where=n > 0) > 1e-12 * q
    both = [x.sum(1, keepdims=True) for x in (n, s, q, c)]
    level = np.sqrt(np.divide(both[2], both[0], out=np.ones_like(both[2]), where=both[0] > 0))  # in units of this all values are near 1
    fine = ((n > 0) & (spread | (c > 0))).any(1) & (n + c > 0).all(1)
    gamma, h, full, ends1 = _fitted(n, s / level, q / level**2, c, fine, rounds)
    _, _, one, ends0 = _fitted(both[0], both[1] / level, both[2] / level**2, both[3], fine, rounds)
    fine = fine & ends1 & ends0
    with np.errstate(all="ignore"):
        sigma = np.where(fine, level[:, 0] / h, np.nan)
        mean = np.where(fine[:, None] & (n > 0), gamma / h[:, None] * level, np.nan)
        lr = np.where(fine, np.maximum(0.0, 2 * (full - one)), np.nan)
    p = np.array([math.erfc(math.sqrt(x / 2)) if x == x else np.nan for x in lr])
    return {"mean1": mean[:, 0], "mean0": mean[:, 1], "sigma": sigma, "lr": lr, "p": p}


def log_normal_tail(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the normal distribution function at t, density over distribution function), also far out on the left."""
    far = t < -8
    near = np.where(far, 0.0, t)
    below = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in near.ravel()]).reshape(t.shape)
    z = np.where(far, t, -8.0) ** -2
    series = 1 - z * (1 - 3 * z * (1 - 5 * z * (1 - 7 * z * (1 - 9 * z))))
    density = -0.5 * t * t - 0.5 * math.log(2 * math.pi)
    log = np.where(far, density - np.log(np.where(far, -t, 1.0)) + np.log(series), np.log(below))
    return log, np.exp(density - log)


def _fitted(n, s, q, c, fine, rounds):
    """(gamma by group, h, log likelihood, whether it converged): gamma = mean / sigma and h = 1 / sigma make the likelihood concave."""
    rows, k = n.shape
    total, square = n.sum(1), q.sum(1)

    def likelihood(gamma, h):
        tail, mills = log_normal_tail(-gamma)
        return total * np.log(h) - 0.5 * (h * h * square - 2 * h * (gamma * s).sum(1) + (n * gamma * gamma).sum(1)) + (c * tail).sum(1), mills

    gamma, h = np.zeros((rows, k)), np.ones(rows)
    now, mills = likelihood(gamma, h)
    ends, going = np.zeros(rows, bool), fine.copy()
    for _ in range(rounds):
        if not going.any():
            break
        slope = np.concatenate([h[:, None] * s - n * gamma - c * mills, (total / h - h * square + (gamma * s).sum(1))[:, None]], 1)
        curve = np.zeros((rows, k + 1, k + 1))
        curve[:, range(k), range(k)] = n + c * mills * (mills - gamma)
        curve[:, :k, k] = curve[:, k, :k] = -s
        curve[:, k, k] = total / (h * h) + square
        curve[~going] = np.eye(k + 1)
        curve[:, range(k), range(k)] += 1e-300 + 1e-15 * (curve[:, range(k), range(k)] == 0)
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        gain = (step * slope).sum(1)
        size = np.where(going, 1.0, 0.0)
        size = np.where(h + step[:, k] <= 0, np.minimum(size, -0.5 * h / np.minimum(step[:, k], -1e-300)), size)
        for _ in range(40):
            g2, h2 = gamma + size[:, None] * step[:, :k], h + size * step[:, k]
            then, m2 = likelihood(g2, h2)
            worse = going & ~(then >= now - 1e-12 * np.abs(now))
            if not worse.any():
                break
            size = np.where(worse, size / 2, size)
        keep = going & ~worse
        gamma, h = np.where(keep[:, None], g2, gamma), np.where(keep, h2, h)
        now, mills = np.where(keep, then, now), np.where(keep[:, None], m2, mills)
        ends |= keep & (gain < 1e-12)
        going &= keep & ~ends
    return gamma, h, now, ends
