"""The numeric kernel: a mixture of Gaussian sites and one uniform part on a window, chosen by BIC.

Written for one window's offsets in memory; windows are bounded by their length, and equal
offsets are counted once, so a window's cost doesn't grow with its depth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    alpha: np.ndarray
    beta: np.ndarray
    weight: np.ndarray  # of the sites, then of the uniform part
    bic: float


def density(points: np.ndarray, counts: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Gaussian kernel density with Scott's factor; zeros where it isn't defined."""
    n = counts.sum()
    mean = (points * counts).sum() / n
    variance = (counts * (points - mean) ** 2).sum() / max(1, n - 1)
    if n < 2 or variance <= 0:
        return np.zeros(len(grid))
    h = np.sqrt(variance) * n ** (-0.2)
    z = (grid[:, None] - points[None, :]) / h
    return (np.exp(-0.5 * z * z) * counts).sum(1) / (n * h * np.sqrt(2 * np.pi))


def peaks(y: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts once, at its middle."""
    edge = np.flatnonzero(np.diff(y))
    if not len(edge):
        return np.zeros(0, int)
    starts, ends = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(y) - 1]])
    value = y[starts]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    return (starts[top] + ends[top]) // 2


class Window:
    """Offsets of one window, 0 <= x < length, with their counts."""

    def __init__(self, offsets, length: int, max_beta: int = 50, max_uniform: float = 0.1, seed: int = 0, counts=None):
        """counts: how often each offset comes (once, if not given)."""
        x = np.asarray(offsets, float)
        times = np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)
        inside = (x >= 0) & (x < length)
        self.x, at = np.unique(x[inside], return_inverse=True)
        self.n = np.bincount(at, times[inside], minlength=len(self.x)).astype(np.int64)
        self.total, self.length, self.max_uniform = int(self.n.sum()), length, max_uniform
        self.grid = np.arange(5, max(6, max_beta), 5, dtype=float)
        self.rng = np.random.default_rng(seed)
        self.at = np.arange(-100, length + 100, dtype=float)
        self.kde = density(self.x, self.n, self.at) if self.total else np.zeros(len(self.at))

    def start(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sites drawn from the density's peaks first, then from the data; random widths and weights."""
        top = self.at[peaks(self.kde)]
        height = self.kde[peaks(self.kde)]
        take = min(k, len(top))
        alpha = list(self.rng.choice(top, take, replace=False, p=height / height.sum())) if take else []
        alpha += list(self.rng.choice(self.x, k - take, p=self.n / self.total))
        weight = self.rng.random(k + 1)
        weight[-1] = min(weight[-1], self.max_uniform)
        return np.sort(np.array(alpha, float)), self.rng.choice(self.grid, k), weight / weight.sum()

    def log_parts(self, alpha, beta, weight) -> np.ndarray:
        """Log of weight times density, one row for each part."""
        with np.errstate(divide="ignore"):
            w = np.log(weight)
        sites = w[:-1, None] - 0.5 * ((self.x - alpha[:, None]) / beta[:, None]) ** 2 - np.log(beta[:, None] * np.sqrt(2 * np.pi))
        return np.vstack([sites, np.full(len(self.x), w[-1] - np.log(self.length))])

    def em(self, alpha, beta, weight, fixed: bool = False, rounds: int = 200) -> Fit:
        last = -np.inf
        for turn in range(rounds):
            parts = self.log_parts(alpha, beta, weight)
            top = parts.max(0)
            each = top + np.log(np.exp(parts - top).sum(0))
            likelihood = float((each * self.n).sum())
            if abs(likelihood - last) < 1e-6 * abs(likelihood):
                break
            last = likelihood
            z = np.exp(parts - each) * self.n
            weight = z.sum(1) / self.total
            if weight[-1] > self.max_uniform and len(weight) > 1:
                weight[:-1] *= (1 - self.max_uniform) / max(1e-300, weight[:-1].sum())
                weight[-1] = self.max_uniform
            if not fixed:
                k = turn % len(alpha)  # one site moves in each round
                mass = z[k].sum()
                if mass > 1e-9:
                    alpha, beta = alpha.copy(), beta.copy()
                    alpha[k] = (z[k] * self.x).sum() / mass
                    spread = np.sqrt((z[k] * (self.x - alpha[k]) ** 2).sum() / mass)
                    beta[k] = self.grid[np.abs(self.grid - spread).argmin()]
        k = len(alpha)
        order = np.argsort(alpha, kind="stable")
        return Fit(alpha[order], beta[order], np.append(weight[:-1][order], weight[-1]), -2 * likelihood + (3 * k + 1) * np.log(max(2, self.total)))

    def fit(self, most: int = 5, least: int = 1, min_weight: float = 0.01, restarts: int = 5) -> Fit | None:
        """The fit of least BIC over the numbers of sites, weak sites taken out and the weights refitted."""
        if self.total < 2:
            return None
        found = min((self.em(*self.start(k)) for k in range(most, least - 1, -1) for _ in range(restarts)), key=lambda f: f.bic)
        strong = found.weight[:-1] >= min_weight
        if not strong.all() and strong.any():
            weight = np.append(found.weight[:-1][strong], found.weight[-1])
            found = self.em(found.alpha[strong], found.beta[strong], weight / weight.sum(), fixed=True)
        return found
