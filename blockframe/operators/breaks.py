"""Natural breaks of one column: classes of least squared deviation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_breaks(values: np.ndarray, weights: np.ndarray, k: int) -> list[float]:
    """Upper edges of at most k classes of sorted distinct values: dynamic programming over all partitions.

    The best last cut never moves down as values are added, so each round halves the range of
    cuts that is left to search: k n log n steps in all.
    """
    n = len(values)
    k = max(1, min(k, n))
    if not n:
        return []
    w, wx, wxx = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * values, weights * values * values))

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared deviation of values[i:j] from their mean."""
        total = w[j] - w[i]
        return (wxx[j] - wxx[i]) - (wx[j] - wx[i]) ** 2 / total

    best = np.concatenate([[0.0], cost(np.zeros(n, int), np.arange(1, n + 1))])
    cuts = []
    for c in range(2, k + 1):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        first, last, low, high = (np.array([x]) for x in (c, n, c - 1, n - 1))
        while len(first):
            j = (first + last) // 2
            size = np.minimum(high, j - 1) - low + 1
            start = np.cumsum(size) - size
            i = np.repeat(low - start, size) + np.arange(size.sum())
            total = best[i] + cost(i, np.repeat(j, size))
            now[j] = np.minimum.reduceat(total, start)
            least = np.flatnonzero(total == np.repeat(now[j], size))
            cut[j] = i[least[np.searchsorted(least, start)]]
            first, last, low, high = (np.concatenate(x) for x in ((first, j + 1), (j - 1, last), (low, cut[j]), (cut[j], high)))
            some = first <= last
            first, last, low, high = first[some], last[some], low[some], high[some]
        best = now
        cuts.append(cut)
    edges, j = [], n
    for cut in reversed(cuts):
        edges.append(float(values[j - 1]))
        j = cut[j]
    return [*reversed([*edges, float(values[j - 1])])]


def class_breaks(df: DataFrame, k: int) -> list[float]:
    """Breaks of df.v over the whole column. The driver gets every distinct value with its count, 16 bytes each."""
    counts = df.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).toArrow()
    values, weights = (counts.column(c).to_numpy().astype(float) for c in ("v", "n"))
    order = np.argsort(values)
    return natural_breaks(values[order], weights[order], k)
