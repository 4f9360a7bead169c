"""One-dimensional cutting stock by column generation, on a length histogram.

The master linear program covers the demand of every length with *patterns* (how many pieces of
each length one sequence takes) at the least number of sequences. Its duals price the lengths;
an unbounded knapsack, solved by dynamic programming over the capacity, finds the pattern with
the greatest worth; it enters the basis by a revised-simplex pivot. Iteration stops when no
pattern is worth more than one sequence, or when Farley's bound shows the program to be within
``gap`` of its optimum. Pattern uses are rounded down and the remainder (fewer sequences than
there are lengths) is placed by best fit decreasing.

Everything here depends on the number of lengths and the capacity, never on how many pieces
there are.
"""

from __future__ import annotations

import numpy as np

from densitykit.llm.bins import best_fit_decreasing


def knapsack(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Greatest worth of pieces (any number of each) within the capacity, and their counts."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    ln, w = lengths[order], worth[order]
    upto = np.searchsorted(ln, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            v = best[c - ln[:k]] + w[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], pick[c] = v[i], i
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(ln[pick[c]])
    return float(best[capacity]), counts


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001, max_columns: int = 5000):
    """``(patterns, uses, bound)`` of the linear program: one row of ``patterns`` for each column
    in the basis, its fractional use, and a lower bound on the number of sequences."""
    m = len(lengths)
    fit = capacity // lengths
    patterns = np.diag(fit).astype(np.int64)
    inverse = np.diag(1.0 / fit)
    x = demand / fit
    bound = 0.0
    for _ in range(max_columns):
        dual = inverse.sum(axis=0)  # every sequence costs 1
        value, column = knapsack(np.maximum(dual, 0), lengths, capacity)
        z = float(x.sum())
        bound = max(bound, z / max(value, 1.0))
        if value <= 1 + 1e-7 or z <= bound * (1 + gap):
            break
        d = inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        r = int(ratio.argmin())
        step = ratio[r]
        x = x - step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        patterns[r] = column
    return patterns, np.maximum(x, 0), bound


def plan(lengths: list[int], demand: list[int], capacity: int, gap: float = 0.001) -> tuple[list[tuple[int, list[tuple[int, int]]]], float]:
    """``[(sequences, [(length, pieces in each), ..]), ..]`` that place every piece once, and the
    program's lower bound on the number of sequences."""
    if not lengths:
        return [], 0.0
    ln, dm = np.array(lengths, np.int64), np.array(demand, np.int64)
    patterns, uses, bound = solve(ln, dm.astype(float), capacity, gap)
    whole = np.floor(uses + 1e-9).astype(np.int64)
    while True:  # floating-point noise must not cover a length twice
        over = patterns.T @ whole > dm
        if not over.any():
            break
        bad = np.flatnonzero((whole > 0) & (patterns[:, over] > 0).any(axis=1))
        whole[bad] -= 1
    out = [(int(k), [(int(ln[i]), int(p[i])) for i in np.flatnonzero(p)]) for p, k in zip(patterns, whole) if k]
    rest = dm - patterns.T @ whole
    placed, _ = best_fit_decreasing([(int(s), int(c)) for s, c in zip(ln, rest) if c], capacity)
    bins: dict[int, dict[int, int]] = {}
    for s, b, k in placed:
        held = bins.setdefault(b, {})
        held[s] = held.get(s, 0) + k
    out += [(1, sorted(h.items(), reverse=True)) for h in bins.values()]
    return out, bound
