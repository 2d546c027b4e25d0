"""Nearest rows between two blocks of vectors, by one matrix product and an exact check."""

from __future__ import annotations

import numpy as np

#: Pairs that are measured exactly at once.
PAIRS_AT_ONCE = 100_000


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows a[i] and b[j], in float64 from their differences."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        d = a[i[lo : lo + PAIRS_AT_ONCE]] - b[j[lo : lo + PAIRS_AT_ONCE]]
        out[lo : lo + PAIRS_AT_ONCE] = np.sqrt((d * d).sum(1))
    return out


def first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted group numbers are among the first k of their group."""
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)])) < k


def nearest_in_block(ids: np.ndarray, x: np.ndarray, own: np.ndarray, others: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int, within: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, distance): for the rows ``own`` of x the k nearest of the rows ``others`` of y, ties by the smaller id.

    A row is no neighbour of itself (its id). One matrix product in float32 around the local mean leaves the candidates, with
    room for its error; those are measured exactly, so the result does not depend on how rows are cut into blocks.
    """
    if not len(own) or not len(others):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    centre = y[others].mean(0)
    a, b = (x[own] - centre).astype(np.float32), (y[others] - centre).astype(np.float32)
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    d2 = sa[:, None] + sb - 2 * (a @ b.T)
    d2[ids[own][:, None] == other_ids[others]] = np.inf
    slack = 1e-5 * (sa + sb.max())
    bound = (np.partition(d2, k - 1, axis=1)[:, k - 1] if len(others) > k else np.full(len(own), np.inf, np.float32)) + 2 * slack
    if within is not None:
        bound = np.minimum(bound, np.float32(within**2) + 2 * slack)
    i, j = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
    d = distances(x, y, own[i], others[j])
    by = np.lexsort((other_ids[others[j]], d, i))
    i, j, d = i[by], j[by], d[by]
    near = first_of_each(i, k)
    return ids[own[i[near]]], other_ids[others[j[near]]], d[near]
