"""Exact t-SNE (M10-M15, and of M19 the principal axes before it) on the driver for at most LIMIT codes; new points are placed distributed.

Placing a new row freezes the fitted ones and moves only the row, so all other rows of a table are placed by tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 5_000
Q_FLOOR = 1e-12


def principal(rows: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(id, v): the vectors around their mean on their ``dims`` principal axes, as they go into t-SNE.

    The axes come from one distributed pass; vectors have finite numbers and one length. No more axes than numbers are taken.
    """
    width = rows.select(F.max(F.size(vector))).first()[0]
    if not width:
        return rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    mean = rows.agg(*[F.avg(F.col(vector)[i]) for i in range(width)]).first()
    centred = F.transform(F.arrays_zip(F.col(vector).alias("a"), F.array(*[F.lit(m) for m in mean]).alias("b")), lambda p: p["a"] - p["b"])
    made = rows.select(F.col(id_col).alias("id"), array_to_vector(centred).alias("features"))
    model = PCA(k=min(dims, width), inputCol="features", outputCol="axes").fit(made)
    return model.transform(made).select("id", vector_to_array("axes").alias("v"))


def squared_distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Squared Euclidean distances by one matrix product."""
    y = x if y is None else y
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def similarities(dist: np.ndarray, perplexity: float, own: bool = True, tries: int = 50, tolerance: float = 1e-5, compat: bool = False) -> np.ndarray:
    """Row similarities whose entropy is log(perplexity), found by bisection of all rows at once.

    ``own``: the diagonal is left out. ``compat`` takes the entropy of the undivided kernel in place of the normalised one.
    """
    n = len(dist)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    aim = np.log(perplexity)
    mask = np.eye(n, dist.shape[1], dtype=bool) if own else np.zeros(dist.shape, bool)
    for _ in range(tries):
        p = np.where(mask, 0, np.exp(-dist * beta[:, None]))
        total = np.maximum(p.sum(1), 1e-300)
        mean = (dist * p).sum(1)
        entropy = np.log(total) + beta * (mean if compat else mean / total)
        off = entropy - aim
        if (np.abs(off) < tolerance).all():
            break
        low, high = np.where(off > 0, beta, low), np.where(off > 0, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / total[:, None]


def joint(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric similarities that add up to 1."""
    p = similarities(squared_distances(x), perplexity)
    p = p + p.T
    return np.maximum(p / p.sum(), Q_FLOOR)


def gradient(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient and the Kullback-Leibler divergence."""
    num = 1 / (1 + squared_distances(y))
    np.fill_diagonal(num, 0)
    q = np.maximum(num / num.sum(), Q_FLOOR)
    w = (p - q) * num
    return w.sum(1)[:, None] * y - w @ y, float((p * np.log(p / q)).sum())


def fit(x: np.ndarray, perplexity: float = 30.0, iterations: int = 300, dims: int = 2, seed: int = 1, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coordinates and divergence: exaggeration by 4 for 100 iterations, momentum 0.5 then 0.8, gains, recentring."""
    if len(x) > LIMIT:
        raise ValueError(f"exact t-SNE takes at most {LIMIT} rows")
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 1e-2, (len(x), dims)) if start is None else start.copy()
    if len(x) < 3:
        return y, 0.0
    p, move, gains, cost = joint(x, min(perplexity, (len(x) - 1) / 3)), np.zeros_like(y), np.ones_like(y), 0.0
    for i in range(iterations):
        g, cost = gradient(p * 4 if i < min(100, iterations // 3) else p, y)
        gains = np.maximum(np.where((g > 0) != (move > 0), gains + 0.2, gains * 0.8), 0.01)
        move = (0.5 if i < 20 else 0.8) * move - min(500.0, len(x)) * gains * g
        y = y + move
        y -= y.mean(0)
    return y, cost


def annealed(x: np.ndarray, target: float, iterations: int = 300, seed: int = 1) -> np.ndarray:
    """Perplexity from half the rows, halved down to the target, iterations in equal parts; at least one fit."""
    steps, now = [], len(x) / 2
    while now > target:
        steps.append(now)
        now /= 2
    steps.append(target)
    y = None
    for perplexity in steps:
        y, _ = fit(x, perplexity, max(1, iterations // len(steps)), seed=seed, start=y)
    return y


def sweep(x: np.ndarray, perplexities: range = range(20), iterations: int = 100) -> pd.DataFrame:
    """(perplexity, divergence) of every perplexity that can be fitted."""
    rows = [(p, fit(x, float(p), iterations)[1]) for p in perplexities if p >= 2]
    return pd.DataFrame(rows, columns=["perplexity", "divergence"])


def place(new: np.ndarray, x: np.ndarray, y: np.ndarray, perplexity: float = 10.0, steps: int = 60) -> np.ndarray:
    """Coordinates of new rows next to the frozen ones, all rows at once; each starts at its similarity-weighted mean."""
    if not len(new):
        return np.zeros((0, y.shape[1]))
    p = similarities(squared_distances(new, x), min(perplexity, max(1.5, len(x) / 3)), own=False)
    at = p @ y
    for _ in range(steps):
        num = 1 / (1 + squared_distances(at, y))
        q = num / num.sum(1, keepdims=True)
        w = (p - q) * num
        at = at - 0.5 * (w.sum(1)[:, None] * at - w @ y)
    return at


def place_rows(rows: DataFrame, id_col: str, vector: str, x: np.ndarray, y: np.ndarray, perplexity: float = 10.0) -> DataFrame:
    """(id, x, y) of every row; null vectors have no place. At most LIMIT frozen rows are broadcast."""
    if len(x) > LIMIT:
        raise ValueError(f"at most {LIMIT} frozen rows")
    shared = rows.sparkSession.sparkContext.broadcast((x, y))

    def run(frames):  # noqa: ANN001, ANN202
        fx, fy = shared.value
        for f in frames:
            at = place(np.stack(f["v"].to_list()).astype(float), fx, fy, perplexity) if len(f) else np.zeros((0, 2))
            yield pd.DataFrame({"id": f["id"].to_numpy(), "x": at[:, 0], "y": at[:, 1]})

    picked = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return picked.mapInPandas(run, "id long, x double, y double")
