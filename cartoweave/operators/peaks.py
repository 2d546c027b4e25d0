"""Peaks of token densities and the labels made of them.

The grid of one token has at most width * height cells (points are summed up by pixel before), so one token is a bounded group
for ``applyInPandas``. Within it everything works on whole arrays: steepest ascent as pointers that are doubled until they
stand still, flooding as level sets, close peaks by merging labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_HEIGHT, CLOSE, MOST_PEAKS, LEAST_PEAK = 0.5, 10.0, 15, 1.0
MOST_PER_TOKEN, SIGNIFICANT = 5, 20.0
SCHEMA = "token string, x double, y double, value double, sum double, centre_x double, centre_y double, significance double, size long"


def _scored(peaks: pd.DataFrame, count: float) -> pd.DataFrame:
    """significance and size of peaks."""
    significance = peaks["sum"] / count
    size = (significance * np.log(peaks["sum"]) * np.sqrt(peaks["value"])) ** 2
    return peaks.assign(significance=significance, size=np.floor(size).astype(np.int64))


def climb(grid: np.ndarray, least: float = MIN_HEIGHT) -> pd.DataFrame:
    """Every inner cell above ``least`` belongs to the peak that steepest ascent leads to; one row per peak.

    On ties the order is up, down, left, right (the first that is steeper). Ascents that end on the rim have no peak.
    """
    h, w = grid.shape
    best = grid.copy()
    goal = np.arange(h * w).reshape(h, w)
    inner = np.zeros((h, w), bool)
    inner[1:-1, 1:-1] = True
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        shifted = np.full((h, w), -np.inf)
        ys, yd = (slice(max(0, dy), h + min(0, dy)), slice(max(0, -dy), h + min(0, -dy)))
        xs, xd = (slice(max(0, dx), w + min(0, dx)), slice(max(0, -dx), w + min(0, -dx)))
        shifted[yd, xd] = grid[ys, xs]
        better = inner & (shifted > best)
        best = np.where(better, shifted, best)
        goal[better] = (np.arange(h * w).reshape(h, w) + dy * w + dx)[better]
    to = goal.ravel()
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    used = np.flatnonzero((inner & (grid > least)).ravel() & inner.ravel()[to])
    tops, which = np.unique(to[used], return_inverse=True)
    v = grid.ravel()[used]
    total = np.bincount(which, v, minlength=len(tops))
    y, x = np.divmod(used, w)
    return pd.DataFrame({"x": (tops % w).astype(float), "y": (tops // w).astype(float), "value": grid.ravel()[tops], "sum": total, "centre_x": np.bincount(which, v * x, minlength=len(tops)) / np.maximum(total, 1e-300), "centre_y": np.bincount(which, v * y, minlength=len(tops)) / np.maximum(total, 1e-300)})


def descend(grid: np.ndarray, least: float = MIN_HEIGHT, most: int = MOST_PEAKS) -> pd.DataFrame:
    """Take the highest cell, flood downhill from it, clear what was flooded, and again, up to ``most`` times.

    Cells on the rim are taken but not passed; a flood takes neighbours that are lower and above ``least``.
    """
    left = grid.copy()
    h, w = left.shape
    rows = []
    for _ in range(most):
        top = int(left.argmax()) if left.size else 0
        if not left.size or left.flat[top] < LEAST_PEAK:
            break
        value = float(left.flat[top])
        edge, heights = np.array([top]), np.array([value])
        left.flat[top] = 0.0
        cells, values = [edge], [heights]
        while len(edge):
            y, x = np.divmod(edge, w)
            inner = (y > 0) & (y < h - 1) & (x > 0) & (x < w - 1)
            around = np.concatenate([edge[inner] + s for s in (-w, w, -1, 1)]) if inner.any() else np.zeros(0, np.int64)
            above = np.tile(heights[inner], 4)
            own = left.ravel()[around]
            edge = np.unique(around[(own < above) & (own > least)])
            heights = left.ravel()[edge]
            left.flat[edge] = 0.0
            cells.append(edge)
            values.append(heights)
        at, v = np.concatenate(cells), np.concatenate(values)
        rows.append((float(top % w), float(top // w), value, v.sum(), (v * (at % w)).sum() / v.sum(), (v * (at // w)).sum() / v.sum()))
    return pd.DataFrame(rows, columns=["x", "y", "value", "sum", "centre_x", "centre_y"])


def blend(peaks: pd.DataFrame, close: float = CLOSE) -> pd.DataFrame:
    """Peaks joined by chains of steps under ``close`` become one, placed by their sums.

    Value, significance and size stay those of the first peak of a group.
    """
    n = len(peaks)
    if n < 2:
        return peaks
    xy = peaks[["x", "y"]].to_numpy()
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) < close * close
    group = np.arange(n)
    while True:
        lower = np.where(near, group[None], n).min(1)
        if (lower == group).all():
            break
        group = lower
    out = peaks.copy()
    heads, which = np.unique(group, return_inverse=True)
    mass = np.bincount(which, peaks["sum"])
    for c in ("x", "y", "centre_x", "centre_y"):
        out.loc[out.index[heads], c] = np.bincount(which, peaks["sum"] * peaks[c]) / mass
    out.loc[out.index[heads], "sum"] = mass
    return out.iloc[heads]


METHODS: dict[str, Callable[[np.ndarray], pd.DataFrame]] = {"climb": climb, "descend": descend}


def token_peaks(grids: DataFrame, width: int, height: int, method: str = "climb") -> DataFrame:
    """Blended peaks of every token; ``grids`` is (token, gx, gy, v, count) with the token's number of mentions."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width))
        np.add.at(grid, (cells["gy"].to_numpy(), cells["gx"].to_numpy()), cells["v"].to_numpy())
        found = METHODS[method](grid)
        if not len(found):
            return pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")}).astype({"token": object, "size": "int64"})
        made = blend(_scored(found, float(cells["count"].iloc[0])))
        return made.assign(token=cells["token"].iloc[0])[["token", "x", "y", "value", "sum", "centre_x", "centre_y", "significance", "size"]]

    return grids.groupBy("token").applyInPandas(run, SCHEMA)


def label_candidates(totals: DataFrame, least: int = 150, longest: int = 15) -> DataFrame:
    """Tokens that may become labels: frequent, short, no mention and no link."""
    return totals.where((F.col("count") >= least) & ~F.col("token").startswith("@") & ~F.col("token").startswith("http") & (F.length("token") <= longest))


def token_labels(peaks: DataFrame, most: int = MOST_PER_TOKEN, significant: float = SIGNIFICANT) -> DataFrame:
    """The ``most`` significant peaks of a token that reach the threshold, placed between peak and centre."""
    w = Window.partitionBy("token").orderBy(F.desc("significance"), "y", "x")
    best = peaks.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & (F.col("significance") >= significant))
    return best.select("token", ((F.col("x") * 2 + F.col("centre_x") + 0.5) / 3).alias("x"), ((F.col("y") * 2 + F.col("centre_y") + 0.5) / 3).alias("y"), "size", "significance")


def winnowed(labels: DataFrame, local: DataFrame, wanted: int = 10_000) -> DataFrame:
    """The ``wanted`` labels of the largest significance once it is divided by crowding; ``local`` is (gx, gy, v), the density
    of the labels. Without chance: the least significant leave."""
    most = local.agg(F.max("v").alias("most"))
    placed = labels.withColumn("gx", F.col("x").cast("int")).withColumn("gy", F.col("y").cast("int"))
    crowd = placed.join(local, ["gx", "gy"], "left").join(F.broadcast(most))
    made = crowd.withColumn("significance", F.col("significance") / (F.col("most") + 3 * F.coalesce("v", F.lit(0.0))))
    return made.orderBy(F.desc("significance"), "token", "x", "y").limit(wanted).select("token", "x", "y", "size", "significance")
