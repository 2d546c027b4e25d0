"""Density grids of weighted points and their algebra.

A grid is long: (gx, gy, v), cells that are not there are 0. Points are summed up by pixel before they are spread, so the
spreading works on at most width * height rows whatever the number of points. The Gaussian is separable: two passes of
explode and sum instead of one over the square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.functions.quad import within

FAINT = 0.001


def kernel(k: float, threshold: float = 0.01) -> list[float]:
    """One side of the kernel, exp(k d^2) for d = 0, 1, ... up to and with the first value that is not above the threshold."""
    reach = math.ceil(math.sqrt(math.log(threshold or 0.01) / k))
    side = [math.exp(k * d * d) for d in range(reach + 2)]
    last = next(i for i, f in enumerate(side) if f <= (threshold or 0.01))
    return side[: last + 1]


@dataclass(frozen=True)
class Frame:
    """The rectangle of a picture: its lower bounds, pixels per unit, and size in pixels."""

    min_x: float
    min_y: float
    x_scale: float
    y_scale: float
    width: int
    height: int

    def zoomed(self, zoom: int, x: float, y: float, width: int, height: int) -> Frame:
        """the part of 2 ** -zoom of the sides around (x, y), pushed inside the whole, as a picture of its own size."""
        part = 0.5**zoom
        sides = []
        for low, scale, size, centre, pixels in ((self.min_x, self.x_scale, self.width, x, width), (self.min_y, self.y_scale, self.height, y, height)):
            whole = size / scale
            own = whole * part
            sides.append((min(max(low, centre - own / 2), low + whole - own), pixels / own))
        return Frame(sides[0][0], sides[1][0], sides[0][1], sides[1][1], width, height)

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """pixel coordinates, cut towards 0."""
        return ((x - self.min_x) * self.x_scale).cast("int"), ((y - self.min_y) * self.y_scale).cast("int")


def extrema(points: DataFrame) -> DataFrame:
    """One row of the least and largest coordinates and the largest value."""
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.max("v").alias("max_value"))


def fitted_frame(points: DataFrame, width: int, height: int, padding: int, squish: bool = False) -> Frame:
    """The frame that holds all points with a rim of ``padding`` pixels; one scale for both axes unless ``squish``."""
    e = extrema(points).first()
    if e["min_x"] is None:
        return Frame(0.0, 0.0, 1.0, 1.0, width, height)
    sx = (width - 2 * padding) / max(e["max_x"] - e["min_x"], 1e-9)
    sy = (height - 2 * padding) / max(e["max_y"] - e["min_y"], 1e-9)
    low_x, low_y = e["min_x"] - padding / sx, e["min_y"] - padding / sy
    return Frame(low_x, low_y, sx, sy, width, height) if squish else Frame(low_x, low_y, min(sx, sy), min(sx, sy), width, height)


def _spread(cells: DataFrame, axis: str, side: list[float], size: int) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(side[abs(d)]).alias("f")) for d in range(1 - len(side), len(side))])
    other = "gy" if axis == "gx" else "gx"
    moved = cells.select(other, F.explode(offsets).alias("o"), axis, "v").select(other, (F.col(axis) + F.col("o.d")).alias(axis), (F.col("v") * F.col("o.f")).alias("v"))
    return moved.where((F.col(axis) >= 0) & (F.col(axis) < size)).groupBy("gx", "gy").agg(F.sum("v").alias("v"))


def density(points: DataFrame, frame: Frame, k: float, threshold: float = 0.01) -> DataFrame:
    """The points (x, y, v) blurred by the kernel on the frame's pixels; column values under 0.001 go no further.

    Points whose column lies outside the picture do not count, points above or below it count where their blur reaches in.
    """
    side = kernel(k, threshold)
    px, py = frame.pixel(F.col("x"), F.col("y"))
    at = points.where("x is not null and y is not null and v is not null").groupBy(px.alias("gx"), py.alias("gy")).agg(F.sum("v").cast("double").alias("v"))
    tall = _spread(at, "gy", side, frame.height).where(F.col("v") >= FAINT)
    return _spread(tall, "gx", side, frame.width)


def zoomed_density(points: DataFrame, whole: Frame, zoom: int, x: float, y: float, width: int, height: int, k: float, threshold: float = 0.01) -> DataFrame:
    """The density of a zoomed part; the kernel widens in points and only points within its reach are read."""
    own = whole.zoomed(zoom, x, y, width, height)
    k = k / 4**zoom
    reach = len(kernel(k, threshold))
    near = within("x", "y", own.min_x - reach / own.x_scale, own.min_x + (width + reach) / own.x_scale, own.min_y - reach / own.y_scale, own.min_y + (height + reach) / own.y_scale)
    return density(points.where(near), own, k, threshold)


def mean_of_cells(grid: DataFrame) -> DataFrame:
    """One row, the mean of the cells that are not 0."""
    return grid.agg(F.avg(F.when(F.col("v") != 0, F.col("v"))).alias("mean"))


def _full(grid: DataFrame, width: int, height: int) -> DataFrame:
    spark = grid.sparkSession
    cells = spark.range(width * height).select((F.col("id") % width).cast("int").alias("gx"), F.expr(f"cast(id div {width} as int)").alias("gy"))
    return cells.join(grid, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("v", F.lit(0.0)).alias("v"))


def gate(grid: DataFrame) -> DataFrame:
    """What is above the mean of the cells that are not 0."""
    return grid.join(F.broadcast(mean_of_cells(grid))).select("gx", "gy", F.greatest(F.lit(0.0), F.col("v") - F.col("mean")).alias("v"))


#: Operators on one grid; those that do not keep 0 (log, exp) need the whole picture. The logarithm of 0 is null.
UNARY: dict[str, Callable[[Column], Column]] = {"~": F.ln, "^": lambda v: F.pow(F.lit(1.01), v), "`": F.sqrt, '"': lambda v: v * v * v}
GATE = "\\"
KEEPS_ZERO = {"`", '"'}
#: Operators on two grids.
BINARY: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "-": lambda a, b: F.greatest(F.lit(0.0), a - b), "^": lambda a, b: F.abs(a - b)}


def unary(grid: DataFrame, op: str, width: int, height: int) -> DataFrame:
    """A named operator on every cell of the picture."""
    if op == GATE:
        return gate(grid)
    whole = grid if op in KEEPS_ZERO else _full(grid, width, height)
    return whole.select("gx", "gy", UNARY[op](F.col("v")).alias("v"))


def binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """A named operator on two grids; a product needs the cells of both only."""
    left, right = a.select("gx", "gy", F.col("v").alias("a")), b.select("gx", "gy", F.col("v").alias("b"))
    both = left.join(right, ["gx", "gy"], "inner" if op == "*" else "full")
    return both.select("gx", "gy", BINARY[op](F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("v"))


def top_points(points: DataFrame, n: int) -> DataFrame:
    """The n points of the largest values, ties by coordinates."""
    return points.orderBy(F.desc("v"), "x", "y").limit(n)


def visible_labels(labels: DataFrame, zoom: float, size: str = "value") -> DataFrame:
    """Labels that are drawn at a zoom."""
    return labels.where(F.pow(F.ln(F.col(size).cast("double")), 2) * 0.02 * (1.4 + zoom) >= 8)


def height_scale(v: Column, largest: float, mode: str, steps: int, top: float, *args: float) -> Column:
    """heights as whole numbers up to ``top``: linear, base (power) or clipped_gaussian; above the largest flat."""
    i = F.least(F.floor(v * ((steps - 0.1) / largest)), F.lit(steps - 1)).cast("double")
    if mode == "linear":
        made = i * top / steps
    elif mode == "base":
        made = (F.pow(i, F.lit(args[0])) - 0.5) * (top / steps ** args[0])
    elif mode == "clipped_gaussian":
        low, high = args
        made = (F.exp(low + i / steps * abs(low - high)) - math.exp(low)) * (top / (math.exp(high) - math.exp(low)))
    else:
        raise ValueError(f"unknown mode {mode}")
    return made.cast("bigint")


def kde(points: DataFrame, side: int = 100, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Gaussian kernel density of (x, y) on side x side places, bandwidth by Scott's rule over the sample covariance.

    Bounds are 1.2 times the extrema unless given (x0, x1, y0, y1). Every task adds its points to one grid; grids are summed,
    so no pair of place and point is ever a row. Fewer than three points, or points on a line, give an empty result.
    """
    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(F.col("x").cast("double"), F.col("y").cast("double"))
    s = p.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.covar_samp("x", "x").alias("xx"), F.covar_samp("x", "y").alias("xy"), F.covar_samp("y", "y").alias("yy")).first()
    schema = "gx int, gy int, v double"
    if s["n"] < 3 or s["xx"] * s["yy"] - s["xy"] ** 2 <= 0:
        return points.sparkSession.createDataFrame([], schema)
    x0, x1, y0, y1 = bounds or tuple(1.2 * s[i] for i in (1, 2, 3, 4))
    n = s["n"]
    cov = np.array([[s["xx"], s["xy"]], [s["xy"], s["yy"]]]) * n ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 1 / (n * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    gx, gy = np.meshgrid(np.linspace(x0, x1, side), np.linspace(y0, y1, side), indexing="ij")
    places = np.stack([gx.ravel(), gy.ravel()], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places))
        for b in batches:
            at = np.stack([b.column("x").to_numpy(), b.column("y").to_numpy()], 1)
            for lo in range(0, len(at), 256):
                d = places[:, None] - at[None, lo : lo + 256]
                total += np.exp(-0.5 * (d[..., 0] ** 2 * inv[0, 0] + 2 * d[..., 0] * d[..., 1] * inv[0, 1] + d[..., 1] ** 2 * inv[1, 1])).sum(1)
        i = np.arange(len(places), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i // side), pa.array(i % side), pa.array(total * norm)], ["gx", "gy", "v"])

    return p.mapInArrow(run, schema).groupBy("gx", "gy").agg(F.sum("v").alias("v"))


def hill_shade(grid: DataFrame, scale: float, angle: float, altitude: float) -> DataFrame:
    """light on the slopes of a grid, 0 to 1, for cells next to a cell that is not 0.

    The gradient is the 3 x 3 difference with weights 1, 2, 1; every cell is handed to its eight neighbours once, so no join of
    the grid with itself is needed. With g the scaled gradient, the light is (sin a + cos a * (g towards the light)) / |normal|.
    """
    spots = [(ox, oy, ox * (2 - abs(oy)), -oy * (2 - abs(ox))) for ox in (-1, 0, 1) for oy in (-1, 0, 1) if ox or oy]
    around = F.array(*[F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), F.lit(wx).alias("wx"), F.lit(wy).alias("wy")) for ox, oy, wx, wy in spots])
    handed = grid.select("gx", "gy", "v", F.explode(around).alias("o"))
    slopes = handed.groupBy((F.col("gx") + F.col("o.ox")).alias("gx"), (F.col("gy") + F.col("o.oy")).alias("gy")).agg((F.sum(F.col("v") * F.col("o.wx")) * scale).alias("dx"), (F.sum(F.col("v") * F.col("o.wy")) * scale).alias("dy"))
    across = angle - math.pi / 2
    toward = F.col("dy") * math.cos(across) + F.col("dx") * math.sin(across)
    light = (math.sin(altitude) + math.cos(altitude) * toward) / F.sqrt(1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return slopes.select("gx", "gy", F.greatest(light, F.lit(0.0)).alias("v"))
