"""Clusters of neighbouring points, their sizes and most typical members (problem 1, second half).

Two kinds of clusters: the components of a mixture of Gaussians (``mixture``) with their sizes and densest members
(``mixture_clusters``), and clusters that are defined by chains of short steps. A mixture cannot give the latter (a component
may hold many of them, and a cluster may bend), so which accounts a chain joins is decided by an exact linking, and the
mixture's density then names the typical members of a chain cluster (``describe``):

* points fall into cells so small that all points of a cell are linked; a cell is summed up by the bounding boxes of its
  sub-cells, a number of rows bounded by geometry and not by the number of points (pre-aggregated before any shuffle);
* cells of one tile, with a rim of two cells, are linked in one bounded task; pairs of sub-cells whose
  boxes leave it open whether two points are near enough are divided again and again, until their boxes decide it;
* the links that leave a tile are contracted by alternating star steps on DataFrames, checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.llm.mixture import fit_mixture, score_mixture
from cartoweave.operators.running import in_ranges
from cartoweave.session import materialise

#: Sub-cells along the side of a cell, cells along the side of a tile.
SUB, TILE = 16, 48


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node of its component.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the longest chain. Every
    round is checkpointed; only a count and a checksum reach the driver.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = large.where("u <> v").distinct()
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()


def _link_block(step: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The linking of one block: rows are sub-cells with their boxes; ``owned`` tells the block's cells from its rim."""

    def run(key: tuple, boxes: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        boxes = boxes.sort_values(["cell", "sub"], kind="stable").reset_index(drop=True)
        cells, first = np.unique(boxes["cell"].to_numpy(), return_index=True)
        last = np.r_[first[1:], len(boxes)]
        owned = boxes["owned"].to_numpy()[first]
        if not owned.any():
            return none
        cx, cy = boxes["cx"].to_numpy()[first], boxes["cy"].to_numpy()[first]
        box = boxes[["x0", "x1", "y0", "y1"]].to_numpy()
        sub = boxes["sub"].to_numpy()
        place = {(x, y): i for i, (x, y) in enumerate(zip(cx.tolist(), cy.tolist(), strict=True))}
        root = np.arange(len(cells))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def bounds(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Squared least and largest distance that points of the boxes i and j can have."""
            a, b = box[i][:, None], box[j][None]
            gap_x = np.maximum(0, np.maximum(a[..., 0] - b[..., 1], b[..., 0] - a[..., 1]))
            gap_y = np.maximum(0, np.maximum(a[..., 2] - b[..., 3], b[..., 2] - a[..., 3]))
            far_x = np.maximum(a[..., 1] - b[..., 0], b[..., 1] - a[..., 0])
            far_y = np.maximum(a[..., 3] - b[..., 2], b[..., 3] - a[..., 2])
            return gap_x**2 + gap_y**2, far_x**2 + far_y**2

        near = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
        links, later, open_pairs, limit = [], [], [], step * step
        for i in range(len(cells)):
            for dx, dy in near:
                j = place.get((cx[i] + dx, cy[i] + dy))
                if j is None or not (owned[i] or owned[j]):
                    continue
                a, b = np.arange(first[i], last[i]), np.arange(first[j], last[j])
                toward = box[a][:, :2].sum(1) * dx + box[a][:, 2:].sum(1) * dy
                away = box[b][:, :2].sum(1) * dx + box[b][:, 2:].sum(1) * dy
                if (bounds(a[np.argsort(-toward)[:4]], b[np.argsort(away)[:4]])[1] <= limit).any():
                    links.append((i, j))
                    if owned[i] and owned[j]:
                        root[find(j)] = find(i)
                else:
                    later.append((i, j, a, b))
        for i, j, a, b in later:
            if owned[i] and owned[j] and find(i) == find(j):
                continue
            low, high = bounds(a, b)
            if (high <= limit).any():
                links.append((i, j))
                if owned[i] and owned[j]:
                    root[find(j)] = find(i)
            elif (low <= limit).any():
                p, q = np.nonzero(low <= limit)
                open_pairs += [(sub[a[x]], sub[b[y]]) for x, y in zip(p, q, strict=True)]
        top: dict[int, int] = {}
        for i in np.flatnonzero(owned):
            r = find(i)
            top[r] = min(top.get(r, cells[i]), cells[i])
        rows = [(0, cells[i], top[find(i)]) for i in np.flatnonzero(owned)]
        rows += [(1, cells[i], cells[j]) for i, j in links if not (owned[i] and owned[j])]
        rows += [(2, x, y) for x, y in open_pairs]
        return pd.DataFrame(rows, columns=["kind", "a", "b"]).astype({"kind": "int32", "a": "int64", "b": "int64"})

    return run


def _divided(placed: DataFrame, pairs: DataFrame, side: float, step: float, most_levels: int = 24) -> DataFrame:
    """(a, b): cells of which two points lie within ``step``, for the open pairs (a, b) of sub-cells.

    Each level cuts the sub-cells of the open pairs ``SUB`` times finer along both sides and compares bounding boxes, at most
    ``SUB ** 4`` a pair whatever number of points they hold. A pair of cells is decided as soon as two boxes are near in every
    case; box pairs that are far in every case leave. Boxes end as single points, which always decide.
    """
    open_pairs = materialise(pairs.select(F.col("a").alias("key_a"), F.col("b").alias("key_b")))
    keys, scale, made = placed.select(F.col("sub").alias("key"), "cell", "x", "y"), float(SUB), None
    for _ in range(most_levels):
        if open_pairs.isEmpty():
            break
        scale *= SUB
        wanted = open_pairs.select(F.col("key_a").alias("key")).union(open_pairs.select("key_b")).distinct()
        fine = [F.floor(F.col(c) * scale / side).cast("long") for c in "xy"]
        keys = materialise(keys.join(wanted, "key", "left_semi").withColumn("fine", F.xxhash64(*fine)))
        boxes = keys.groupBy("key", "cell", "fine").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        p, q = (boxes.select(*[F.col(c).alias(f"{c}_{s}") for c in boxes.columns]) for s in "ab")
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0_a") - F.col(f"{c}1_b"), F.col(f"{c}0_b") - F.col(f"{c}1_a"))
        far = lambda c: F.greatest(F.col(f"{c}1_a") - F.col(f"{c}0_b"), F.col(f"{c}1_b") - F.col(f"{c}0_a"))
        square = lambda f: f("x") * f("x") + f("y") * f("y")
        both = open_pairs.join(p, "key_a").join(q, "key_b").where(square(gap) <= F.lit(step) * F.lit(step))
        both = materialise(both.select("cell_a", "cell_b", "fine_a", "fine_b", (square(far) <= F.lit(step) * F.lit(step)).alias("sure")))
        near = materialise(both.where("sure").select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).distinct())
        made = near if made is None else made.union(near)
        left = both.where("not sure").join(near, (both["cell_a"] == near["a"]) & (both["cell_b"] == near["b"]), "left_anti")
        open_pairs = materialise(left.select(F.col("fine_a").alias("key_a"), F.col("fine_b").alias("key_b")).distinct())
        keys = keys.select(F.col("fine").alias("key"), "cell", "x", "y")
    else:
        raise RuntimeError(f"pairs of cells were open after {most_levels} levels")
    return made if made is not None else pairs.where("false")


def chain_components(points: DataFrame, step: float) -> DataFrame:
    """``points`` (id, x, y, ...) with ``root``: points joined by a chain of steps of at most ``step`` share it.

    Exact for any data: equal points count once, groups of any size are summed up before they are linked.
    """
    side = step / 1.4143
    key = lambda a, b: F.shiftleft(F.col(a), 32) + F.col(b) + F.lit(2**31)
    placed = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)).withColumn("cell", key("cx", "cy"))
    placed = placed.withColumn("gx", F.floor(F.col("x") * SUB / side)).withColumn("gy", F.floor(F.col("y") * SUB / side)).withColumn("sub", key("gx", "gy")).drop("gx", "gy")
    placed = materialise(placed)
    boxes = placed.groupBy("cell", "cx", "cy", "sub").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    tile = lambda c, d: F.floor((F.col(c) + d) / TILE)
    around = F.array_distinct(F.array(*[F.struct(tile("cx", dx).alias("tx"), tile("cy", dy).alias("ty")) for dx in (-2, 0, 2) for dy in (-2, 0, 2)]))
    spread = boxes.withColumn("at", F.explode(around)).withColumn("owned", (F.col("at.tx") == tile("cx", 0)) & (F.col("at.ty") == tile("cy", 0)))
    spread = spread.select("cell", "cx", "cy", "sub", "x0", "x1", "y0", "y1", "owned", F.col("at.tx").alias("tx"), F.col("at.ty").alias("ty"))
    found = materialise(spread.groupBy("tx", "ty").applyInPandas(_link_block(step), "kind int, a long, b long"))
    roots = found.where("kind = 0").select(F.col("a").alias("cell"), F.col("b").alias("local"))
    links = found.where("kind = 1").select("a", "b")
    pairs = found.where("kind = 2").select("a", "b").distinct()
    links = links.union(_divided(placed, pairs, side, step)).distinct()
    a, b = (roots.select(F.col("cell").alias(s), F.col("local").alias(f"local_{s}")) for s in "ab")
    between = links.join(a, "a").join(b, "b").select(F.col("local_a").alias("a"), F.col("local_b").alias("b"))
    merged = connected_components(between)
    final = roots.join(merged, roots["local"] == merged["node"], "left").select("cell", F.coalesce("root", "local").alias("root"))
    return placed.join(final, "cell").drop("cell", "cx", "cy", "sub")


def map_points(df: DataFrame, id_col: str, x_col: str, y_col: str, low: float, high: float) -> DataFrame:
    """(id, x, y) of the points whose coordinates both lie strictly between ``low`` and ``high``.

    Null ids, missing, not-a-number and far-off coordinates leave, repeated rows of one id count once.
    """
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    inside = (x > low) & (x < high) & (y > low) & (y < high) & ~F.isnan(x) & ~F.isnan(y)
    rows = df.where(F.col(id_col).isNotNull() & inside).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), y.alias("y"))
    return materialise(rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y"))


def clusters(points: DataFrame, step: float, least: int) -> DataFrame:
    """(id, x, y, cluster, size) of every member of a chain cluster of at least ``least`` of the ``points`` (id, x, y).

    ``cluster`` is the smallest id in it. An empty table gives none.
    """
    found = materialise(chain_components(points, step))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("cluster")).where(F.col("size") >= least)
    return found.join(sizes, "root").select("id", "x", "y", "cluster", "size")


def with_density(rows: DataFrame, points: DataFrame) -> DataFrame:
    """``rows`` (x, y, ...) with component and log_density of the mixture fitted on all ``points``."""
    model = fit_mixture(points, ["x", "y"])
    if model is None:
        return rows.withColumn("component", F.lit(0)).withColumn("log_density", F.lit(0.0))
    return score_mixture(rows, ["x", "y"], model)


def mixture_clusters(points: DataFrame) -> DataFrame:
    """(id, x, y, component, log_density, cluster, size): every point with the component of the mixture that holds it."""
    scored = materialise(with_density(points, points))
    sizes = scored.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("cluster"))
    return scored.join(F.broadcast(sizes), "component").select(*scored.columns, "cluster", "size")


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, x, y, typical): one row per cluster with its ``typical`` members of highest density, densest first."""
    w = Window.partitionBy("cluster").orderBy(F.desc("log_density"), "id")
    top = members.select("cluster", "id", "log_density").withColumn("place", F.row_number().over(w)).where(F.col("place") <= typical)
    best = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("typical"))
    return members.groupBy("cluster", "size").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).join(best, "cluster")


def followers(members: DataFrame, parts: int | None = None) -> DataFrame:
    """(id_a, id_b): ids that follow each other when the members of a cluster are sorted by id.

    Rows are cut into ranges of cluster and id first, so a cluster that holds a third of all rows is sorted in many tasks; the
    seams between the ranges come from the smallest and largest id of each.
    """
    rows = materialise(in_ranges(members.select("cluster", "id"), F.col("cluster"), F.col("id"), parts=parts).withColumn("range", F.spark_partition_id()))
    inner = rows.select(F.lag("id").over(Window.partitionBy("cluster", "range").orderBy("id")).alias("id_a"), F.col("id").alias("id_b"))
    ends = rows.groupBy("cluster", "range").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    seams = ends.select(F.lag("hi").over(Window.partitionBy("cluster").orderBy("range")).alias("id_a"), F.col("lo").alias("id_b"))
    return inner.union(seams).where("id_a is not null")
