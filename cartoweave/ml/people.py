"""Mixtures of positioned people and their labels (M16-M18), and nearest codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.ml.blocks import first_of_each, nearest_in_block
from cartoweave.session import materialise

#: Rows of the query set that are broadcast at once, and compared at once.
QUERY_BLOCK, ROWS_AT_ONCE = 16_384, 256


def fit_mixture(points: DataFrame, components: int, weight: str | None = None, seed: int = 1, rounds: int = 100) -> GaussianMixtureModel:
    """A Gaussian mixture of (x, y), each point with its weight."""
    rows = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(array_to_vector(F.array("x", "y")).alias("features"), *([weight] if weight else []))
    mixture = GaussianMixture(k=components, maxIter=rounds, seed=seed, featuresCol="features")
    return (mixture.setWeightCol(weight) if weight else mixture).fit(rows)


def components(model: GaussianMixtureModel) -> DataFrame:
    """(weight, x, y, xx, xy, yy) and the angle and axes of every component, largest weight first."""
    g = model.gaussiansDF
    from pyspark.ml.functions import vector_to_array

    spark = g.sparkSession
    rows = []
    for w, r in zip(model.weights, g.select(vector_to_array("mean").alias("m"), "cov").collect(), strict=True):
        c = r["cov"].toArray()
        rows.append((float(w), float(r["m"][0]), float(r["m"][1]), float(c[0, 0]), float(c[0, 1]), float(c[1, 1])))
    made = spark.createDataFrame(rows, "weight double, x double, y double, xx double, xy double, yy double")
    angle, long, short = orientation(F.col("xx"), F.col("xy"), F.col("yy"))
    return made.select("*", angle.alias("angle"), long.alias("long"), short.alias("short")).orderBy(F.desc("weight"), "x", "y")


def orientation(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """Angle of the long axis in (-90, 90] degrees (0 for a circle), and both standard deviations of a 2 x 2 covariance."""
    half = (xx + yy) / 2
    reach = F.sqrt(F.pow((xx - yy) / 2, 2) + xy * xy)
    angle = F.degrees(F.atan2(2 * xy, xx - yy)) / 2
    return F.when(reach < 1e-9 * F.greatest(half, F.lit(1e-300)), 0.0).otherwise(angle), F.sqrt(half + reach), F.sqrt(F.greatest(half - reach, F.lit(0.0)))


def word_labels(people: DataFrame, words: list[str], components_per_word: int = 2, rounds: int = 30, growth: float = 1e-4) -> DataFrame:
    """(word, weight, x, y): the means of a mixture for each word, people weighted by its share of the largest count.

    ``people`` is (x, y, histo array<double>); the words are the positions of the histogram. All words are fitted in the same
    passes: each pass sums the responsibilities by word, and only these sums (a row per word) reach the driver. Steps end when
    no word's mean log-likelihood grows by ``growth``. Components start along the long axis of
    the word's people.
    """
    k = components_per_word
    most = people.select(F.posexplode("histo").alias("word", "n")).groupBy("word").agg(F.max("n").alias("most")).where("most > 0")
    rows = people.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("x", "y", F.posexplode("histo").alias("word", "n")).where("n > 0")
    rows = materialise(rows.join(F.broadcast(most), "word").where(F.col("word") < len(words)).select("word", "x", "y", (F.col("n") / F.col("most")).alias("w")))
    sums = lambda r: [F.sum(v * r) for v in (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"), F.col("y") * F.col("y"))]
    fits: dict[int, np.ndarray] = {}
    for r in rows.groupBy("word").agg(*sums(F.col("w"))).collect():
        n, mean, cov = _gaussians(np.array(r[1:])[None])
        spread, axes = np.linalg.eigh(cov[0])
        side = np.sqrt(spread[-1]) * axes[:, -1]
        places = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
        fits[r[0]] = np.stack([np.r_[1 / k, mean[0] + p * side, cov[0, 0, 0], cov[0, 0, 1], cov[0, 1, 1]] for p in places])
    spark, likelihood = people.sparkSession, dict.fromkeys(fits, -np.inf)
    for _ in range(rounds if fits else 0):
        now = spark.createDataFrame([(i, f.tolist()) for i, f in fits.items()], "word int, f array<array<double>>")
        dx, dy = (lambda c: F.col("x") - c[1]), (lambda c: F.col("y") - c[2])
        det = lambda c: c[3] * c[5] - c[4] * c[4]
        squared = lambda c: (dx(c) * dx(c) * c[5] - 2 * dx(c) * dy(c) * c[4] + dy(c) * dy(c) * c[3]) / det(c)
        parts = F.transform("f", lambda c: c[0] * F.exp(-squared(c) / 2) / F.sqrt(det(c)) + F.lit(1e-300))
        scored = rows.join(F.broadcast(now), "word").select("word", "x", "y", "w", parts.alias("p")).withColumn("whole", F.aggregate("p", F.lit(0.0), lambda s, v: s + v))
        columns = [c for j in range(k) for c in sums(F.col("w") * F.col("p")[j] / F.col("whole"))]
        moved = 0.0
        for r in scored.groupBy("word").agg((F.sum(F.col("w") * F.log("whole")) / F.sum("w")).alias("l"), *columns).collect():
            n, mean, cov = _gaussians(np.array(r[2:]).reshape(k, 6))
            fits[r[0]] = np.c_[n / n.sum(), mean, cov[:, 0, 0], cov[:, 0, 1], cov[:, 1, 1]]
            moved, likelihood[r[0]] = max(moved, r[1] - likelihood[r[0]]), r[1]
        if moved < growth:
            break
    made = [(words[i], float(c[0]), float(c[1]), float(c[2])) for i, f in sorted(fits.items()) for c in f[np.argsort(-f[:, 0], kind="stable")]]
    return spark.createDataFrame(made, "word string, weight double, x double, y double")


def _gaussians(sums: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances) from rows of sums of 1, x, y, xx, xy and yy."""
    n = np.maximum(sums[:, 0], 1e-300)
    mean = sums[:, 1:3] / n[:, None]
    xx, xy, yy = (sums[:, i] / n - a * b for i, a, b in ((3, mean[:, 0], mean[:, 0]), (4, mean[:, 0], mean[:, 1]), (5, mean[:, 1], mean[:, 1])))
    cov = np.stack([np.stack([xx, xy], 1), np.stack([xy, yy], 1)], 1)
    return n, mean, cov + (ridge + np.maximum(0, -np.linalg.eigvalsh(cov)[:, 0]))[:, None, None] * np.eye(2)


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(id, neighbour, distance, place): the exact k nearest others of every query; ties by the smaller id.

    ``rows`` and ``queries`` are (id, v). Queries are broadcast in blocks of about QUERY_BLOCK rows, each with one pass over
    the rows; every task keeps k per query, so what is shuffled is k rows per query and task.
    """
    rows, queries = (f.where("id is not null and v is not null").select("id", "v") for f in (rows, queries))
    queries = materialise(queries)
    spark, schema = rows.sparkSession, "id long, neighbour long, distance double"
    made = spark.createDataFrame([], schema)
    blocks = -(-queries.count() // QUERY_BLOCK)
    for c in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == c).toArrow()
        if not part.num_rows:
            continue
        ids, v = part.column("id").to_numpy(), part.column("v").combine_chunks()
        shared = spark.sparkContext.broadcast((ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = shared.value
            kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                if not b.num_rows:
                    continue
                own, x = b.column("id").to_numpy(), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                found = [nearest_in_block(ids, q, np.arange(lo, min(len(ids), lo + ROWS_AT_ONCE)), np.arange(len(own)), own, x, k) for lo in range(0, len(ids), ROWS_AT_ONCE)]
                a, o, d = (np.concatenate(parts) for parts in zip(kept, *found, strict=True))
                by = np.lexsort((o, d, a))
                by = by[first_of_each(a[by], k)]
                kept = a[by], o[by], d[by]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["id", "neighbour", "distance"])

        made = made.union(rows.mapInArrow(run, schema))
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return made.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
