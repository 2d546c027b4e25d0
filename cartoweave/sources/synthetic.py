"""Synthetic texts for fixtures (S24, W11): words drawn by topic through the inverse of a cumulative distribution."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inverse_cdf(u: Column, weights: list[float]) -> Column:
    """The first position whose cumulative share is not below ``u`` (in [0, 1)); weights are normalised."""
    total = sum(weights)
    bounds = [c / total for c in accumulate(weights)][:-1]
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < u))


def topic_counts(spark: SparkSession, users: int, words: int, topics: int = 4, samples: int = 500, seed: int = 1) -> DataFrame:
    """(user, topic, word, count): every user has one topic and draws ``samples`` words of it; the same for each seed."""
    shares = np.random.default_rng(seed).uniform(size=(topics, words))
    draws = spark.range(users * samples, numPartitions=8).select(F.expr(f"id div {samples}").alias("user"), "id")
    fraction = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 52)) / float(1 << 52)
    topic = F.pmod(F.xxhash64(F.lit(seed), "user"), F.lit(topics)).cast("int")
    drawn = draws.withColumn("topic", topic).withColumn("u", fraction("draw"))
    word = F.lit(None).cast("int")
    for t in range(topics):
        word = F.when(F.col("topic") == t, inverse_cdf(F.col("u"), shares[t].tolist())).otherwise(word)
    return drawn.select("user", "topic", word.alias("word")).groupBy("user", "topic", "word").agg(F.count("*").alias("count"))


def positioned_people(spark: SparkSession, people: int, components: int = 5, words: int = 6, seed: int = 1) -> DataFrame:
    """(id, component, x, y, histo): people of a mixture of Gaussians on the plane, the same for each seed.

    Every component has a histogram of words; a person's histogram is their mean, weighted by how responsible each component
    is for the place, so that it changes smoothly over the plane.
    """
    rng = np.random.default_rng(seed)
    weights = 0.2 + 0.8 * rng.uniform(size=components)
    weights /= weights.sum()
    centres, histograms = 5.0 * rng.normal(size=(components, 2)), rng.uniform(size=(components, words)) ** 2
    roots = rng.normal(size=(components, 2, 2)) * 0.6 + 0.4 * np.eye(2)
    at = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("component")]
    fraction = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    radius, turn = F.sqrt(-2 * F.ln(fraction("radius"))), 2 * math.pi * fraction("turn")
    drawn = spark.range(people).withColumn("component", inverse_cdf(fraction("component"), weights.tolist())).withColumn("a", radius * F.cos(turn)).withColumn("b", radius * F.sin(turn))
    x, y = (at(centres[:, i]) + at(roots[:, i, 0]) * F.col("a") + at(roots[:, i, 1]) * F.col("b") for i in (0, 1))
    placed = drawn.select("id", "component", x.alias("x"), y.alias("y"))
    parts = []
    for k in range(components):
        inverse = np.linalg.inv(roots[k] @ roots[k].T)
        dx, dy = F.col("x") - float(centres[k, 0]), F.col("y") - float(centres[k, 1])
        distance = dx * dx * float(inverse[0, 0]) + 2 * dx * dy * float(inverse[0, 1]) + dy * dy * float(inverse[1, 1])
        parts.append(F.exp(-distance / 2) * float(weights[k] / abs(np.linalg.det(roots[k]))))
    share = placed.withColumn("r", F.array(*parts)).withColumn("whole", F.aggregate("r", F.lit(0.0), lambda s, v: s + v))
    histo = F.array(*[sum((F.col("r")[k] * float(histograms[k, w]) for k in range(components)), F.lit(0.0)) / F.col("whole") for w in range(words)])
    return share.select("id", "component", "x", "y", histo.alias("histo"))
