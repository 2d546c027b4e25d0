"""Clusters: chains against brute force, a mixture that finds its components, odd tables."""

from __future__ import annotations

import numpy as np

from cartoweave.llm import clusters as K
from cartoweave.llm.mixture import fit_mixture, log_sum, score_mixture


def chains(points, step, least):
    ids = sorted(points)
    xy = np.array([points[i] for i in ids])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= step * step
    group = np.arange(len(ids))
    while True:
        lower = np.where(near, group[None], len(ids)).min(1)
        if (lower == group).all():
            break
        group = lower
    out = {}
    for i, g in zip(ids, group, strict=True):
        out.setdefault(g, []).append(i)
    return [x for x in out.values() if len(x) >= least]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, y, 3) for i, x, y in rows], "id long, x double, y double, size int")
    return K.clusters(K.map_points(df, "id", "x", "y", -104.0, 56.0), **({"step": 0.15, "least": 5} | options))


def test_chains_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform(-3, 3, (900, 2)), rng.normal(20, 0.02, (300, 2)), [[10 + 0.149 * k, -7.0] for k in range(40)]])]
    rows += rows[:50] + [(5000, None, 1.0), (5001, float("nan"), 1.0), (5002, -999.0, -999.0), (None, 0.0, 0.0), (5003, 56.0, 0.0)]
    got = K.materialise(run(spark, rows))
    want = chains({i: (x, y) for i, x, y in rows if i is not None and i < 5000}, 0.15, 5)
    by = {}
    for r in got.collect():
        by.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))
    pairs = sorted(map(tuple, K.followers(got, 8).collect()))
    assert pairs == sorted(p for c in want for p in zip(sorted(c)[:-1], sorted(c)[1:], strict=True))
    told = {r["cluster"]: r for r in K.describe(K.with_density(got, got)).collect()}
    assert {c: r["size"] for c, r in told.items()} == {c: len(x) for c, x in by.items()}
    assert all(set(r["typical"]) <= set(by[c]) and len(r["typical"]) == 3 for c, r in told.items())


def test_borderline_boxes_are_decided_on_the_points(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 0.004, (60, 2))
    b = a + [0.147, 0.0]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[a, b])]
    for shift in (0.0, 0.0011, 0.0053):
        moved = [(i, x + (shift if i >= 60 else 0), y) for i, x, y in rows]
        want = chains({i: (x, y) for i, x, y in moved}, 0.15, 5)
        assert sorted(r["size"] for r in run(spark, moved).select("cluster", "size").distinct().collect()) == sorted(map(len, want))


def test_small_tables(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, 0.0, 0.0)]).count() == 0
    same = run(spark, [(i, 1.0, 1.0) for i in range(6)]).collect()
    assert {(r["cluster"], r["size"]) for r in same} == {(0, 6)} and K.followers(run(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 700), (700, 500), (900, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in K.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 700: 500}
    assert K.connected_components(links.where("false")).count() == 0


def test_mixture_finds_three(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (300, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    model = fit_mixture(df, ["x", "y"], candidates=(1, 2, 3, 5, 8), rounds=30)
    assert len(model.weights) in (3, 5)
    top = model.means[np.argsort(-model.weights)[:3]]
    scored = score_mixture(df, ["x", "y"], model).toPandas()
    assert np.isfinite(scored["log_density"]).all() and len(top) == 3
    assert len({tuple(sorted(set(scored["component"][i : i + 300]))) for i in (0, 300, 600)}) == 3


def test_one_gaussian_is_one_component(spark):
    x = np.random.default_rng(4).normal(size=(3000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    assert len(fit_mixture(df, ["x", "y"]).weights) == 1


def test_the_criterion_is_of_the_parameters_it_comes_with(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (200, 2)) for c in ((0, 0), (6, 1), (2, 7), (9, 9))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    model = fit_mixture(df, ["x", "y"])
    k = len(model.weights)
    likelihood = log_sum(model.log_parts(model.features(x))).sum()
    assert abs(model.bic - (-2 * likelihood + (k - 1 + 2 * k + 3 * k) * np.log(len(x)))) < 1e-6 * abs(model.bic) and 4 <= k <= 8
    told = K.describe(K.mixture_clusters(df)).collect()
    assert sum(r["size"] for r in told) == len(x) and all(len(r["typical"]) == min(3, r["size"]) for r in told)


def test_two_dense_cells_about_one_step_apart(spark):
    """Thousands of points in two sub-cells whose boxes leave it open: decided by division, not by all pairs."""
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 0.006, (4000, 2))
    for gap, groups in ((0.1501, 2), (0.1445, 1)):
        b = rng.uniform(0, 0.006, (4000, 2)) + [0.006 + gap, 0.0]
        b[:, 0] = np.maximum(b[:, 0], a[:, 0].max() + gap)
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[a, b])]
        assert run(spark, rows).select("cluster").distinct().count() == groups
