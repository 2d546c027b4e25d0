"""Nearest vectors: recall against brute force, exact small tables, copies, notations."""

from __future__ import annotations

import numpy as np

from cartoweave.llm import neighbours as K


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in rows], "id long, v array<double>, distance string")


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df, size, **options):
    got = {}
    for r in sorted(K.nearest(df, size, **options).collect(), key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    return got


def test_recall_on_clustered_codes(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2, (250, 32))
    rows = [(i, np.clip(centres[i % 250] + rng.normal(0, 0.05, 32), 0, 1)) for i in range(2000)]
    got, want = found(frame(spark, rows), 32), brute(rows, 5)
    hit = sum(len({n for n, _ in got[i]} & {n for n, _ in want[i]}) for i in want)
    assert hit / (5 * len(rows)) > 0.97


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 3, rng.normal(size=4)) for i in range(15)]
    assert {i: [n for n, _ in x] for i, x in found(frame(spark, rows + rows[:4]), 4).items()} == {i: [n for n, _ in x] for i, x in brute(rows, 5).items()}
    assert found(frame(spark, []), 4) == {} and found(frame(spark, rows[:1]), 4) == {}
    assert len(found(frame(spark, rows[:3]), 4)[0]) == 2


def test_many_copies_have_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(100 + i, [5.0, float(i)]) for i in range(6)] + [(None, [0.0, 0.0]), (999, None)]
    got = found(frame(spark, rows), 2)
    assert [n for n, _ in got[40]] == [0, 1, 2, 3, 4] and [n for n, _ in got[2]] == [0, 1, 3, 4, 5]
    assert all(d == 0 for _, d in got[49]) and 999 not in got


def test_notations(spark):
    texts = ["[ 1.0 2e-1\n 3 ]", "array([1,0.2,3.], dtype=float32)", "1;0.2;3", "(1.0, .2, 3)", "[1 0.2 ... 3]", "[1 0.2 nan]", "[1 2]", "", None, "[1 inf 2]", "list([1, 0.2, 3])"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(K.vector_from_text("t", 3)).collect()]
    assert got == [[1.0, 0.2, 3.0]] * 4 + [None] * 6 + [[1.0, 0.2, 3.0]]


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = K.hilbert_index(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pairs(spark):
    rows = [(1, [0.0]), (2, [0.5]), (3, [9.0])]
    assert [tuple(r) for r in K.near_pairs(frame(spark, rows), 1, 1.0).collect()] == [(1, 2)]


def test_one_dense_group_of_distinct_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2, (100, 32))
    rows = [(i, centres[i % 100] + rng.normal(0, 0.05, 32)) for i in range(1000)] + [(1000 + i, centres[0] + rng.normal(0, 0.02, 32)) for i in range(800)]
    want = brute(rows, 5)
    got = found(frame(spark, rows), 32)
    group = range(1000, 1800)
    assert sum(len({n for n, _ in got[i]} & {n for n, _ in want[i]}) for i in group) == 5 * len(group)
    near = {(min(i, n), max(i, n)) for i, x in want.items() for n, d in x if d <= 0.3}
    assert {tuple(r) for r in K.near_pairs(frame(spark, rows), 32, 0.3).collect()} == near


def test_rows_without_a_fitting_window_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(K, "WINDOW_LEAST", 8)
    monkeypatch.setattr(K, "WINDOW_MOST", 7)
    monkeypatch.setattr(K, "CHUNK", 150)
    monkeypatch.setattr(K, "ROWS_AT_ONCE", 64)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1e-3 if i % 3 else 1.0, 24)) for i in range(600)]
    got, want = found(frame(spark, rows), 24), brute(rows, 5)
    assert {i: [n for n, _ in x] for i, x in got.items()} == {i: [n for n, _ in x] for i, x in want.items()}


def recall_of(spark, rows, size, every, **options):
    """Share of the true five nearest of the rows with id % every == 0, by brute force over all rows."""
    import pyarrow as pa

    x = np.array(rows)
    df = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": pa.FixedSizeListArray.from_arrays(x.ravel(), size).cast(pa.list_(pa.float64()))}))
    got = {}
    for i, n in K.nearest(df, size, **options).where(f"id % {every} = 0").select("id", "neighbour").collect():
        got.setdefault(i, set()).add(n)
    hit = 0
    for i in range(0, len(x), every):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(got[i] & set(np.argpartition(d, 5)[:5].tolist()))
    return hit / (5 * len(range(0, len(x), every)))


def test_recall_on_many_gaussian_vectors(spark):
    assert recall_of(spark, np.random.default_rng(5).normal(size=(120_000, 16)), 16, 500) >= 0.9


def test_recall_on_many_blobs(spark):
    rng = np.random.default_rng(6)
    centres = 5 * rng.normal(size=(40, 16))
    assert recall_of(spark, centres[rng.integers(0, 40, 120_000)] + rng.normal(0, 0.5, (120_000, 16)), 16, 500) >= 0.9


def test_recall_across_many_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(K, "WINDOW_LEAST", 64)
    monkeypatch.setattr(K, "ROWS_PER_PARTITION", 300)
    rng = np.random.default_rng(7)
    assert recall_of(spark, rng.normal(size=(4_000, 6)), 6, 4, recall=0.97) >= 0.95


def test_packing_loses_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = np.r_[np.round(rng.uniform(-1, 1, (5, 4)), 4), np.round(rng.uniform(-90, 90, (5, 4)), 6), rng.normal(size=(5, 4)), [[0.0, 1e300, -1e-300, 3.2767]]]
    packed = pa.array(K.pack(x), pa.binary())
    assert (K.unpack(packed, 4) == x).all() and (K.unpack(packed.slice(3, 9), 4) == x[3:12]).all()
    assert {len(b.as_py()) for b in packed} == {8, 16, 32}
