"""Numerical operators by invariants, files by round trips, streams against their batch twins."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoweave.ml import people, rbm, tsne
from cartoweave.sources import corpora, readers, writers
from cartoweave.sources.store import BucketStore
from cartoweave.streaming import hose


def test_autoencoder_learns_and_is_seeded():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (200, 2)).astype(float)
    x = np.clip(np.c_[bits, bits[:, :1], 1 - bits[:, 1:]] * 0.9 + 0.05, 0, 1)
    half = rbm.pretrain(x, [8, 3], epochs=5)
    again = rbm.pretrain(x, [8, 3], epochs=5)
    assert all(np.array_equal(a, b) for p, q in zip(half, again, strict=True) for a, b in zip(p, q, strict=True))
    net = rbm.unrolled(half)
    cost = lambda n: ((rbm.forward(x, n)[-1] - x) ** 2).sum(1).mean()
    assert cost(rbm.fine_tune(x, net, x, epochs=30, rate=0.5)) < cost(net)


@pytest.mark.parametrize("visible", ["bernoulli", "poisson", "softmax"])
def test_machines_take_steps(visible):
    rng = np.random.default_rng(2)
    v = rng.poisson(2, (40, 6)).astype(float) if visible == "poisson" else rng.integers(0, 2, (40, 6)).astype(float)
    m = rbm.RBM.new(6, 4, visible)
    cost, chain = m.step(v, 0.05, 2)
    assert np.isfinite(cost) and chain.shape == v.shape and np.isfinite(m.free_energy(v)).all()


def test_encode_null_and_weights(spark):
    layers = [(np.ones((2, 3)), np.zeros(3))]
    df = spark.createDataFrame([(1, [0.0, 0.0], "c"), (2, None, "c")], "id long, v array<double>, code string")
    got = {r["id"]: r["code"] for r in rbm.encode(df, "id", "v", layers).collect()}
    assert got == {1: [0.5] * 3, 2: None}
    back = rbm.layers_of(rbm.weight_rows(spark, layers), 1)
    assert np.array_equal(back[0][0], layers[0][0])
    with pytest.raises(ValueError):
        rbm.layers_of(rbm.weight_rows(spark, layers), 2)


def test_tsne_separates_groups():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.1, (20, 5)), rng.normal(5, 0.1, (20, 5))]
    y = tsne.annealed(x, 5.0, 200)
    gap = np.linalg.norm(y[:20].mean(0) - y[20:].mean(0))
    assert gap > 2 * max(y[:20].std(), y[20:].std()) or gap > 1
    p = tsne.similarities(tsne.squared_distances(x), 5.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)), 5.0, rtol=1e-2)
    near = tsne.place(x[:2], x, y)
    assert (np.linalg.norm(near - y[:20].mean(0), axis=1) < np.linalg.norm(near - y[20:].mean(0), axis=1)).all()
    with pytest.raises(ValueError):
        tsne.fit(np.zeros((tsne.LIMIT + 1, 2)))


def test_nearest_codes_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4)).round(1)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in people.nearest_codes(df, df.where("id % 10 = 0"), 3).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    for i in range(0, 120, 10):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = sorted((d[j], j) for j in range(120) if j != i)[:3]
        assert [n for _, n in sorted(got[i])] == [j for _, j in best]
    assert people.nearest_codes(df.where("false"), df).count() == 0


def test_csv_round_trip_with_quotes(spark, tmp_path):
    rows = [("o'neil", "a,b", 1), ("plain", "x", 2)]
    writers.quoted_csv(spark.createDataFrame(rows, "u string, t string, n long"), str(tmp_path / "c"))
    assert sorted(map(tuple, readers.quoted_csv(spark, str(tmp_path / "c"), "u string, t string, n long").collect())) == sorted(rows)
    (tmp_path / "w.csv").write_text("'a','b',1\n'only','two'\n'c','d',2\n")
    assert readers.quoted_csv(spark, str(tmp_path / "w.csv"), "u string, t string, n long").count() == 2


def test_header_csv_json_and_topics(spark, tmp_path):
    (tmp_path / "h.csv").write_text("word,word_id\ntea,1\nrum,x\n")
    assert [tuple(r) for r in readers.header_csv(spark, str(tmp_path / "h.csv"), "word_id long, word string, gone string").collect()] == [(1, "tea", None), (None, "rum", None)]
    (tmp_path / "drink-the-hose-1").write_text('{"text":"a","screen_name":"b"}\nbroken\n')
    (tmp_path / "other").write_text('{"text":"c"}\n')
    assert readers.json_lines(spark, str(tmp_path), pattern="drink-the-hose*").count() == 1
    (tmp_path / "rcv").write_text(".I 7\n.W\nalpha beta\ngamma\n\n.I 8\n.W\ndelta\n\n")
    assert [tuple(r) for r in readers.topic_documents(spark, str(tmp_path / "rcv")).orderBy("doc_id").collect()] == [(7, ["alpha", "beta", "gamma"]), (8, ["delta"])]


def test_article_and_reference_filters(spark):
    text = ["skip", "***** Contents *****", "1 list", "***** Head *****", "[link]", "kept", "* bullet", "***** Next *****", "also kept", "See also *****", "lost"]
    df = spark.createDataFrame([(1, i, s, False) for i, s in enumerate(text)], "doc long, line_no int, line string, talk boolean")
    got = [r["line"] for r in corpora.article_lines(df).orderBy("line_no").collect()]
    assert got == ["kept", "also kept"]
    refs = ["a", "1. ref", "x", "y", "b", "2. ref", "3. ref", "p", "q", "r", "s", "c", "[search              ]", "d"]
    wait, out = 0, []
    for s in refs:
        if s.startswith("[search              ]"):
            break
        wait += 3 if s[:1].isdigit() else 0
        if wait == 0:
            out.append(s)
        else:
            wait -= 1
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(refs)], "doc long, line_no int, line string")
    assert [r["line"] for r in corpora.without_references(df).orderBy("line_no").collect()] == out


def test_windows_stream_as_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = hose.windowed_counts(stream, "ts", ["kind"], "30 minutes", late="1 day")
    run = made.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = hose.windowed_counts(rows, "ts", ["kind"], "30 minutes")
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, batch.collect()))


def test_split_sink_and_scores(spark, tmp_path):
    from cartoweave.operators import trigram_model as M

    lines = spark.createDataFrame([("a", "the cat sat"), ("b", "zzz qqq"), ("c", "")], "screen_name string, text string")
    model = M.trigram_counts(lines.limit(1), "text")
    lines.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).json(str(tmp_path / "in"))
    sink = hose.split_sink(model, None, 1.0, str(tmp_path / "good"), str(tmp_path / "bad"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r["screen_name"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    table, default = M.evidence(model)
    streamed = {r["screen_name"]: r["score"] for r in hose.scored_stream(lines, table, default).collect()}
    batch = {r["screen_name"]: r["score"] for r in M.scored(lines, ["screen_name"], "text", model).collect()}
    assert streamed.keys() == batch.keys() and all(abs(streamed[k] - batch[k]) < 1e-9 for k in batch)


def test_upsert_sink(spark, tmp_path):
    sink = hose.upsert_sink(f"file://{tmp_path}/t", "k", "t", rows_per_bucket=1)
    schema = "k string, t int, v string"
    sink(spark.createDataFrame([("a", 1, "old"), ("b", 1, "b"), *((f"x{i}", 1, "x") for i in range(20))], schema), 0)
    second = spark.createDataFrame([("a", 2, "new"), ("b", 0, "late")], schema)
    sink(second, 1)
    sink(second, 1)
    store = BucketStore(spark, f"file://{tmp_path}/t", ("k",))
    assert store.version() == 2
    assert sorted(map(tuple, store.table().where("k in ('a', 'b')").collect())) == [("a", 2, "new"), ("b", 1, "b")] and store.table().count() == 22
    assert len(list((tmp_path / "t/data/2").glob("bucket=*"))) <= 2 < len(list((tmp_path / "t/data/1").glob("bucket=*")))


def test_fits_take_all_rows_up_to_the_limits(spark, monkeypatch):
    from cartoweave.ml import rbm, tsne
    from cartoweave.plans import queue_queries as queries

    d, seen = "/root/testdata/sf0.01", []

    def noted(f):
        return lambda x, *a, **k: seen.append((f.__name__, len(x), a[1:], k)) or f(x, *a, **k)

    for module, name in ((tsne, "annealed"), (rbm, "pretrain")):
        monkeypatch.setattr(module, name, noted(getattr(module, name)))
    monkeypatch.setattr(tsne, "fit", lambda x, perplexity=30.0, iterations=300, **k: (np.zeros((len(x), 2)), len(x) + iterations / 1000))
    codes = spark.read.parquet(f"{d}/test_codes.parquet").toPandas()[[f"c{i}" for i in range(16)]].dropna()
    swept = {(r["perplexity"], r["divergence"]) for r in queries.m15_perplexities(spark, d).collect()}
    assert swept == {(p, len(codes) + 0.1) for p in range(2, 20)}
    queries.m11_coordinates(spark, d)
    queries.m05_semantic_codes(spark, d)
    assert seen == [("annealed", len(codes), (), {}), ("pretrain", spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").count(), (), {})]


def test_positioned_people_and_their_mixture(spark):
    """The likelihood grows up to the true number of components and hardly beyond it."""
    from cartoweave.ml import people as P
    from cartoweave.session import materialise
    from cartoweave.sources.synthetic import positioned_people

    rows = materialise(positioned_people(spark, 1500))
    assert sorted(map(str, rows.limit(5).collect())) == sorted(map(str, positioned_people(spark, 1500).limit(5).collect()))
    assert rows.where("size(histo) <> 6 or exists(histo, h -> h < 0 or h > 1)").count() == 0 and rows.select("component").distinct().count() == 5
    likelihood = {k: max(P.fit_mixture(rows, k, seed=s).summary.logLikelihood for s in (1, 2)) for k in (2, 3, 5, 7)}
    assert likelihood[2] < likelihood[3] < likelihood[5] and likelihood[7] - likelihood[5] < 0.25 * (likelihood[5] - likelihood[3])


def test_word_labels_find_where_words_are_used(spark):
    rng = np.random.default_rng(8)
    groups = {0: ((0, 0), (9, 1)), 1: ((-7, 5), (4, -6))}
    rows = [(float(x), float(y), [1.0 if w == i else 0.0 for i in range(3)]) for w, places in groups.items() for c in places for x, y in rng.normal(c, 0.3, (80, 2))]
    df = spark.createDataFrame([*rows, (None, 1.0, [1.0, 1.0, 0.0]), (float("nan"), 1.0, [1.0, 1.0, 0.0])], "x double, y double, histo array<double>")
    got = {}
    for r in people.word_labels(df, ["tea", "rum", "never"]).collect():
        got.setdefault(r["word"], []).append((r["x"], r["y"]))
    assert set(got) == {"tea", "rum"}
    for w, name in ((0, "tea"), (1, "rum")):
        for c in groups[w]:
            assert min(math.dist(c, p) for p in got[name]) < 0.3
    assert people.word_labels(df.where("false"), ["tea"]).count() == 0


def test_npy_rows(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:0])
    (tmp_path / "c.npy").write_bytes(b"no matrix")
    got = readers.npy_rows(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["row"], r["values"]) for r in got] == [(i, x[i].tolist()) for i in range(4)] and got[0]["file"].endswith("a.npy")


def test_principal_axes_keep_the_distances(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5)) * [9, 5, 1e-9, 3, 1e-9]
    df = spark.createDataFrame([(i, r.tolist(), "x") for i, r in enumerate(x)], "k long, v array<double>, id string")
    got = np.array([r["v"] for r in tsne.principal(df, "k", "v", 3).orderBy("id").collect()])
    assert got.shape == (60, 3) and np.allclose(tsne.squared_distances(got), tsne.squared_distances(x), atol=1e-6)
    assert (np.diff(got.var(0)) < 0).all() and tsne.principal(df.where("false"), "k", "v", 3).count() == 0
