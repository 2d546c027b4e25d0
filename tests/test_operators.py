"""Operators against brute force and by properties."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoweave.config import Config, coerced, merged
from cartoweave.functions import quad as Q
from cartoweave.operators import counts as C
from cartoweave.operators import density as D
from cartoweave.operators import labels as L
from cartoweave.operators import peaks as K
from cartoweave.operators import requests as W
from cartoweave.operators import trigram_model as M
from cartoweave.operators.density_query import Query, density_query, parse
from cartoweave.operators.running import global_rank, running_sum


def test_quad_round_trip(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-104, 56), rng.uniform(-104, 56)) for _ in range(200)] + [(None, 0.0), (float("nan"), 0.0), (56.0, 0.0), (-999.0, -999.0)]
    df = spark.createDataFrame(pts, "x double, y double").withColumn("q", Q.quadkey("x", "y"))
    rows = df.withColumn("c", Q.quad_to_xy("q")).collect()
    assert [r["q"] is None for r in rows] == [False] * 200 + [True] * 4
    for r in rows[:200]:
        assert r["c"]["x"] == int((r["x"] + 104) * 204.8) and r["c"]["y"] == int(-(r["y"] + 104) * 204.8) % 2**15
    one = spark.range(1).select(Q.quad_to_xy(F.array(*[F.lit(i) for i in (0, 1, 0, 3, 3, 1, 1, 2, 3)])).alias("c")).first()["c"]
    assert tuple(one) == (189, 51)


def test_running_sum_and_rank(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(10)) for i, k in enumerate(["hot"] * 500 + ["b"] * 50 + [None] * 20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r["k"], r["i"]): r["s"] for r in running_sum(df, ["k"], [F.col("i")], F.col("v"), "s", 7).collect()}
    for key in ("hot", "b", None):
        total = 0
        for k, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total += v
            assert got[k, i] == total
    ranks = {r["i"]: r["rank"] for r in global_rank(df, [F.col("i")], parts=5).collect()}
    assert ranks == {i: i for i in range(570)}
    assert global_rank(df.where("false"), [F.col("i")]).count() == 0


def test_histogram_measures(spark):
    rows = [("a", 0, 5), ("a", 3, 5), ("b", 9, 1)]
    got = {r["token"]: r for r in C.histogram_measures(spark.createDataFrame(rows, "token string, bucket int, n long")).collect()}
    for token in "ab":
        h = np.zeros(10)
        for t, b, n in rows:
            if t == token:
                h[b] = n
        q = (h + 1e-8) / (h + 1e-8).sum()
        assert math.isclose(got[token]["entropy"], -(q * np.log(q)).sum(), rel_tol=1e-9) and math.isclose(got[token]["variance"], h.var(), rel_tol=1e-9)


def test_vocabulary_of_an_empty_relation(spark):
    empty = spark.createDataFrame([], "user long, token long, count long")
    assert C.cover(empty).count() == C.boundaries(C.with_probability(empty)).count() == C.TokenCounts(empty).training().count() == 0
    assert C.popular_cutoff(C.totals(empty, "token"), 0.1).count() == 0


def test_split_repeats_empty_parts(spark):
    df = spark.range(10).withColumnRenamed("id", "place")
    count = lambda a, b: {r["part"]: r["count"] for r in C.split_rows(df, "place", a, b).groupBy("part").count().collect()}
    assert count(6, 2) == {"train": 6, "validation": 2, "test": 2}
    assert count(10, 0) == {"train": 10, "validation": 10, "test": 10}


def test_scores_keep_texts_without_trigrams(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None), (4, "123 @x"), (1, "the cat")], "id long, text string")
    model = M.trigram_counts(docs, "text", "word_aware")
    got = {r["id"]: r["score"] for r in M.scored(docs.dropDuplicates(["id"]), ["id"], "text", model).collect()}
    assert got[2] == got[3] == got[4] == 0 and got[1] > 0
    table, default = M.evidence(model)
    n, total = 2, 12
    off = total / 256**3 * 0.5
    norm = -math.log2(total + 256**3 * off)
    noise = math.log2((total / 256**3 + off) * 1.0) + norm
    assert math.isclose(table.where("tg = hex('<th')").first()["evidence"], math.log2(n + off) + norm - noise)
    assert math.isclose(default, math.log2(off) + norm - noise)
    assert M.evidence(model.where("false"))[1] == 0.0


def brute_density(points, frame, k):
    side = D.kernel(k)
    tall, out = np.zeros((frame.height, frame.width)), np.zeros((frame.height, frame.width))
    for x, y, v in points:
        px, py = int((x - frame.min_x) * frame.x_scale), int((y - frame.min_y) * frame.y_scale)
        for d in range(1 - len(side), len(side)):
            if 0 <= py + d < frame.height and 0 <= px < frame.width:
                tall[py + d, px] += v * side[abs(d)]
    for y, x in zip(*np.nonzero(tall >= 0.001), strict=True):
        for d in range(1 - len(side), len(side)):
            if 0 <= x + d < frame.width:
                out[y, x + d] += tall[y, x] * side[abs(d)]
    return out


def test_density_and_its_language(spark):
    rng = random.Random(3)
    frame = D.Frame(0.0, 0.0, 2.0, 2.0, 30, 24)
    points = [(rng.choice(["Tea", "Rum"]), rng.uniform(0, 14.9), rng.uniform(0, 11.9), float(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(points, "token string, x double, y double, v double")
    whole = {t: brute_density([p[1:] for p in points if p[0] == t], frame, -0.2) for t in ("Tea", "Rum")}

    def grid(text):
        out = np.zeros((24, 30))
        for r in density_query(text, df, frame, -0.2).collect():
            out[r["gy"], r["gx"]] = r["v"]
        return out

    assert np.allclose(grid("tea"), whole["Tea"])
    assert np.allclose(grid("tea rum"), whole["Tea"] * whole["Rum"])
    assert np.allclose(grid("tea + rum"), whole["Tea"] + whole["Rum"])
    assert np.allclose(grid("tea - rum"), np.maximum(0, whole["Tea"] - whole["Rum"]))
    assert np.allclose(grid("tea ^ rum"), np.abs(whole["Tea"] - whole["Rum"]))
    assert np.allclose(grid('" tea'), whole["Tea"] ** 3) and np.allclose(grid("^ tea"), 1.01 ** whole["Tea"])
    assert np.allclose(grid("\\ tea"), np.maximum(0, whole["Tea"] - whole["Tea"][whole["Tea"] != 0].mean()))
    with pytest.raises(ValueError):
        density_query("gin", df, frame, -0.2)
    assert parse(">5 tea") == Query(("Tea",), top=5) and parse("a b c d") == Query(("A",))
    with pytest.raises(ValueError):
        parse("  ")


def test_kernel_ends_with_the_first_value_not_above():
    side = D.kernel(-0.1, 0.01)
    assert side[-1] <= 0.01 < side[-2] and side[0] == 1


def test_kde_against_numpy(spark):
    rng = np.random.default_rng(4)
    xy = rng.normal(size=(50, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in xy] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    got = {(r["gx"], r["gy"]): r["v"] for r in D.kde(df, 5).collect()}
    cov = np.cov(xy.T) * 50 ** (-1 / 3)
    gx, gy = (np.linspace(1.2 * c.min(), 1.2 * c.max(), 5) for c in xy.T)
    for i in range(5):
        for j in range(5):
            d = np.array([gx[i], gy[j]]) - xy
            v = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)).sum() / (50 * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
            assert math.isclose(got[i, j], v, rel_tol=1e-9)
    assert D.kde(df.limit(0)).count() == 0


def test_peaks_agree_on_separate_hills():
    grid = np.zeros((40, 60))
    for y, x, h in ((10, 12, 8.0), (28, 45, 5.0)):
        yy, xx = np.mgrid[:40, :60]
        grid += h * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 12)
    a, b = K.climb(grid), K.descend(grid)
    assert sorted(zip(a.x, a.y, strict=True)) == sorted(zip(b.x, b.y, strict=True)) == [(12.0, 10.0), (45.0, 28.0)]
    assert np.allclose(sorted(a["sum"]), sorted(b["sum"]), rtol=0.05)
    close = K.blend(K._scored(a.assign(x=[12.0, 15.0], y=[10.0, 10.0]), 10.0))
    assert len(close) == 1 and math.isclose(close["sum"].iloc[0], a["sum"].sum())
    assert len(K.climb(np.zeros((5, 5)))) == len(K.descend(np.zeros((5, 5)))) == 0


def test_view_rows_round_trip(spark):
    rows = spark.createDataFrame([('te"a', "0,1", 3), ("ü\\x", "2", 1)], "token string, cell string, value long")
    lines = L.view_line(rows, True)
    assert sorted(L.parsed_rows(lines, True).collect()) == sorted(rows.collect())
    odd = spark.createDataFrame([('{"key":["a",0,1],"value":2}',), ("{",), ("",), (None,)], "value string")
    assert L.parsed_rows(odd, True).collect() == [("a", "0,1", 2)]


def test_magic_keeps_the_last_group(spark):
    rows = spark.createDataFrame([("zebra", "0", 4), ("ant", "0", 4), ("@someone", "0", 50), ("verylongtoken", "0", 13)], "token string, cell string, value long")
    got = {r["token"]: r["value"] for r in L.magic_labels(rows).collect()}
    assert got == {"zebra": 8, "ant": 8, "@someone": 10, "verylongtoken": 26 * 8 // 13}


def test_request_states(spark):
    e = [("a", "requested", 1), ("a", "started", 2), ("b", "failed", 1), ("b", "failed", 2), ("b", "failed", 3), ("c", "started", 1), ("c", "failed", 2), ("d", "started", 1), ("d", "completed", 2), ("e", "requested", 1), (None, "failed", 1), ("f", "odd", 1)]
    df = spark.createDataFrame(e, "request_id string, event string, t int").select("request_id", "event", F.timestamp_seconds("t").alias("ts"))
    assert {r["request_id"]: (r["attempts"], r["state"]) for r in W.request_state(df).collect()} == {"a": (0, "underway"), "b": (3, "dead"), "c": (1, "queued"), "d": (0, "completed"), "e": (0, "queued")}


def test_config():
    tree = merged({"a": {"x": 2, "y": "$a.x * 3 + 1"}, "b": {"k": 1, "l": 2}}, {"a": {"x": 5}, "b": {"k": 9}}, frozenset({"b"}))
    assert Config(tree).get("a.y") == 16 and tree["b"] == {"k": 9}
    with pytest.raises(ValueError):
        Config({"a": "$b", "b": "$a"}).get("a")
    with pytest.raises(ValueError):
        Config({"a": "$b + __import__('os')", "b": 1}).get("a")


def test_hill_shade_against_numpy(spark):
    rng = np.random.default_rng(6)
    z = rng.uniform(0, 9, (7, 8)).round(2)
    df = spark.createDataFrame([(x, y, float(z[y, x])) for y in range(7) for x in range(8)], "gx int, gy int, v double")
    got = {(r["gx"], r["gy"]): r["v"] for r in D.hill_shade(df, 0.1, 2.0, 0.8).collect()}
    for y in range(1, 6):
        for x in range(1, 7):
            n = z[y - 1 : y + 2, x - 1 : x + 2]
            dx = ((n[:, 0] - n[:, 2]) * [1, 2, 1]).sum() * 0.1
            dy = ((n[2] - n[0]) * [1, 2, 1]).sum() * 0.1
            slope, aspect = math.pi / 2 - math.atan(math.hypot(dx, dy)), math.atan2(dx, dy)
            want = max(0.0, math.sin(0.8) * math.sin(slope) + math.cos(0.8) * math.cos(slope) * math.cos(2.0 - math.pi / 2 - aspect))
            assert math.isclose(got[x, y], want, abs_tol=1e-9)


def test_synthetic_counts_are_seeded(spark):
    from cartoweave.sources.synthetic import topic_counts

    a, b = (sorted(map(tuple, topic_counts(spark, 5, 6, 2, 40, seed).collect())) for seed in (1, 1))
    assert a == b and sum(r[3] for r in a) == 200


def test_coerced_parameters():
    known = {"zoom": 2, "scale": 1.5, "names": True, "title": "map"}
    got = coerced(known, {"zoom": "3", "scale": "x", "names": "No", "title": "", "other": "1"})
    assert got == {"zoom": 3, "scale": 1.5, "names": False, "title": ""} and known["zoom"] == 2
    assert coerced(known, {"zoom": "2.5", "names": "yes"}) == {"zoom": 2.5, "scale": 1.5, "names": True, "title": "map"}


def test_dense_rows(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 2, 1), ("a", 2, 4), ("b", 9, 1), ("b", -1, 1), (None, 0, 1)], "r string, c int, v int")
    assert [tuple(x) for x in C.dense_rows(df, "r", "c", "v", 3).collect()] == [("a", [2.0, 0.0, 5.0])]
    assert C.dense_rows(df.where("false"), "r", "c", "v", 3).count() == 0


def test_cell_frame(spark):
    labels = spark.createDataFrame([("0,1", "tea", 3), ("0,1", "rum", 3), ("0,1", "ale", 9)], "cell string, token string, value long")
    users = spark.createDataFrame([("0,1", 7), ("3,3", 2)], "cell string, value long")
    got = {r["cell"]: (r["x"], r["y"], r["users"], [tuple(t) for t in r["labels"] or []]) for r in L.cell_frame(labels, users).collect()}
    assert got == {"0,1": (1, 0, 7, [("ale", 9), ("tea", 3), ("rum", 3)]), "3,3": (3, 3, 2, [])}


def test_command_line(spark, tmp_path, capsys):
    from cartoweave.__main__ import main

    for name, text in (("good", "the cat sat on the mat"), ("bad", "zyx qwv zyx")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(text)
    lines = [{"id": 1, "screen_name": "Al", "text": "the cat on the mat"}, {"id": 2, "screen_name": "Bo", "text": "zyx zyx"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, lines)))
    common = ["hose", "-i", str(tmp_path / "lines.json"), "--corpus", str(tmp_path / "good"), "--anti-corpus", str(tmp_path / "bad")]
    assert main([*common, "-g", str(tmp_path / "out"), "-q", str(tmp_path / "queue")]) == 0
    assert [r["screen_name"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["Al"] and spark.read.parquet(str(tmp_path / "queue")).count() == 3
    assert main([*common, "-T", "-r"]) == 0 and main(["list"]) == 0
    (tmp_path / "rows.json").write_text('{"key":["tea",0,1,2],"value":3},\n{"key":["rum",0,1,3],"value":5}')
    assert main(["labels", str(tmp_path / "rows.json"), "--mode", "total", "--precision", "2"]) == 0
    assert "rum" in capsys.readouterr().out


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from cartoweave.session import checkpoint_dir

    def session(master, folder):
        conf = N(get=lambda name, default=None: default)
        made = []
        context = N(master=master, getConf=lambda: N(get=lambda name: folder), getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return N(sparkContext=context, conf=conf)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(session(master, None))
        assert checkpoint_dir(session(master, "/shared")) == "/shared"
    assert checkpoint_dir(session("local[4]", None)) and checkpoint_dir(session("local", None))


def test_ranges_follow_the_size(spark, monkeypatch):
    from cartoweave.operators import running

    df = spark.range(2000)
    assert running.in_ranges(df, F.col("id")).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(running, "RANGE_BYTES", 10)
    monkeypatch.setattr(running, "RANGE_ROWS", 100)
    assert running.in_ranges(df, F.col("id")).rdd.getNumPartitions() == 20
    ranks = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("id")]).collect()}
    assert ranks == {i: 1999 - i for i in range(2000)}


def test_requests_of_a_new_queue_come_out_in_order(spark):
    users = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "name string")
    late, soon = (W.download_requests(users, "name", p, at=F.lit(t).cast("timestamp")) for p, t in ((1, "2024-01-01"), (0, "2024-01-02")))
    first = W.dequeue(late.union(soon), 5).collect()
    assert len(first) == 5 and {r["priority"] for r in first} == {0}
    assert W.dequeue(W.download_requests(users, "name"), 100).count() == 6
    assert W.download_requests(users, "name").where("request_time is null").count() == 0
