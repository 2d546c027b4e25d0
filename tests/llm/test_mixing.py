"""Mixtures: shares, repetition limits, determinism, odd tables."""

from __future__ import annotations

import math

import pytest

from cartoweave.llm import mixing as K


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for s, n in (("Web ", 1500), ("BOOKS", 300), ("code", 40)):
        rows += [(len(rows) + i, f"some words of document {i} in {s.strip()} " * (1 + i % 3), s) for i in range(n)]
    rows += [(90001, None, "web"), (90002, "", "web"), (90003, "orphan text", None), (90004, "other source", "blog"), (None, "no id", "web")] + rows[:25]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats long")


def test_target_shares(spark, docs):
    aims = targets(spark, ("web", 0.5, 1), ("books", 0.3, 3), ("code", 0.1, 8), ("absent", 0.1, 2), (None, 0.1, 1))
    mixed = K.materialise(K.mixture(docs, "doc_id", "text", "source", aims))
    told = {r["source"]: r for r in K.report(mixed, aims).collect()}
    assert math.isclose(sum(r["actual_share"] for r in told.values()), 1, abs_tol=1e-5)
    for s, want, most in (("web", 5 / 9, 1), ("books", 3 / 9, 3), ("code", 1 / 9, 8)):
        assert abs(told[s]["actual_share"] - want) < 0.005 and told[s]["most_repeats"] <= most
    assert told["absent"]["tokens"] == 0 and mixed.where("source not in ('web', 'books', 'code')").count() == 0
    again = K.mixture(docs.repartition(7), "doc_id", "text", "source", aims)
    assert sorted(map(tuple, again.select("id", "epoch").collect())) == sorted(map(tuple, mixed.select("id", "epoch").collect()))
    assert mixed.groupBy("id", "epoch").count().where("count > 1").count() == 0


def test_larger_total_tempers_the_weights(spark, docs):
    aims = targets(spark, ("web", 0.2, 2), ("code", 0.8, 2))
    mixed = K.mixture(docs, "doc_id", "text", "source", aims, total=10_000)
    told = {r["source"]: r for r in K.report(mixed, aims).collect()}
    assert told["code"]["most_repeats"] == 2 and abs(told["web"]["tokens"] + told["code"]["tokens"] - 10_000) < 60


def test_exponents():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    e = K.exponent_for_entropy(shares, 1.0)
    assert math.isclose(K.entropy(K.temperature_weights(shares, e)), 1.0, abs_tol=1e-6)
    assert K.temperature_weights(shares, 0)["a"] == pytest.approx(1 / 3)
    w, e = K.tempered_targets({"a": 0.5, "b": 0.5}, {"a": 900, "b": 100}, {"a": 1, "b": 1}, 200)
    assert e == 0 and w == {"a": 0.5, "b": 0.5}
    w, e = K.tempered_targets({"a": 0.5, "b": 0.5}, {"a": 900, "b": 100}, {"a": 1, "b": 1}, 500)
    assert 0 < e < 1 and w["b"] * 500 == pytest.approx(100)


def test_token_counts(spark):
    df = spark.createDataFrame([(0, "hello world"), (1, ""), (2, None), (3, "x" * 200_000), (4, "ab cd " * 40_000)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(K.token_count("t")).collect()]
    assert got[:3] == [2, 0, None] and got[3] > 1000 and got[4] > 80_000


def test_empty_tables(spark, docs):
    aims = targets(spark, ("web", 1.0, 1))
    assert K.mixture(docs.where("false"), "doc_id", "text", "source", aims).count() == 0
    assert K.mixture(docs, "doc_id", "text", "source", aims.where("false")).count() == 0


def test_every_pass_is_a_permutation_of_its_own(spark, docs, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 10)
    aims = targets(spark, ("web", 0.2, 1), ("code", 0.8, 40))
    mixed = K.mixture(docs, "doc_id", "text", "source", aims, seed=3).where("source = 'code'")
    orders, places = {}, []
    for r in mixed.orderBy("position").collect():
        orders.setdefault(r["epoch"], []).append(r["id"])
        places.append(r["position"])
    full = [tuple(x) for x in orders.values() if len(x) == 40]
    assert places == list(range(1, len(places) + 1)) and len(full) >= 3
    assert len(set(full)) == len(full) and len({tuple(sorted(x)) for x in full}) == 1


def test_stretched_mixture_bisects_the_exponent(spark, docs):
    aims = targets(spark, ("web", 0.2, 2), ("code", 0.8, 2))
    exact, wide = (K.report(K.materialise(K.mixture(docs, "doc_id", "text", "source", aims, stretch=x)), aims).collect() for x in (1.0, 3.0))
    share = lambda rows: {r["source"]: r["actual_share"] for r in rows}
    size = lambda rows: sum(r["tokens"] for r in rows)
    assert abs(share(exact)["web"] - 0.2) < 0.02 and share(wide)["web"] > 0.5
    assert abs(size(wide) / size(exact) - 3) < 0.05 and all(r["most_repeats"] <= 2 for r in wide)


def test_pieces_have_the_tokens_of_the_whole():
    import random

    import public_tokenizers

    encode = K._encoder(K.default_tokenizer(), public_tokenizers.PATTERN).encode_ordinary
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice(["a", "b ", "  ", "\n", "don't", "12", " 7", "?!", " ...", "\u00a0", "é", "日本", "\t x"]) for _ in range(6000))
        pieces = K._pieces(text)
        assert "".join(pieces) == text and len(pieces) > 1
        assert [t for p in pieces for t in encode(p)] == encode(text)
