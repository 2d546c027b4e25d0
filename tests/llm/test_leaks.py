"""Leaks: planted passages, edits, near misses, odd input."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from cartoweave.llm import leaks as K

VOCABULARY = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je") for b in ("lan", "mor", "nit", "pes", "rud", "sat", "tov")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(1)
    items = [(i, "Answer the question: " + " ".join(words(rng, 50))) for i in range(20)]
    docs, want = [], set()
    for d in range(300):
        body = words(rng, rng.randrange(40, 200))
        kind = d % 4
        if kind < 3:
            i = rng.randrange(20)
            item = items[i][1].split(": ")[1].split()
            share = (1.0, 0.6, 0.25)[kind]
            at = rng.randrange(0, int(50 * (1 - share)) + 1)
            part = item[at : at + int(50 * share)]
            if kind == 0:
                part = [w if rng.random() > 0.05 else w[::-1] for w in part]
                part = [w.upper() if k % 7 == 0 else w + "," if k % 5 == 0 else w for k, w in enumerate(part)]
            cut = rng.randrange(len(body))
            body = body[:cut] + part + body[cut:]
            if kind < 2:
                want.add((d, i))
        docs.append((d, " ".join(body), 1.0))
    docs += docs[:20] + [(1000, None, 0.0), (1001, "", 0.0), (None, "x y z", 0.0), (1002, "Answer the question:", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, covered double")
    it = spark.createDataFrame([*items, (50, None), (51, "Only this:"), (None, "no id here")], "item_id long, text string")
    rows = K.leaked(df, "doc_id", "text", it, "item_id", "text").collect()
    got = {(r["id"], r["item"]) for r in rows}
    assert len(rows) == len(got) and got == want
    assert K.leaked(df.where("false"), "doc_id", "text", it, "item_id", "text").count() == 0
    assert K.leaked(df, "doc_id", "text", it.where("false"), "item_id", "text").count() == 0
    assert K.leaked(df, "doc_id", "text", it.where("item_id = 51"), "item_id", "text").count() == 0


def test_items_in_pieces_that_lie_apart(spark):
    d = "/root/testdata/sf0.01"
    it = spark.read.parquet(f"{d}/eval_items.parquet").where("text is not null").select("item_id", "text").orderBy("item_id")
    long = [r[0].split() for r in spark.read.parquet(f"{d}/documents.parquet").where("size(split(text, '\\\\s+')) between 200 and 2000").orderBy("doc_id").limit(240).select("text").collect()]
    docs, want = [], set()
    for no, (i, text) in enumerate(it.collect()):
        item = text.split(":", 1)[-1].split()
        pieces, body = 2 + no % 3, list(long[no % len(long)])
        size = -(-len(item) * 11 // 20 // pieces)
        if size < 7:
            continue
        for k in reversed(range(pieces)):
            cut = (k + 1) * len(body) // (pieces + 1)
            body[cut:cut] = item[k * len(item) // pieces :][:size]
        docs.append((no, " ".join(body)))
        want.add((no, i))
    assert len(want) > 100
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["id"], r["item"]) for r in K.leaked(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert len(want - found) <= len(want) // 50, (len(want - found), len(want))


def test_long_document(spark):
    rng = random.Random(2)
    item = words(rng, 40)
    long = words(rng, 60_000)
    df = spark.createDataFrame([(1, " ".join(long[:30_000] + item + long[30_000:])), (2, " ".join(long))], "doc_id long, text string")
    it = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert [(r["id"], r["item"]) for r in K.leaked(df, "doc_id", "text", it, "item_id", "text").collect()] == [(1, 9)]


def test_alignment_counts_runs_in_order():
    a = np.arange(10)
    assert K.aligned_words(a, np.r_[[50, 51], a, [60]]) == 10
    assert K.aligned_words(a, np.r_[a[5:], a[:5]]) == 5
    assert K.aligned_words(a, np.r_[a[:4], [99], a[5:]]) == 9
    assert K.aligned_words(a, np.r_[a[:2], [99], a[3:5], [98]]) == 0


def test_item_instruction():
    assert K.item_passages(["Do: this: that", "plain", None]).to_pylist() == [" this: that", "plain", None]
    assert isinstance(K.item_passages([]), pa.Array)


def edited(spark, every, share=1.0):
    """Documents that hold an item of which every so manieth word is another one, and those that only use its words."""
    rng = random.Random(every)
    d = "/root/testdata/sf0.01"
    it = spark.read.parquet(f"{d}/eval_items.parquet").where("text is not null").select("item_id", "text").orderBy("item_id")
    long = [r[0].split() for r in spark.read.parquet(f"{d}/documents.parquet").where("size(split(text, '\\\\s+')) between 60 and 300").orderBy("doc_id").limit(240).select("text").collect()]
    docs, want = [], set()
    for no, (i, text) in enumerate(it.collect()):
        item = text.split(":", 1)[-1].split()
        part = [w if k % every else "".join(rng.sample("abcdefghijkmnop", 7)) for k, w in enumerate(item[: int(len(item) * share)])]
        body = list(long[no % len(long)])
        cut = rng.randrange(len(body))
        docs.append((no, " ".join(body[:cut] + part + body[cut:])))
        want.add((no, i))
        docs.append((1000 + no, " ".join(rng.sample(body, len(body)) + rng.sample(item, len(item)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return want, {(r["id"], r["item"]) for r in K.leaked(df, "doc_id", "text", it, "item_id", "text").collect()}


def test_every_third_word_edited(spark):
    want, found = edited(spark, 3)
    assert len(want - found) <= len(want) // 50, (len(want - found), len(want))
    assert not {x for x in found - want if x[0] >= 1000}


def test_every_second_word_edited(spark):
    """Half of the words are left, less the one that is lost where an item has an odd number of them."""
    want, found = edited(spark, 2)
    it = {r["item_id"]: len(r["text"].split(":", 1)[-1].split()) for r in spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").collect()}
    want = {(d, i) for d, i in want if it[i] % 2 == 0}
    assert len(want) > 50 and len(want - found) <= len(want) // 20, (len(want - found), len(want))
    assert not {x for x in found if x[0] >= 1000}


def test_less_than_a_third_is_no_case(spark):
    want, found = edited(spark, 1000, 0.3)
    assert not want & found and not {x for x in found if x[0] >= 1000}


def test_subsequence_equals_the_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        i, j = K.lcs_pairs(a, b)
        assert len(i) == t[-1, -1] and (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_cell_index_finds_most_near_pairs():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 32))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    own, x = unit(centres), unit(centres[rng.integers(0, 300, 2000)] + 0.6 * rng.normal(size=(2000, 32)))
    i, j = K.cell_index(own).pairs(x, 0.5)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ own.T >= 0.5)), strict=True))
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_a_document_of_many_slabs(spark, monkeypatch):
    monkeypatch.setattr(K, "PASSAGES_AT_ONCE", 64)
    monkeypatch.setattr(K, "ITEM_CHARS_AT_ONCE", 400)
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, 30))) for i in range(12)]
    docs = [(d, " ".join(words(rng, 900) + items[d][1].split() + words(rng, 900))) for d in range(12)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["id"], r["item"]) for r in K.leaked(df, "doc_id", "text", it, "item_id", "text").collect()} == {(d, d) for d in range(12)}
