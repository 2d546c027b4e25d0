"""Canonical forms: hand cases, the Unicode normaliser as reference, pairs against brute force."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartoweave.llm import canonical as K


def form(*texts):
    return K.canonical_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｈｅｌｌｏ", "Hello"), ("café", "café"), ("ofﬁce", "office"), ("a b", "a b"), ("a b c", "a b c"), ("ра​у", "pay"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("s­oft", "soft"),
        ("q̣̇", "q̣̇"), ("한", "한"), ("０１２", "012"), ("Å", "Å"), ("Ї", "Ï"), ("\U0001d400", "A"), ("a️", "a"),
    ],
)
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("O", "0"), ("l", "1"), ("a", "A"), ("e", "é"), ("a b", "ab"), ("a  b", "a b"), ("x²", "x2"), ("н", "H"), ("resume", "résumé")])
def test_other_look(a, b):
    assert form(a) != form(b)


def test_null_empty_invisible_long_and_slices():
    assert form(None, "", "​", "x") == [None, "", "", "x"]
    assert K.canonical_array(pa.array([], pa.string())).to_pylist() == []
    long = "Ｌｏｎｇ é " * 100_000
    assert form(long)[0] == unicodedata.normalize("NFC", unicodedata.normalize("NFKC", long))
    sliced = pa.array(["a", None, "ｂ", "ｃ"])[1:3]
    assert K.canonical_array(sliced).to_pylist() == [None, "b"]
    assert K.canonical_array(pa.chunked_array([["ａ"], ["b"]])).to_pylist() == ["a", "b"]
    bad = pa.StringArray.from_buffers(1, pa.py_buffer(b"\0\0\0\0\2\0\0\0"), pa.py_buffer(b"a\xff"))
    assert K.canonical_array(bad).to_pylist() == ["a�"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aéAñ ̧̣́̈ü한한зй")), max_size=6))
def test_is_the_canonical_composition(texts):
    out = form(*texts)
    assert out == [unicodedata.normalize("NFC", x) for x in out]
    assert form(*out) == out
    plain = [unicodedata.normalize("NFD", t) for t in texts]
    assert form(*plain) == out


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    forms = ["tea", "ｔea", "te​a", "teа", "Tea", "tea ", "tea "]
    rows = [(i, rng.choice(forms), "k") for i in range(60)]
    rows += rows[:10] + [(None, "tea", "k"), (99, None, "k"), (98, "", "k"), (97, "​", "k")]
    df = spark.createDataFrame(rows, "id_a long, text string, k1 string")
    got = [tuple(r) for r in K.same_look_pairs(df, "id_a", "text").collect()]
    of = {i: t for i, t, _ in rows if i is not None and t is not None}
    want = {(a, b) for a in of for b in of if a < b and of[a] != of[b] and form(of[a]) == form(of[b])}
    assert len(got) == len(set(got)) and set(got) == want
    assert K.same_look_pairs(df.where("false"), "id_a", "text").count() == 0


def test_column(spark):
    df = spark.createDataFrame([("ａ",), (None,)], "s string")
    assert [r[0] for r in df.select(K.canonical("s")).collect()] == ["a", None]


def test_classes_hold_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "FORM_ROWS", 3)
    forms = ["cafe\u0301", "caf\u00e9", "\uff43af\u00e9", "caf\u00e9\u200b"]
    rows = [(i, forms[i % 4]) for i in range(24)] + [(100, "tea"), (101, "tea"), (102, "t\u0435a"), (103, None), (None, "tea"), (102, "t\u0435a")]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = {tuple(r) for r in K.same_look_pairs(df, "id", "text").collect()}
    classes = [tuple(r) for r in K.same_look_classes(df, "id", "text").collect()]
    assert len(classes) == len(set(classes)) == 27
    assert pairs == {(a, b) for a, f, s in classes for b, g, t in classes if a < b and f == g and s != t}
    assert {(i, f, s) for i, f, s in classes if i >= 100} == {(100, 100, 100), (101, 100, 100), (102, 100, 102)}
    assert K.same_look_classes(df.where("false"), "id", "text").count() == 0


def test_public_lookalikes_keep_case_and_leave_digits(spark):
    pairs = dict(K.public_lookalikes(spark))
    assert len(pairs) > 150 and all(chr(a).isalpha() and not chr(a).isascii() and chr(b).isascii() and chr(a).isupper() == chr(b).isupper() for a, b in pairs.items())
    assert pairs[0x430] == ord("a") and pairs[0x410] == ord("A") and pairs[0x406] == ord("I")
    fixed = {ord(a) for foreign, _ in K.LOOKALIKES for a in foreign}
    assert {a for a in fixed if 0x400 <= a <= 0x42F} <= set(pairs) | {0x406, 0x49C, 0x490, 0x50C}
    texts = pa.array(["\u0421\u0430t 10", "\u2c9f\u2c9f", None, ""])
    assert K.canonical_array(texts, K.public_lookalikes(spark)).to_pylist() == ["Cat 10", "oo", None, ""]
