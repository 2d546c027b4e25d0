"""Languages: held-out accuracy on generated texts, mixed texts, odd input."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from cartoweave.llm import language as K
from cartoweave.llm.words import words_of

WORDS = {"en": "the house and river with morning they walked quickly under bridge", "es": "la casa y el río con mañana ellos caminaron rápido bajo puente", "de": "das haus und der fluss mit morgen sie gingen schnell unter brücke", "ru": "дом и река утро они шли быстро под мост очень большой"}


def text(rng, lang, n=9):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(text(rng, lang), lang if rng.random() > 0.05 else "en") for lang in WORDS for _ in range(120)]
    return K.fit_languages(pa.array([t for t, _ in rows]), [x for _, x in rows], tuple(WORDS))


def test_held_out_and_mixed(spark, model):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(200):
        langs = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        rows.append((i, " - ".join(text(rng, x) for x in langs) + " @name #tag http://x.y &amp;", langs[0].upper() + "_XX", 1))
        want[i] = langs
    found = K.language_passages(spark.createDataFrame(rows, "id long, text string, lang string, seg_no int"), "id", "text", "lang", model).orderBy("id", "seg_no").collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append(r["lang"])
        assert 0 < r["confidence"] <= 1
    assert sum(got.get(i) == want[i] for i in want) >= 196
    wrong = K.missing_or_wrong(K.language_passages(spark.createDataFrame(rows, "id long, text string, lang string, seg_no int"), "id", "text", "lang", model))
    assert {r["id"] for r in wrong.collect()} >= {i for i, x in want.items() if len(x) > 1 and len(got[i]) > 1}


def test_no_language_in_odd_texts(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "@a #b http://c.d/e 12 :)", "en"), (4, "​", None), (5, "zzqqx", None), (6, "RT @someone", "en")]
    assert K.language_passages(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang", model).count() == 0
    assert K.language_passages(spark.createDataFrame([], "id long, text string, lang string"), "id", "text", "lang", model).count() == 0


def test_long_text_and_look_alikes(spark, model):
    rng = random.Random(3)
    long = text(rng, "en", 20_000)
    odd = text(rng, "en", 12).replace("a", "а").replace("o", "ｏ")
    got = K.language_passages(spark.createDataFrame([(1, long, None), (2, odd, None)], "id long, text string, lang string"), "id", "text", "lang", model).collect()
    assert [(r["id"], r["lang"]) for r in sorted(got)] == [(1, "en"), (2, "en")]


def test_fit_without_rows(spark):
    empty = spark.createDataFrame([], "id long, text string, lang string")
    model = K.fit_from(empty, "id", "text", "lang")
    some = spark.createDataFrame([(1, "hello there", "en")], "id long, text string, lang string")
    assert K.language_passages(some, "id", "text", "lang", model).count() == 0


def test_words_are_the_letters_runs():
    w = words_of(pa.array(["It's a <b>bold</b> plan, don't!", None, "", "<nick> hi"]))
    assert [(int(r), w.text(i)) for i, r in enumerate(w.row)] == [(0, "it's"), (0, "a"), (0, "plan"), (0, "don't"), (3, "hi")]
