"""Subjects: held-out accuracy on generated documents, a language without examples, odd input."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np

from cartoweave.llm import subjects as K

GENERAL = {"en": "the of and to with morning river street letter window bottle walked quiet yellow they would from there", "es": "el la los una que con mañana río calle carta ventana botella caminó tranquilo amarillo ellos pero muy"}
OWN = {
    ("en", "law"): "tribunal contract clause plaintiff verdict attorney defendant statute custody injunction", ("en", "music"): "guitar melody concerto orchestra violin rhythm soprano trumpet album chorus", ("en", "food"): "recipe butter oven garlic simmer noodle onion pepper basil flour",
    ("es", "law"): "tribunal contrato cláusula demandante veredicto abogado acusado estatuto juzgado fiscal", ("es", "music"): "guitarra melodía concierto orquesta violín ritmo soprano trompeta álbum estribillo", ("es", "food"): "receta mantequilla horno ajo cebolla harina queso masa fideo especia",
}
SUBJECTS = ("food", "law", "music")


def part(rng, lang, subject, n):
    return " ".join(rng.choice((OWN[lang, subject] if subject and rng.random() < 0.35 else GENERAL[lang]).split()) for _ in range(n))


def test_planted_subjects(spark):
    rng = random.Random(1)
    docs, want = [], set()
    for i in range(900):
        lang = "en" if i % 3 else "es"
        kind = rng.random()
        if kind < 0.2:
            text, own = part(rng, lang, None, 80), ()
        elif kind < 0.6:
            own = (rng.choice(SUBJECTS),)
            text = part(rng, lang, own[0], 80)
        elif kind < 0.8:
            own = tuple(rng.sample(SUBJECTS, 2))
            text = part(rng, lang, own[0], 60) + " " + part(rng, lang, own[1], 60)
        else:
            own = (rng.choice(SUBJECTS),)
            other = rng.choice([s for s in SUBJECTS if s != own[0]])
            text = part(rng, lang, own[0], 110) + " " + " ".join(rng.sample(OWN[lang, other].split(), 3)) + " " + part(rng, lang, own[0], 40)
        docs.append((i, text, lang, "x"))
        want |= {(i, s) for s in own}
    docs += docs[:30] + [(5000, None, "en", "x"), (5001, "", None, "x"), (5002, "12 :)", None, "x"), (None, "law", "en", "x")]
    examples = [(f"{part(rng, 'en', s, 60)}", s) for s in SUBJECTS for _ in range(12)] + [(part(rng, "es", "food", 60), "food") for _ in range(6)]
    examples += [(part(rng, "en", "music", 60), "law"), (None, "law"), ("", "law"), ("text", "unknown")]
    run = lambda d, e, s: K.document_subjects(d, "doc_id", "text", "lang", e, "text", "subject", s, "subject")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject string")
    e = spark.createDataFrame(examples, "text string, subject string")
    s = spark.createDataFrame([(x,) for x in (*SUBJECTS, "empty")], "subject string")
    rows = run(d, e, s).collect()
    got = {(r["id"], r["subject"]) for r in rows}
    assert len(got) == len(rows) and all(0.5 <= r["posterior"] <= 1 for r in rows)
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    spanish = {x for x in want if x[0] % 3 == 0 and x[1] != "food"}
    assert len(got & spanish) / len(spanish) > 0.85
    assert run(d.where("false"), e, s).count() == 0 and run(d, e, s.where("false")).count() == 0
    assert run(d.limit(20), e.where("false"), s).count() == 0


def toy_model(seed):
    """A table of weights for one language with the own words of two subjects, and the calibration from generated texts."""
    rng = np.random.default_rng(seed)
    table = np.zeros((len(K.LANGUAGES) * K.BUCKETS, 2), np.float32)
    table[100:150, 0] = 3.5
    table[200:250, 1] = 3.5

    def text(subject, n, density=0.33):
        general, own = rng.integers(1000, 1400, n), rng.integers(100, 150, n) + 100 * max(subject, 0)
        return np.where(rng.random(n) < density, own, general) if subject >= 0 else general

    texts = [text(i % 2, int(rng.integers(40, 110))) for i in range(24)]
    x = K._Examples(np.arange(24) % 2, np.zeros(24, np.int64), np.array([len(t) for t in texts]), np.concatenate(texts), {})
    return table, K.calibrate(x, 2, table), text, rng


def posteriors(texts, table, coefficients):
    return K.subject_posteriors(np.zeros(len(texts), np.int64), np.array([len(t) for t in texts]), np.concatenate(texts), table, coefficients)


def test_spread_needs_more_than_a_passing_mention():
    table, coefficients, text, rng = toy_model(1)
    general = text(-1, 60)
    spread, passage, one = general.copy(), general.copy(), general.copy()
    spread[::4], passage[:6], one[5] = 110, 110, 110
    assert [bool(p >= 0.5) for p in posteriors([spread, passage, one], table, coefficients)[:, 0]] == [True, False, False]


def test_posteriors_are_reliable():
    """Among fresh texts, those with a posterior in a bin hold the subject about as often as it says, and few lie between."""
    table, coefficients, text, rng = toy_model(2)
    texts, labels = [], []
    for _ in range(600):
        kind, n = rng.integers(0, 4), int(rng.integers(40, 140))
        if kind == 0:
            texts.append(text(0, n)), labels.append(True)
        elif kind == 1:
            texts.append(np.r_[text(1, n), text(0, n)]), labels.append(True)
        elif kind == 2:
            texts.append(text(1, n)), labels.append(False)
        else:
            host = text(-1, n)
            at = int(rng.integers(0, n - n // 8))
            host[at : at + n // 8] = text(0, n // 8)
            texts.append(host), labels.append(False)
    p, y = posteriors(texts, table, coefficients)[:, 0], np.array(labels)
    assert ((p >= 0.5) == y).mean() >= 0.99
    for low, high in ((0, 0.1), (0.9, 1.01)):
        bin_ = (p >= low) & (p < high)
        assert bin_.sum() > 200 and abs(y[bin_].mean() - p[bin_].mean()) < 0.03
    assert ((p > 0.1) & (p < 0.9)).mean() < 0.15


def test_features_against_plain_loops():
    rng = np.random.default_rng(3)
    table = np.zeros((len(K.LANGUAGES) * K.BUCKETS, 2), np.float32)
    table[:40] = rng.choice([0, 0, 0, 2.0, 3.0], (40, 2))
    sizes = np.array([1, 2, 17, 40, 9])
    bucket = rng.integers(0, 40, sizes.sum())
    for part in range(3):
        got = K.segment_features(np.zeros(5, np.int64), sizes, bucket, table, part)
        for i, words in enumerate(np.split(bucket, np.cumsum(sizes)[:-1])):
            half = (len(words) + 1) // 2
            e = table[[words, words[:half], words[half:]][part]]
            assert len(e) or (got[i, :, :2] == 0).all()
            for s in range(2 if len(e) else 0):
                k = max(1, round(len(e) / K.PIECE))
                parts = [[x for j, x in enumerate(e[:, s]) if j * k // len(e) == q] for q in range(k)]
                gap = max(len(x) for x in "".join("1" if v > 0 else "0" for v in e[:, s]).split("1"))
                want = [np.mean([1 / (1 + np.exp(K.REST - sum(x))) for x in parts]), e[:, s].mean() / 3, gap / len(e), np.log(len(e)) / 4]
                assert np.allclose(got[i, s], want, atol=1e-5)


def test_spelling_grams():
    import pyarrow as pa

    def plain(word):
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        for a, b in (("ph", "f"), ("th", "t"), ("ch", "k"), ("qu", "k"), ("c", "k"), ("y", "i"), ("z", "s"), ("v", "b")):
            word = word.replace(a, b)
        word = re.sub(r"(.)\1+", r"\1", f"_{word}_")
        return {word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)}

    words = ["molécula", "molecule", "theorem", "teorema", "queso", "cheese", "ballet", "a"]
    owner, gram = K.spelling_grams(pa.array(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert len(set(gram[owner == i]) & set(gram[owner == j])) == len(plain(a) & plain(b))


def test_examples_are_bounded_by_subject(spark, monkeypatch):
    monkeypatch.setattr(K, "EXAMPLES", 30)
    rng = random.Random(5)
    rows = [(part(rng, "en", s, 20), s) for s in SUBJECTS for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    language = K.fit_from(docs, "doc_id", "text", "lang", 100, K.LANGUAGES)
    got = K.labelled_examples(spark.createDataFrame(rows, "text string, subject string"), "text", "subject", SUBJECTS, language)
    assert np.bincount(got.subject).tolist() == [10, 10, 10]
