"""Term counts: deltas lead to the counts of the whole, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

from cartoweave.llm import terms as K

DOCS = [(1, "Tea, tea and RUM!"), (2, "tea"), (3, None), (4, ""), (5, "été 42 été"), (6, "a_b a-b ...")]


def plain(docs):
    import re

    occurrences, records = Counter(), Counter()
    for t in docs:
        found = [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
        occurrences.update(found)
        records.update(set(found))
    return {w: (n, records[w]) for w, n in occurrences.items()}


def counted(df):
    return {r["term"]: (r["occurrences"], r["records"]) for r in df.where("term is not null").collect()}


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, text string")


def test_text_counts(spark):
    assert counted(K.text_deltas(frame(spark, DOCS), "text")) == plain([t for _, t in DOCS])
    long = "word other " * 50_000
    assert counted(K.text_deltas(frame(spark, [(1, long)]), "text")) == {"word": (50_000, 1), "other": (50_000, 1)}
    assert counted(K.text_deltas(frame(spark, []), "text")) == {}


def test_deltas_lead_to_the_new_state(spark, tmp_path):
    new = [(1, "tea"), (2, "tea"), (5, None), (7, "new tea")]
    store = K.TermStore(spark, f"file://{tmp_path}/terms", 4)
    assert store.counts() is None and store.version() == 0
    assert store.apply(K.text_deltas(frame(spark, DOCS), "text")) == 1
    changes = K.change_set(frame(spark, DOCS), frame(spark, new), "id", "text")
    assert {r["sign"] for r in changes.collect()} == {1, -1} and changes.where("text = 'tea' and sign = -1").count() == 0
    assert store.apply(K.text_deltas(changes, "text", "sign")) == 2
    assert counted(store.counts()) == plain([t for _, t in new])
    assert K.record_total(store.counts()) == len(new)


def test_valued_rows_and_marks(spark):
    rows = [(1, 7, 3), (1, 7, 2), (2, 7, 1), (2, 8, 0), (3, 8, -1), (3, 9, None), (None, 9, 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "user long, word long, count long")
    got = K.merge_counts(None, K.valued_deltas(K.merge_rows(None, K.row_deltas(df, "word", "count", "user"))))
    assert counted(got) == {"7": (6, 2)} and K.record_total(got) == 2
    marks = lambda **x: K.mark_terms(got, **x).first()["mark"]
    assert marks(total_records=4, rare_below=7, common_above=0.4) == "rare"
    assert marks(total_records=4, rare_below=6, common_above=0.4) == "common"
    assert marks(total_records=4, rare_below=6, common_above=0.5) is None


def test_random_changes_equal_a_recount(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    state = {i: " ".join(rng.choices(words, k=rng.randrange(6))) for i in range(40)}
    store = K.TermStore(spark, f"file://{tmp_path}/texts", 8)
    store.apply(K.text_deltas(frame(spark, list(state.items())), "text"))
    for _ in range(3):
        new = {i: t for i, t in state.items() if rng.random() > 0.2}
        new |= {i: " ".join(rng.choices(words, k=4)) for i in rng.sample(range(60), 8)}
        store.apply(K.text_deltas(K.change_set(frame(spark, list(state.items())), frame(spark, list(new.items())), "id", "text"), "text", "sign"))
        state = new
        assert counted(store.table()) == plain(state.values()) and K.record_total(store.table()) == len(state)


def test_random_changes_of_valued_rows_equal_a_recount(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(5), rng.randrange(1, 4)) for _ in range(60)]
    store = K.ValuedStore(spark, f"file://{tmp_path}/valued", 8)
    schema = "user long, word long, count long, sign int"
    store.apply(K.row_deltas(spark.createDataFrame([(*r, 1) for r in rows], schema), "word", "count", "user", "sign"))
    for _ in range(3):
        gone, new = rng.sample(rows, 15), [(rng.randrange(7), rng.randrange(6), rng.randrange(1, 4)) for _ in range(12)]
        for r in gone:
            rows.remove(r)
        rows += new
        store.apply(K.row_deltas(spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in new], schema), "word", "count", "user", "sign"))
        want = {}
        for user, word, n in set(rows):
            total, users = want.setdefault(str(word), [0, set()])
            want[str(word)] = [total + n, users | {user}]
        assert counted(store.counts()) == {w: (n, len(u)) for w, (n, u) in want.items()}
        assert K.record_total(store.counts()) == len({u for u, _, _ in rows})


def test_a_merge_rewrites_the_touched_partitions_only(spark, tmp_path):
    store = K.TermStore(spark, f"file://{tmp_path}/few", 4)
    store.apply(K.text_deltas(frame(spark, [(i, f"word{i}") for i in range(40)]), "text"))
    store.apply(K.text_deltas(frame(spark, [(99, "word1")]), "text"))
    written = lambda v: {p.name for p in (tmp_path / "few" / "data" / str(v)).glob("bucket=*")}
    assert len(written(2)) <= 2 < len(written(1)) and counted(store.table())["word1"] == (2, 2)


def test_one_row_in_two_spellings_of_its_count(spark, tmp_path):
    """A second row of the same user and word with another count adds to the sum and not to the users."""
    store = K.ValuedStore(spark, f"file://{tmp_path}/two")
    schema = "user long, word long, count long, sign int"
    for rows in ([(1, 7, 5, 1)], [(1, 7, 3, 1), (1, 7, 3, 1)]):
        store.apply(K.row_deltas(spark.createDataFrame(rows, schema), "word", "count", "user", "sign"))
    assert counted(store.counts()) == {"7": (8, 1)}
    store.apply(K.row_deltas(spark.createDataFrame([(1, 7, 5, -1)], schema), "word", "count", "user", "sign"))
    assert counted(store.counts()) == {"7": (3, 1)}
