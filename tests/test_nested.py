"""Flat tables from nested records: hand cases, round trip, odd input."""

from __future__ import annotations

import json
import random

import pyarrow as pa

from cartoweave.operators import json_events as J
from cartoweave.operators.nested import Layout, ancestor, flat_rows, flat_table, found_layout, json_triples, path_counts, triples

LAYOUT = Layout(frozenset({"m", "m[].parts"}), frozenset({"m[].sizes"}), {"m": ("m[]", ("name", "")), "part": ("m[].parts[]", ("",)), "size": ("m[].sizes{}", ("w",))})


def of(spark, *records):
    df = spark.createDataFrame([(i, r, "x", 7) for i, r in enumerate(records)], "id long, record string, tbl string, value int")
    return sorted(map(tuple, flat_rows(df, "id", "record", LAYOUT).collect()), key=str)


def test_children_keep_their_places_and_parents(spark):
    rec = json.dumps({"m": [None, {"name": "a", "parts": ["p", None, "q"], "sizes": {"s": {"w": 3}}}, {"name": None}]})
    assert of(spark, rec) == sorted([(0, "m", ["1"], ["a", None]), (0, "part", ["1", "0"], ["p"]), (0, "part", ["1", "2"], ["q"]), (0, "size", ["1", "s"], ["3"]), (0, "m", ["2"], [None, None])], key=str)


def test_object_for_list_and_text_inside_text(spark):
    one = {"m": {"name": "a"}}
    assert of(spark, json.dumps(one)) == of(spark, json.dumps(json.dumps(one))) == [(0, "m", ["0"], ["a", None])]
    assert of(spark, json.dumps({"m": ["plain"]})) == [(0, "m", ["0"], [None, "plain"])]
    assert of(spark, json.dumps({"m": json.dumps([{"name": "b"}])})) == [(0, "m", ["0"], ["b", None])]


def test_nothing_in_odd_input(spark):
    assert of(spark, None, "", "{", "[1,", "null", "[]", '"x"', "[" * 100000, json.dumps({"m": None}), json.dumps({"other": [1]})) == []


def test_long_record_and_empty_table(spark):
    rec = json.dumps({"m": [{"name": str(i)} for i in range(20000)]})
    assert len(of(spark, rec)) == 20000
    empty = spark.createDataFrame([], "id long, record string")
    assert flat_rows(empty, "id", "record", LAYOUT).count() == 0


def test_triples_round_trip():
    rec = {"m": [{"name": "a", "parts": ["x", "y"]}], "k": {"deep": [1, [2, 3]]}}
    found = {(p, o): v for p, o, v in triples(json.dumps(rec), LAYOUT)}
    assert found["m[].parts[]", ("0", "1")] == "y" and found["k.deep[][]", ("1", "0")] == "2"
    assert ancestor("m[].parts[].z") == "m[].parts[]" and ancestor("plain.path") == "" and ancestor("m[].sizes{}.w") == "m[].sizes{}"


def test_triples_and_one_table(spark):
    df = spark.createDataFrame([(1, json.dumps({"m": [{"name": "a"}]}))], "id long, record string")
    assert {r["path"] for r in json_triples(df, "id", "record", LAYOUT).collect()} == {"m[]", "m[].name"}
    table = flat_table(flat_rows(df, "id", "record", LAYOUT), LAYOUT, "m", ["place"], "tweet")
    assert table.columns == ["tweet", "place", "name", "value"] and table.first()[:3] == (1, "0", "a")


def test_wrapped_any_number_of_times(spark):
    one = json.dumps({"m": [{"name": "a"}]})
    for _ in range(12):
        one = json.dumps(one)
    assert of(spark, one) == [(0, "m", ["0"], ["a", None])]
    assert of(spark, json.dumps({"m": [json.dumps({"name": "in"}), "{no json", "x"]})) == [(0, "m", ["0"], ["in", None]), (0, "m", ["1"], [None, "{no json"]), (0, "m", ["2"], [None, "x"])]


def test_deep_record():
    deep = "[" * 9000 + '"x"' + "]" * 9000
    ((path, ordinals, value),) = triples(deep, LAYOUT)
    assert path == "[]" * 9000 and ordinals == ("0",) * 9000 and value == "x"


def test_undeclared_paths_are_reported_and_become_tables(spark):
    rec = {"m": [{"name": "a", "tags": [{"t": 1}, {"t": 2}]}], "title": "T"}
    df = spark.createDataFrame([(1, json.dumps(rec)), (2, None), (3, "{")], "id long, record string")
    told = {r["path"]: (r["ancestor"], r["values"], r["declared"]) for r in path_counts(df, "record", LAYOUT).collect()}
    assert told == {"m[]": ("m[]", 1, True), "m[].name": ("m[]", 1, True), "m[].tags[]": ("m[].tags[]", 2, False), "m[].tags[].t": ("m[].tags[]", 2, False), "title": ("", 1, False)}
    layout = found_layout(df, "record", LAYOUT)
    assert set(layout.tables) == {"", "m[]", "m[].tags[]"}
    rows = sorted(map(tuple, flat_rows(df, "id", "record", layout).collect()), key=str)
    assert rows == sorted([(1, "", [], ["T"]), (1, "m[]", ["0"], [None, "a"]), (1, "m[].tags[]", ["0", "0"], [None, "1"]), (1, "m[].tags[]", ["0", "1"], [None, "2"])], key=str)


def plain_parse(text):
    try:
        return ("ok", json.loads(text))
    except ValueError:
        return ("bad",)


def test_batch_parser_against_the_plain_one():
    rng = random.Random(1)

    def made(depth=0):
        x = rng.random()
        if depth > 4 or x < 0.4:
            return rng.choice([None, True, False, 0, -1.5, 1e10, "", 'a"b\\', "é\n", "[x", "{}", 12, "\\\\", "日本"])
        if x < 0.7:
            return [made(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", 'c"', "d\\", "é"]): made(depth + 1) for _ in range(rng.randrange(4))}

    records = ["", " ", "[1 2]", '{"a" 1}', "[1,]", "{,}", "01", "nul", '"\\x"', "[]]", "[[]", "1 2", '["a" "b"]', "[}", "{]", "\t[1]\n", '{"a":1,"a":[2]}', None]
    for _ in range(1500):
        s = json.dumps(made(), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        k, cut = rng.randrange(len(s) + 1), rng.random()
        records.append(s if cut < 0.4 else s[:k] if cut < 0.6 else s[:k] + rng.choice('{}[]:,"\\ 0x') + s[k:] if cut < 0.8 else s[:k] + s[k + 1 :])
    v = J.parse(pa.array(records, pa.string()))
    children = {}
    for i in range(len(v.row)):
        children.setdefault(int(v.parent[i]) if v.parent[i] >= 0 else ("top", int(v.row[i])), []).append(i)

    def rebuilt(i):
        own = children.get(i, [])
        if v.kind[i] == J.OBJECT:
            return {v.names[v.name[c]]: rebuilt(c) for c in own}
        if v.kind[i] == J.LIST:
            assert v.place[own].tolist() == list(range(len(own)))
            return [rebuilt(c) for c in own]
        text = v.text[i].as_py()
        return None if v.kind[i] == J.NULL else text if v.kind[i] == J.STRING else json.loads(text)

    for r, text in enumerate(records):
        top = children.get(("top", r))
        assert (("ok", rebuilt(top[0])) if top else ("bad",)) == (plain_parse(text) if text is not None else ("bad",)), text
