"""The registered queries of the subpackage on the smallest data."""

from __future__ import annotations

from pathlib import Path

import pytest

from cartoweave.llm import queries as Q

COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["tbl", "id_a", "id_b"], "p3_found": ["tweet_id", "seg_no", "lang"], "p4_found": ["tbl", "id_a", "id_b"], "p5_found": ["field", "term", "mark"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows)) > 0
        assert {k for c, k in df.dtypes if c not in ("tbl", "lang", "field", "term", "mark", "subject")} <= {"bigint"}
        if "id_a" in df.columns:
            assert all(r[-2] < r[-1] for r in rows)
    if name in Q.ORACLE_SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in Path(small).glob("*.parquet"):
            con.execute(f"create view {f.stem} as from '{f}'")
        assert sorted(map(str, rows)) == sorted(map(str, con.execute(Q.ORACLE_SQL[name]).fetchall()))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "cartoweave"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "cartoweave.llm" not in f.read_text(), f
