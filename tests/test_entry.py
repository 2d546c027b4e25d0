"""The registry: every query runs, and equals its SQL on the smallest data."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry
from cartoweave.plans import catalogue


def cleaned(v):
    if isinstance(v, (list, tuple)):
        return [cleaned(x) for x in v]
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"create view {f.stem} as from '{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) == len({*catalogue.QUERIES})


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(repr(cleaned([r[c] for c in columns])) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        found = con.execute(catalogue.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(cleaned([r[names.index(c)] for c in columns])) for r in found.fetchall())


def test_entry_has_rows(spark, small):
    assert entry.entry(spark).limit(1).count() == 1
