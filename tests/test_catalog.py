from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sedimenta import catalog

DIR = "/root/testdata/sf0.001"
ALONE = {n: q for n, q in catalog.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ALONE))
def test_query_matches_its_oracle(spark, duck, name):
    df = ALONE[name](spark, DIR)
    columns = sorted(df.columns)
    got = Counter(str([normal(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(str([normal(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert got == want


def test_entry_and_registration(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
