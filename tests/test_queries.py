"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

AT = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(AT):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{AT}/{t}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, AT)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = [tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_other_queries_run(spark):
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, AT).count() > 0


def test_nothing_else_needs_the_language_model_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "geoloom")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "geoloom.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
