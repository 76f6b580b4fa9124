"""Every registered query with SQL, against DuckDB on the smallest tables; the others at least run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.plans import registry
from inkwell.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 5) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.oracle_sql():
        assert got
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "inkwell")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "inkwell.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
