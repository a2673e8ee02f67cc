"""Every registered query against its oracle on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def table(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([cell(r[i]) for i in at] for r in rows), key=repr)


# Families of their own have tests of their own.
NAMES = sorted(n for n, fn in entry.queries().items() if fn.__module__.startswith("duskwatch.plans."))


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cursor = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_ip", "up", "down", "flows", "pcr"] and df.count() == 15
