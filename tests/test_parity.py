"""Every registered query with SQL equals DuckDB on the small tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from auditframe.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    number = float(value)
    return "nan" if math.isnan(number) else f"{number:.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_alike_twice(spark, name):
    a, b = (rows((df := QUERIES[name](spark, SMALL)).columns, df.collect()) for _ in range(2))
    assert a == b and a[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
