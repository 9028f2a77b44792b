"""Registration of named queries with their SQL for DuckDB, and what they share.

Each query is a function of (spark, sf_dir); ``query`` registers it with its SQL. Numbers that come out
of sums of fractions are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(c):
    """Rounded to six places; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


#: SQL of the same.
def sql_six(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"
