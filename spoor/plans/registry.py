"""Registry of runnable queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures
from .fixtures import forget, shared  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, str]] = {}
CTES: dict[str, str] = dict(fixtures.SQL)  # name -> SQL; may use earlier names

DIGITS = 6
NUDGE = 1e-9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, so sums in another order compare equal; the nudge keeps exact ties on one side."""
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def oracle(sql: str, doubles: str = "") -> str:
    """Prefix the CTEs the statement names, in order, and round its double columns."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                need.append(name)

    visit(sql)
    cols = ", ".join(f"CAST(round(CAST({c} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0 AS DOUBLE) AS {c}" for c in doubles.split())
    body = f"SELECT * REPLACE ({cols}) FROM ({sql}) q" if cols else sql
    if not need:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in need) + "\n" + body


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            _SQL[name] = (sql, doubles)
        return fn

    return add


def oracles() -> dict[str, str]:
    return {name: oracle(sql, doubles) for name, (sql, doubles) in _SQL.items()}
