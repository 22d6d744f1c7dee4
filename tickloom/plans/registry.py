"""Registry of named queries, each with its result shape and, where SQL can say it, its oracle.

A shape string lists the output columns: ``name`` as is, ``name!`` a date as text, ``name@`` a
timestamp as text, ``name#`` a bigint, ``name:4`` a double rounded to 4 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _token(tok: str) -> tuple[str, str, int]:
    if ":" in tok:
        n, d = tok.split(":")
        return n, "round", int(d)
    if tok[-1] in "!@#":
        return tok[:-1], tok[-1], 0
    return tok, "", 0


def shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for n, kind, d in map(_token, spec.split()):
        c = F.col(n)
        if kind == "round":
            c = F.round(c.cast("double"), d) + F.lit(0.0)
        elif kind == "!":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "@":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "#":
            c = c.cast("long")
        cols.append(c.alias(n))
    return df.select(*cols)


def shape_sql(spec: str) -> str:
    cols = []
    for n, kind, d in map(_token, spec.split()):
        e = n
        if kind == "round":
            e = f"round(CAST({n} AS DOUBLE), {d}) + 0.0"
        elif kind == "!":
            e = f"strftime(CAST({n} AS TIMESTAMP), '%Y-%m-%d')"
        elif kind == "@":
            e = f"strftime(CAST({n} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif kind == "#":
            e = f"CAST({n} AS BIGINT)"
        cols.append(f"{e} AS {n}")
    return ", ".join(cols)


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is a CTE list that ends with one named result."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[name] = f"WITH {sql.strip()}\nSELECT {shape_sql(spec)} FROM result"
        return fn

    return wrap
