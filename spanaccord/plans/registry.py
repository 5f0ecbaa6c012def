"""Registry of the named queries and of their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Report form: integers as BIGINT, floats rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, dbl: str = "", ctes: list[str] | None = None, digits: int = DIGITS, big: str = ""):
    """Register ``fn(spark, sf)`` under ``name``.

    ``dbl`` lists the float columns of ``sql`` to round, ``big`` those to read as BIGINT.
    """

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
        if sql is not None:
            body = sql.strip()
            if ctes:
                body = "WITH " + ", ".join(ctes) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
            rep = [f"round({c}, {digits}) + 0 AS {c}" for c in dbl.split()]
            rep += [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
            if rep:
                body = f"SELECT * REPLACE ({', '.join(rep)}) FROM ({body})"
            ORACLES[name] = body
        return fn

    return deco
