"""Joining a per-group table back to its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spanaccord import settings

#: up to so many groups are sent to every task; a row of a group table is a few numbers and a key
FEW_GROUPS = 50_000

def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one row per group back to the rows of ``df``; a null key is a group like any other.

    The groups are kept and counted: few are broadcast, so that the rows stay where they are and a group with
    most of them is no single task; else it is an ordinary shuffle join, whose hot keys adaptive execution splits.
    """
    groups = settings.cut(groups)
    groups = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups.hint("merge")
    named = groups.select(*[F.col(f"`{c}`").alias(f"_key_{c}") if c in keys else F.col(f"`{c}`") for c in groups.columns])
    on = reduce(lambda x, y: x & y, [df[k].eqNullSafe(named[f"_key_{k}"]) for k in keys])
    return df.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as scalar subqueries."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])
