"""Set operations (U1-U5) and the metric report (K3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_parts(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def ids_in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Ids that every frame has."""
    return reduce(DataFrame.intersect, [f.select(key) for f in frames])


def ids_missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U4: ids of the first frame that the second lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def seed_spread(df: DataFrame, key: list[str], est: str = "estimate", low: str = "low", high: str = "high") -> DataFrame:
    """Spread of an estimate over seeds, agreement of sign, and whether an interval holds zero."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("runs"), (F.max(est) - F.min(est)).alias("spread"),
        (F.count_distinct(F.signum(est)) == 1).alias("same_sign"), F.bool_or(F.lit(0.0).between(F.col(low), F.col(high))).alias("zero_inside"),
    )
