"""Reconciliation and audit (Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.aggregate import by_conditions, div
from spanaccord.operators.reshape import MATCHED
from spanaccord.operators.scoring import class_metrics, confusion


def reconcile(expected: DataFrame, actual: DataFrame, key: list[str], value: str, tol: float = 0.0) -> DataFrame:
    """Q1: named expected values beside the recomputed ones."""
    e = expected.select(*key, F.col(value).alias("expected"))
    a = actual.select(*key, F.col(value).alias("actual"))
    j = e.join(a, key, "full_outer")
    same = F.abs(F.col("expected") - F.col("actual")) <= tol
    return j.withColumn("equal", F.coalesce(same, F.col("expected").isNull() & F.col("actual").isNull()))


def row_mismatches(a: DataFrame, b: DataFrame, key: list[str], cols: list[str], tol: float = 0.0) -> DataFrame:
    """Q2: rows that differ in any column, and rows without a partner."""
    l = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    r = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    j = l.join(r, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    diff = F.lit(False)
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        gap = ~x.eqNullSafe(y) if not tol else ~F.coalesce(F.abs(x - y) <= tol, x.isNull() & y.isNull())
        diff = diff | gap
    return j.agg(
        F.count_if(both).alias("compared"), F.count_if(both & diff).alias("mismatches"),
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def max_abs_diff(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Q3: largest absolute difference of stored and recomputed values."""
    j = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in cols]), key)
    return j.agg(*[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_{c}") for c in cols], F.count(F.lit(1)).alias("n"))


def tier_consistency(df: DataFrame, groups: dict[str, Column], checks: dict[str, Column]) -> DataFrame:
    """Q4: share of rows that pass each check, by groups that may overlap."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    d = df.select(F.explode(tags).alias("group"), *[c.alias(n) for n, c in checks.items()])
    return d.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(n).cast("int")).alias(n) for n in checks])


def flag_detector(df: DataFrame, truth: Column, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Q5: a flag as detector of a condition."""
    by = by or []
    d = df.select(*by, truth.cast("int").alias("human"), flag.cast("int").alias("aligner"))
    return class_metrics(confusion(d, by)).select(*by, "tp", "fn", "fp", "tn", "sens", "spec")


def sweep_summary(aln: DataFrame, thresholds=(10, 20)) -> DataFrame:
    """Q6: shares of the error types and tolerance rates per parameter set."""
    n = F.count(F.lit(1))
    types = ("displacement", "substitution", "omission", "insertion")
    matched = F.col("error_type").isin(*MATCHED)
    a = aln.groupBy("config").agg(
        n.alias("n"), *[div(F.count_if(F.col("error_type") == t) * 100.0, n).alias(f"pct_{t}") for t in types],
        *[
            div(F.count_if(matched & (F.abs(e) <= t)) * 100.0, F.count_if(matched)).alias(f"{b}_within{t}")
            for b, e in (("onset", F.col("onset_error_ms")), ("offset", F.col("offset_error_ms"))) for t in thresholds
        ],
    )
    return a
