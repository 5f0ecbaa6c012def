"""Rank statistics (R1-R7); quantiles and weighted medians are in ``quantile``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.aggregate import div
from spanaccord.operators.quantile import medians, weighted_median
from spanaccord.operators.scan import _c, running_sum, scan
from spanaccord.operators.scoring import erfc_of


def rank_sums(df: DataFrame, by: list[str], score, label: str, weight: Column | None = None) -> DataFrame:
    """Per group: weights of both classes, the pairs won by positives (ties half), and the tie term.

    Equal scores are folded first, so the ordered pass runs over distinct scores.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    d = df.select(*by, _c(score).cast("double").alias("_s"), F.col(label).alias("_y"), w.alias("_w")).where("_s is not null and _w > 0")
    g = d.groupBy(*by, "_s").agg(
        F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(F.col("_w") * 0)).alias("_p"),
        F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(F.col("_w") * 0)).alias("_q"),
    )
    s = scan(g, by, ["_s"], {"_below": running_sum("_q")})
    t = (F.col("_p") + F.col("_q")).cast("double")
    return s.groupBy(*by).agg(
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"),
        F.sum(F.col("_p") * (F.col("_below") - F.col("_q") + F.lit(0.5) * F.col("_q"))).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )


def auc(df: DataFrame, by: list[str], score, label: str, weight: Column | None = None) -> DataFrame:
    """P(positive above negative) + half of the ties; null when a class is empty."""
    r = rank_sums(df, by, score, label, weight)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return r.select(*by, "n_pos", "n_neg", div(F.col("u"), pairs).alias("auc"))


def stratified_auc(df: DataFrame, strata: list[str], score, label: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Pairs of the same stratum only; strata weigh by their number of pairs."""
    by = by or []
    r = rank_sums(df, [*by, *strata], score, label, weight)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return r.groupBy(*by).agg(div(F.sum("u"), F.sum(pairs)).alias("auc"), F.sum(pairs).alias("pairs"))


def mean_cluster_auc(df: DataFrame, cluster: str, score, label: str, by: list[str] | None = None) -> DataFrame:
    """Mean of per-cluster values; clusters with one class drop out."""
    by = by or []
    a = auc(df, [*by, cluster], score, label)
    return a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.count("auc").alias("n_used"), F.avg("auc").alias("mean_auc"))


def mann_whitney(df: DataFrame, by: list[str], score, label: str) -> DataFrame:
    """Two-sided p value by the tie-corrected normal approximation with continuity correction."""
    r = rank_sums(df, by, score, label)
    a, b = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = a + b
    sd = F.sqrt(a * b / 12.0 * ((n + 1) - div(F.col("ties"), n * (n - 1))))
    z = div(F.greatest(F.abs(F.col("u") - a * b / 2) - 0.5, F.lit(0.0)), sd)
    return erfc_of(r.select(*by, "n_pos", "n_neg", "u", z.alias("z")), F.col("z") / F.sqrt(F.lit(2.0)), "p")


def median_diff(df: DataFrame, by: list[str], score, correct: str) -> DataFrame:
    """Median of the wrong minus median of the correct decisions."""
    m = medians(df, [*by, correct], score, "_m")
    w, c = F.max(F.when(F.col(correct) == 0, F.col("_m"))), F.max(F.when(F.col(correct) == 1, F.col("_m")))
    return m.groupBy(*by).agg(w.alias("median_wrong"), c.alias("median_correct"), (w - c).alias("diff"))


def weighted_median_diff(df: DataFrame, by: list[str], score, correct: str, weight, mode: str = "lower") -> DataFrame:
    """The same with weights."""
    m = weighted_median(df, [*by, correct], score, weight, mode, "_m")
    w, c = F.max(F.when(F.col(correct) == 0, F.col("_m"))), F.max(F.when(F.col(correct) == 1, F.col("_m")))
    return m.groupBy(*by).agg((w - c).alias("diff"))
