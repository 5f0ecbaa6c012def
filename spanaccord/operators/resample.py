"""Bootstraps by cluster.

Weights are rows (cluster, replicate, multiplicity), never a matrix on the
driver.  Data are folded to per-cluster sums first, so the replicate multiplies
clusters, not rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from spanaccord import settings
from spanaccord.functions.hashing import h32, hex_hash
from spanaccord.operators.aggregate import div
from spanaccord.operators.groups import beside
from spanaccord.operators.quantile import quantiles
from spanaccord.operators.rank import auc, weighted_median_diff
from spanaccord.operators.scan import number, scan, total
from spanaccord.operators.scoring import CELLS, class_metrics


def cluster_index(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys numbered from 0 in hash order, with their number ``n``."""
    d = df.select(F.col(key)).distinct()
    s = scan(d, [], [hex_hash(F.col(key)), key], {"_rn": number(), "n": total(F.lit(1).cast("long"))}, split_on=h32(F.col(key)))
    return s.select(key, (F.col("_rn") - 1).alias("idx"), "n")


def cluster_weights(df: DataFrame, key: str, reps: int, seed: str = "1", weight: str = "w") -> DataFrame:
    """B1: how often each cluster is drawn in each replicate (rows with zero are left out).

    Slot i of replicate b draws cluster hash(seed, b, i) mod n.  There are clusters times replicates of them,
    which no size estimate knows of: the clusters are dealt out before they are multiplied, the draws are
    shuffled once and counted there, and the hints keep the weights from ever being broadcast.
    """
    idx = cluster_index(df, key)
    dealt = idx.repartition(settings.parts(df.sparkSession), "idx")
    slots = dealt.select("idx", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("b"))
    drawn = slots.select("b", (h32(seed, F.col("b"), F.col("idx")) % F.col("n")).alias("idx")).repartition("idx")
    drawn = drawn.groupBy("idx", "b").agg(F.count(F.lit(1)).alias(weight))
    return drawn.hint("merge").join(idx.select(key, "idx"), "idx").select(key, "b", weight).hint("merge")


def weighted_sums(stats: DataFrame, weights: DataFrame, key: str, by: list[str], cols: list[str], weight: str = "w") -> DataFrame:
    """Sums of the per-cluster statistics in every replicate."""
    return stats.join(weights, key).groupBy(*by, "b").agg(*[F.sum(F.col(c) * F.col(weight)).alias(c) for c in cols])


def two_way_sums(cells: DataFrame, k1: str, k2: str, by: list[str], cols: list[str], reps: int, seed: str = "1") -> DataFrame:
    """B2: sums weighted by the product of the multiplicities of two crossed keys.

    The sum over the key with more values is taken first, within the other key; only that
    smaller table meets the other weights.
    """
    c = cells.groupBy(k1, k2, *by).agg(*[F.sum(x).alias(x) for x in cols])
    n = cells.agg(*[F.approx_count_distinct(k).alias(k) for k in (k1, k2)]).first()
    many, few = (k1, k2) if n[k1] >= n[k2] else (k2, k1)
    w = cluster_weights(cells, many, reps, f"{seed}-{many}", "_w1")
    inner = c.join(w, many).groupBy(few, *by, "b").agg(*[F.sum(F.col(x) * F.col("_w1")).alias(x) for x in cols])
    w = cluster_weights(cells, few, reps, f"{seed}-{few}", "_w2")
    return inner.join(w, [few, "b"]).groupBy(*by, "b").agg(*[F.sum(F.col(x) * F.col("_w2")).alias(x) for x in cols])


def two_way_weights(cells: DataFrame, k1: str, k2: str, reps: int, seed: str = "1") -> DataFrame:
    """B2 as weights per cell and replicate, for statistics that are no sums."""
    c = cells.select(k1, k2).distinct()
    w1 = cluster_weights(cells, k1, reps, f"{seed}-{k1}", "_w1")
    w2 = cluster_weights(cells, k2, reps, f"{seed}-{k2}", "_w2")
    return c.join(w2, k2).join(w1, [k1, "b"]).select(k1, k2, "b", (F.col("_w1") * F.col("_w2")).alias("w"))


def boot_summary(reps: DataFrame, by: list[str], value: str, mode: str = "linear") -> DataFrame:
    """Interval, standard error and number of valid replicates; the replicates are kept, as they are read several times."""
    reps = settings.cut(reps)
    a = reps.groupBy(*by).agg(F.count(value).alias("n_valid"), F.stddev_samp(value).alias("se"))
    q = quantiles(reps, by, value, {"low": 0.025, "high": 0.975}, mode)
    return a.join(q, by, "left") if by else beside(a, q)


def boot_ratio(stats: DataFrame, key: str, by: list[str], num: str, den: str, reps: int, seed: str = "1") -> DataFrame:
    """Replicates of a ratio of sums."""
    w = cluster_weights(stats, key, reps, seed)
    s = weighted_sums(stats, w, key, by, [num, den])
    return s.select(*by, "b", div(F.col(num).cast("double"), den).alias("value"))


def boot_metrics(cells: DataFrame, key: str, by: list[str], reps: int, seed: str = "1", key2: str | None = None) -> DataFrame:
    """Replicates of the confusion metrics, one-way or crossed."""
    if key2 is None:
        s = weighted_sums(cells.groupBy(key, *by).agg(*[F.sum(c).alias(c) for c in CELLS]), cluster_weights(cells, key, reps, seed), key, by, CELLS)
    else:
        s = two_way_sums(cells, key, key2, by, CELLS, reps, seed)
    return class_metrics(s)


def boot_rank(df: DataFrame, key: str, score: str, label: str, reps: int, seed: str = "1", mode: str = "lower") -> DataFrame:
    """Replicates of the median difference and of the AUC of wrong decisions.

    Rows with equal cluster, score and label are folded before they meet the weights.
    """
    d = df.where(F.col(score).isNotNull()).groupBy(key, score, label).agg(F.count(F.lit(1)).alias("_n"))
    x = d.join(cluster_weights(df, key, reps, seed), key).groupBy("b", score, label).agg(F.sum(F.col("_n") * F.col("w")).alias("_w"))
    wrong = x.withColumn("_wrong", 1 - F.col(label))
    a = auc(wrong, ["b"], score, "_wrong", F.col("_w")).select("b", "auc")
    return a.join(weighted_median_diff(x, ["b"], score, label, "_w", mode), "b", "full_outer")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(xtx, xty):
        p = len(b)
        m = np.asarray(a, dtype=float).reshape(p, p)
        out.append(np.linalg.lstsq(m, np.asarray(b, dtype=float), rcond=None)[0].tolist())
    return pd.Series(out)


def cross_products(df: DataFrame, by: list[str], x: list, y) -> DataFrame:
    """Sums of cross products per group: all that least squares needs."""
    p = len(x)
    aggs = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(x[i] * y).alias(f"y{i}") for i in range(p)]
    return df.groupBy(*by).agg(*aggs, F.sum(y * y).alias("yy"), F.count(F.lit(1)).cast("double").alias("nn"))


def product_columns(p: int) -> list[str]:
    return [f"x{i}_{j}" for i in range(p) for j in range(i, p)] + [f"y{i}" for i in range(p)] + ["yy", "nn"]


def solve_products(sums: DataFrame, p: int, out: str = "beta") -> DataFrame:
    """Coefficients from the sums, one small system per row."""
    at = lambda i, j: F.col(f"x{min(i, j)}_{max(i, j)}")
    xtx = F.array(*[at(i, j) for i in range(p) for j in range(p)])
    return sums.withColumn(out, _solve(xtx, F.array(*[F.col(f"y{i}") for i in range(p)])))


def boot_ols(df: DataFrame, key: str, x: list, y, reps: int, seed: str = "1") -> DataFrame:
    """Replicates of regression coefficients from per-cluster cross products."""
    p = len(x)
    st = cross_products(df, [key], x, y)
    s = weighted_sums(st, cluster_weights(df, key, reps, seed), key, [], product_columns(p))
    return solve_products(s, p).select("b", F.posexplode("beta").alias("term", "value"))


def boot_delta(cells: DataFrame, key: str, system: str, base: str, reps: int, seed: str = "1", by: list[str] | None = None) -> DataFrame:
    """Replicates of the differences to a base system, all systems under the same weights."""
    by = by or []
    m = boot_metrics(cells, key, [system, *by], reps, seed)
    cols = ["agree", "ba", "sens", "spec", "mcc"]
    b = m.where(F.col(system) == base).select("b", *by, *[F.col(c).alias(f"_{c}") for c in cols])
    j = m.where(F.col(system) != base).join(b, ["b", *by])
    return j.select(system, *by, "b", *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in cols])


def boot_mean(values: DataFrame, key: str, value: str, reps: int, seed: str = "1") -> DataFrame:
    """Replicates of the mean of one value per cluster."""
    v = values.where(F.col(value).isNotNull())
    j = v.join(cluster_weights(v, key, reps, seed), key)
    return j.groupBy("b").agg(div(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("value"))


def interval_report(points: DataFrame, reps: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Long table of estimates with intervals, one row per group and quantity."""
    frames = []
    for v in values:
        s = boot_summary(reps, by, v)
        pt = points.select(*by, F.lit(v).alias("quantity"), F.col(v).alias("estimate"))
        frames.append(pt.join(s, by, "left") if by else beside(pt, s))
    return reduce(DataFrame.unionByName, frames)
