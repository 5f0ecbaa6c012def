"""Exact quantiles by rank selection.

The built-in exact ``percentile`` keeps a map of all distinct values of a group
in one task.  Here equal values are counted first, running counts come from
``scan`` (which splits hot groups), and only the rows that hold a wanted rank
leave the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.scan import _c, running_sum, scan, total
from spanaccord.settings import cut


def _ranked(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    """One row per (by, value) with weight w, running weight hi and total n."""
    cells = (
        df.select(*by, value.cast("double").alias("_v"), weight.alias("_w"))
        .where("_v is not null and _w > 0")
        .groupBy(*by, "_v")
        .agg(F.sum("_w").alias("_w"))
    )
    return scan(cells, by, ["_v"], {"_hi": running_sum("_w"), "_n": total("_w")})


def quantiles(
    df: DataFrame,
    by: list[str],
    value: Column | str,
    wanted: dict[str, float],
    mode: str = "linear",
    weight: Column | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per group, one column per entry of ``wanted``.

    ``linear``: position q*(n-1), linear between neighbours.
    ``index``: sorted[int(q*n)].  ``index1``: sorted[int(q*(n-1))].
    ``weight`` is an integer multiplicity per row (default 1).
    """
    r = _ranked(df, by, _c(value), F.lit(1).cast("long") if weight is None else weight.cast("long"))
    lo0 = F.col("_hi") - F.col("_w")
    aggs, outs = [], []
    hit = F.lit(False)
    for name, q in wanted.items():
        if mode == "index":
            pos = F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1).cast("double")
        elif mode == "index1":
            pos = F.floor(F.lit(q) * (F.col("_n") - 1)).cast("double")
        else:
            pos = F.lit(q) * (F.col("_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        in_low = (lo0 <= low) & (low < F.col("_hi"))
        in_high = (lo0 <= high) & (high < F.col("_hi"))
        hit = hit | in_low | in_high
        aggs += [
            F.max(F.when(in_low, F.col("_v"))).alias(f"_a_{name}"),
            F.max(F.when(in_high, F.col("_v"))).alias(f"_b_{name}"),
            F.max(pos - low).alias(f"_f_{name}"),
        ]
        a, b, f = F.col(f"_a_{name}"), F.col(f"_b_{name}"), F.col(f"_f_{name}")
        outs.append((a + (b - a) * f).alias(name))
    return r.where(hit).groupBy(*by).agg(*aggs).select(*by, *outs)


def measure_cells(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by, _k, _v, _w): how often each value of each measure occurs in a group, from one reading of ``df``.

    Null values are left out, null groups are groups.  The table is kept, as everything below reads it again.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), c.cast("double").alias("v")) for n, c in measures.items()]))
    long = df.select(*by, each.alias("_x")).select(*by, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v"))
    return cut(long.where("_v is not null").groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_w")))


def cell_quantiles(cells: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact linear quantiles of several measures in one pass over their cells: one row per group, null where a measure has no value.

    ``wanted`` maps an output column to (measure, quantile).
    """
    r = scan(cells, [*by, "_k"], ["_v"], {"_hi": running_sum("_w"), "_n": total("_w")})
    lo, hit, aggs, outs = F.col("_hi") - F.col("_w"), F.lit(False), [], []
    for name, (measure, q) in wanted.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        own = F.col("_k") == measure
        ends = [own & (lo <= at) & (at < F.col("_hi")) for at in (F.floor(pos), F.ceil(pos))]
        hit = hit | ends[0] | ends[1]
        aggs += [F.max(F.when(e, F.col("_v"))).alias(f"_{i}_{name}") for i, e in enumerate(ends)] + [F.max(F.when(own, pos - F.floor(pos))).alias(f"_f_{name}")]
        a, b = F.col(f"_0_{name}"), F.col(f"_1_{name}")
        outs.append((a + (b - a) * F.col(f"_f_{name}")).alias(name))
    return r.where(hit).groupBy(*by).agg(*aggs).select(*by, *outs)


def medians(df: DataFrame, by: list[str], value: Column | str, name: str = "median") -> DataFrame:
    return quantiles(df, by, value, {name: 0.5})


def weighted_median(
    df: DataFrame, by: list[str], value: Column | str, weight: Column | str, mode: str = "lower", name: str = "wmedian"
) -> DataFrame:
    """Weighted median.

    ``lower``: smallest value whose running weight reaches half of the total.
    ``average``: the mean with the next value when the half is met exactly.
    """
    r = _ranked(df, by, _c(value), _c(weight))
    half = F.col("_n") / 2
    lo = F.col("_hi") - F.col("_w")
    first = F.min(F.when(F.col("_hi") >= half, F.col("_v")))
    if mode == "lower":
        out = first
    else:
        out = (first + F.min(F.when(F.col("_hi") > half, F.col("_v")))) / 2
    return r.where((F.col("_hi") >= half) & (lo <= half)).groupBy(*by).agg(out.alias(name))
