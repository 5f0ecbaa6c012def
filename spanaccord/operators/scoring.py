"""Decision scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.aggregate import div
from spanaccord.operators.groups import beside
from spanaccord.operators.joins import compare_runs

CELLS = ["tp", "fn", "fp", "tn"]
# fixed values: devoiced marks, short voiced high vowels and vowels of both kinds
DEVOICED_MARKS = ("i̥", "ɯ̥")
VOICED_HIGH = ("i", "ɯ")
VOICED_VOWELS = ("a", "aː", "e", "eː", "i", "iː", "o", "oː", "ɯ", "ɯː", "ɨ", "ɨː")
DEVOICED_VOWELS = ("i̥", "ɯ̥", "ɨ̥")
VOICELESS_CLASSES = ("stop", "fricative", "affricate", "geminate_stop", "geminate_affricate")
VOICED_INITIALS = ("b", "d", "ɡ", "g", "z", "ʑ", "v", "ɟ")
VOICELESS_SYMBOLS = (
    "k", "t", "p", "c", "tʲ", "pʲ", "kː", "tː", "pː", "cː", "tʲː", "pʲː",
    "s", "ɕ", "h", "ç", "ɸ", "ɸʲ", "sː", "ɕː", "hː", "çː", "ɸː", "ɸʲː",
    "ts", "tɕ", "tsː", "tɕː",
)


def decide_variant(df: DataFrame, observed: str, applied: str, citation: str) -> DataFrame:
    """M1: which of the two variants the observed sequence equals, if any."""
    o = F.col(observed)
    return df.withColumn(
        "decision",
        F.when(o.isNull(), "missing")
        .when(F.col(applied) == F.col(citation), "undecidable")
        .when(o == F.col(applied), "applied").when(o == F.col(citation), "citation").otherwise("neither"),
    )


def confusion(df: DataFrame, by: list[str], human: str = "human", machine: str = "aligner", weight: Column | None = None) -> DataFrame:
    """M2: the four cells per group, optionally weighted."""
    w = F.lit(1).cast("long") if weight is None else weight
    zero = w * 0
    h, a = F.col(human) == 1, F.col(machine) == 1
    cond = {"tp": h & a, "fn": h & ~a, "fp": ~h & a, "tn": ~h & ~a}
    return df.groupBy(*by).agg(*[F.sum(F.when(c, w).otherwise(zero)).alias(n) for n, c in cond.items()])


def class_metrics(cells: DataFrame) -> DataFrame:
    """M3: rates from the four cells; null where a margin is empty."""
    d = cells.select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in CELLS])
    tp, fn, fp, tn = (F.col(f"_{c}") for c in CELLS)
    n = tp + fn + fp + tn
    sens, spec, hand = div(tp, tp + fn), div(tn, tn + fp), div(tp + fn, n)
    agree = div(tp + tn, n)
    base = F.greatest(hand, 1 - hand)
    mcc = div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return d.select(
        *cells.columns, n.alias("n"), agree.alias("agree"), hand.alias("hand"), div(tp + fp, n).alias("machine"),
        base.alias("base"), (agree - base).alias("over_base"), sens.alias("sens"), spec.alias("spec"),
        ((sens + spec) / 2).alias("ba"), mcc.alias("mcc"),
    )


def ref_category(label: Column, phone_class: Column) -> Column:
    """M4: devoiced by mark, voiced for a short high vowel, else null."""
    marked = F.arrays_overlap(F.split(label, " "), F.array(*[F.lit(x) for x in DEVOICED_MARKS]))
    return F.when(marked, "devoiced").when((phone_class == "vowel_short") & label.isin(*VOICED_HIGH), "voiced")


def hyp_category(error_type: Column, labels: Column, ref_label: Column) -> Column:
    """M5: machine category; null where it cannot be decided."""
    parts = F.split(labels, " ")
    has = lambda vals: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in vals]))
    fused = F.size(F.split(ref_label, " ")) > 1
    return (
        F.when(error_type == "omission", "devoiced").when(has(VOICED_VOWELS), "voiced")
        .when(has(DEVOICED_VOWELS), "devoiced").when(fused, "devoiced")
    )


def voiceless(phone_class: Column, label: Column) -> Column:
    """M8: does a unit start voiceless."""
    first = F.coalesce(F.element_at(F.split(F.trim(label), r"\s+"), 1), F.lit(""))
    voiced = F.lit(False)
    for x in VOICED_INITIALS:
        voiced = voiced | first.startswith(x)
    return F.coalesce(
        F.when(phone_class.isin(*VOICELESS_CLASSES), ~voiced)
        .when(phone_class.startswith("devoiced_fused"), first.isin(*VOICELESS_SYMBOLS)),
        F.lit(False),
    )


def voiceless_env(df: DataFrame, prev: tuple[str, str], nxt: tuple[str, str]) -> DataFrame:
    """M8: environment of a unit from the class and label of its two neighbours."""
    both = voiceless(F.col(prev[0]), F.col(prev[1])) & voiceless(F.col(nxt[0]), F.col(nxt[1]))
    return df.withColumn("env", F.when(both, "voiceless_both").otherwise("other"))


def competition(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """M7: do the variants of a word compete at a position, and how."""
    v = F.array_compact(F.array_sort(F.collect_set(value)))
    g = df.groupBy(*by).agg(v.alias("vals"))
    has = lambda x: F.array_contains("vals", x)
    comp = has("V") & (has("D") | has("A"))
    ctype = F.when(~comp, "").when(has("D") & has("A"), "mixed").when(has("D"), "symbol").otherwise("presence")
    return g.select(*by, F.array_join("vals", "").alias("vals"), F.when(comp, "competing").otherwise("lexical").alias("status"), ctype.alias("ctype"))


def kappa(cells: DataFrame) -> DataFrame:
    """M9: Cohen's kappa from the four cells."""
    d = cells.select("*", *[F.col(c).cast("double").alias(f"_{c}") for c in CELLS])
    tp, fn, fp, tn = (F.col(f"_{c}") for c in CELLS)
    n = tp + fn + fp + tn
    po = div(tp + tn, n)
    pe = div((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return d.select(*cells.columns, po.alias("observed"), pe.alias("expected"), div(po - pe, 1 - pe).alias("kappa"))


def mcnemar(cells: DataFrame) -> DataFrame:
    """McNemar chi-square with continuity correction from the discordant cells, and its p value.

    The p value uses the complementary error function, P(chi2_1 > x) = erfc(sqrt(x/2)).
    """
    b, c = F.col("fn").cast("double"), F.col("fp").cast("double")
    chi = div((F.abs(b - c) - 1) * (F.abs(b - c) - 1), b + c)
    return erfc_of(cells.withColumn("chi2", chi), F.sqrt(F.col("chi2") / 2), "p_chi2")


def _stirling_rest(m: Column) -> Column:
    """log(m!) less (m + 1/2) log m - m + log(2 pi) / 2: exact sums below 16, the series from there on."""
    x = F.greatest(m, F.lit(1)).cast("double")
    logs = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(m, F.lit(1)), F.lit(16)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    small = logs - (x + 0.5) * F.log(x) + x - math.log(2 * math.pi) / 2
    r = 1.0 / (x * x)
    return F.when(m < 16, small).otherwise((1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x)


def mcnemar_exact(cells: DataFrame) -> DataFrame:
    """Exact two-sided binomial p value, min(1, 2 * P(X <= min(b, c))), X ~ Bin(b + c, 1/2).

    The tail is a regularised incomplete beta function, I_1/2(n - k, k + 1): the chance of k itself times a
    continued fraction, whose number of steps grows with the square root of n.
    """
    k, n = F.least("fn", "fp").cast("long"), (F.col("fn") + F.col("fp")).cast("long")
    kd, nd = k.cast("double"), n.cast("double")
    u = (2 * kd - nd) / nd
    away = nd / 2 * (F.log1p(u) + F.log1p(-u) + u * (F.log1p(u) - F.log1p(-u)))
    chance = F.when(k == 0, F.exp(-nd * math.log(2.0))).otherwise(
        F.sqrt(nd / (2 * math.pi * kd * (nd - kd))) * F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - away)
    )
    a, b = nd - kd, kd + 1

    def step(rest: Column, i: Column) -> Column:
        m = i.cast("double")
        odd = -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m))
        return 1 + even / (1 + odd / rest)

    deep = (F.lit(64) + F.ceil(4 * F.sqrt(nd))).cast("int")
    rest = F.aggregate(F.sequence(deep, F.lit(1), F.lit(-1)), F.lit(1.0), step)
    tail = chance / 2 / (1 - (a + b) / (2 * (a + 1)) / rest)
    return cells.withColumn("p_exact", F.when((n == 0) | (2 * k == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def erfc_of(df: DataFrame, z: Column, name: str) -> DataFrame:
    """Complementary error function of a non-negative column (there is no such SQL function).

    Below 2 one less the series of positive terms, from 2 on the continued fraction.
    """
    start = F.struct(z.alias("term"), z.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["term"] * (2 * z * z / (2 * i + 1))
        return F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda acc: acc["sum"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * series
    far = F.exp(-z * z) / math.sqrt(math.pi) / F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda acc, i: z + i / (2 * acc))
    return df.withColumn(name, F.when(z < 2, near).otherwise(far))


def direction_by_cluster(df: DataFrame, cluster: str, by: list[str] | None = None) -> DataFrame:
    """Clusters with more misses than false hits, and the median difference."""
    from spanaccord.operators.quantile import medians

    by = by or []
    c = confusion(df, [*by, cluster]).withColumn("d", F.col("fn") - F.col("fp"))
    a = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("d") > 0).alias("more_misses"),
        F.count_if(F.col("d") < 0).alias("more_false_hits"), F.count_if(F.col("d") == 0).alias("equal"),
    )
    m = medians(c, by, "d", "median_diff")
    return a.join(m, by) if by else beside(a, m)


def verdict(report: DataFrame) -> DataFrame:
    """Flags read off the interval of a report row."""
    out = ~F.lit(0.5).between(F.col("low"), F.col("high"))
    v = F.when((F.col("estimate") > 0) & (F.col("low") > 0), "supported").when(F.col("estimate") > 0, "direction_only").otherwise("not_supported")
    return report.select("*", out.alias("excludes_half"), (F.col("estimate") < 0.02).alias("small_increment"), v.alias("verdict"))


def system_deltas(metrics: DataFrame, system: str, base: str, by: list[str] | None = None) -> DataFrame:
    """Differences of each system to a base system."""
    by = by or []
    cols = ["agree", "ba", "sens", "spec", "mcc"]
    b = metrics.where(F.col(system) == base).select(*by, *[F.col(c).alias(f"_{c}") for c in cols])
    o = metrics.where(F.col(system) != base)
    j = o.join(b, by) if by else beside(o, b)
    d = {c: F.col(c) - F.col(f"_{c}") for c in cols}
    return j.select(*by, system, *[v.alias(f"delta_{c}") for c, v in d.items()], (d["agree"] - d["ba"]).alias("delta_agree_minus_ba"))


def did(stats: DataFrame, condition: str, group: str, treated: tuple[str, str], groups: tuple[str, str], hit: str = "hit", n: str = "n") -> DataFrame:
    """Difference in differences of hit rates (condition change in one group minus the other)."""
    def rate(c, g):
        at = (F.col(condition) == c) & (F.col(group) == g)
        return div(F.sum(F.when(at, F.col(hit)).otherwise(0)).cast("double"), F.sum(F.when(at, F.col(n)).otherwise(0)))

    cells = {f"r_{c}_{g}": rate(c, g) for c in treated for g in groups}
    one = stats.agg(*[v.alias(k) for k, v in cells.items()])
    (c0, c1), (g0, g1) = treated, groups
    r = lambda c, g: F.col(f"r_{c}_{g}")
    return one.select("*", ((r(c1, g1) - r(c0, g1)) - (r(c1, g0) - r(c0, g0))).alias("did"))


def decision_changes(a: DataFrame, b: DataFrame, key: list[str], value: str, by: str) -> DataFrame:
    """Decisions that differ between two runs, overall and per type."""
    per = compare_runs(a, b, key, value, [by])
    cols = ["n_both", "flips", "to_one", "to_zero"]
    r = per.rollup(by).agg(*[F.sum(c).alias(c) for c in cols])
    return r.select(F.coalesce(by, F.lit("ALL")).alias("type"), *cols, div(F.col("flips").cast("double"), "n_both").alias("share"))
