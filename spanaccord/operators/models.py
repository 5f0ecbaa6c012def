"""Regression and classification helpers.

Least squares runs on sums of cross products: one partial aggregate over the
rows, then one small system per model.  The same sums per cluster serve the
bootstrap and the absorbed fixed effects.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanaccord import settings
from spanaccord.operators.aggregate import div
from spanaccord.operators.groups import beside, join_groups
from spanaccord.operators.resample import boot_mean, boot_summary, cross_products, product_columns
from spanaccord.operators.scan import known_cool, mark_cool

_FIT = T.StructType([
    T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType())), T.StructField("sigma2", T.DoubleType()),
])


@F.pandas_udf(_FIT)
def _ols(xtx: pd.Series, xty: pd.Series, yy: pd.Series, df: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, c, d in zip(xtx, xty, yy, df):
        p = len(b)
        m, v = np.asarray(a, float).reshape(p, p), np.asarray(b, float)
        inv = np.linalg.pinv(m, hermitian=True)
        beta = inv @ v
        s2 = float((c - beta @ v) / d) if d > 0 else math.nan
        rows.append((beta.tolist(), (inv * s2).ravel().tolist(), s2))
    return pd.DataFrame(rows, columns=["beta", "cov", "sigma2"])


def fit_products(sums: DataFrame, p: int, keep: list[str], absorbed: Column | None = None) -> DataFrame:
    """Coefficients, covariance and residual variance from sums of cross products."""
    at = lambda i, j: F.col(f"x{min(i, j)}_{max(i, j)}")
    xtx = F.array(*[at(i, j) for i in range(p) for j in range(p)])
    free = F.col("nn") - p - (F.lit(0) if absorbed is None else absorbed)
    f = sums.withColumn("_f", _ols(xtx, F.array(*[F.col(f"y{i}") for i in range(p)]), F.col("yy"), free.cast("double")))
    return f.select(*keep, F.col("nn").cast("long").alias("n"), "_f.beta", "_f.cov", "_f.sigma2")


def ols(df: DataFrame, x: list[Column], y: Column, names: list[str], by: list[str] | None = None) -> DataFrame:
    """L1: least squares; one row per term with its standard error."""
    by = by or []
    return terms(fit_products(cross_products(df.where(y.isNotNull()), by, x, y), len(x), by), names, by)


def ols_absorbed(df: DataFrame, x: list[Column], y: Column, names: list[str], effect: str) -> DataFrame:
    """L1: least squares with one fixed effect of many levels (speaker, talk).

    Per level only the sums of cross products are kept; the level means are
    taken out of them, so no row is joined back.
    """
    p = len(x)
    one = F.lit(1.0)
    st = cross_products(df.where(y.isNotNull()), [effect], [one, *x], y)
    n = F.col("x0_0")
    mean = lambda i: F.col(f"x0_{i}") / n
    ctr = [(F.col(f"x{i + 1}_{j + 1}") - F.col(f"x0_{i + 1}") * mean(j + 1)).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    ctr += [(F.col(f"y{i + 1}") - F.col(f"x0_{i + 1}") * F.col("y0") / n).alias(f"y{i}") for i in range(p)]
    ctr += [(F.col("yy") - F.col("y0") * F.col("y0") / n).alias("yy"), F.col("nn")]
    cols = product_columns(p)
    tot = st.select(*ctr).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("levels"))
    return terms(fit_products(tot, p, [], F.col("levels")), names, [])


def terms(fit: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    p = len(names)
    t = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return fit.select(*by, "n", "cov", F.posexplode("beta").alias("i", "estimate")).select(
        *by, t.alias("term"), "n", "estimate", F.sqrt(F.get("cov", F.col("i") * (p + 1))).alias("se")
    )


def paired_effect(df: DataFrame, hand: str, machine: str, x: list[Column], names: list[str]) -> DataFrame:
    """L2: model of the log ratio; its coefficients are the source-by-factor interactions of the stacked model."""
    return ols(df, x, F.log(F.col(machine)) - F.log(F.col(hand)), names)


def wald(fit: DataFrame, combos: dict[str, list[float]]) -> DataFrame:
    """Linear combinations of the coefficients with a 95 % interval and chi-square."""
    frames = []
    for name, w in combos.items():
        p = len(w)
        est = reduce(lambda a, b: a + b, [F.get("beta", F.lit(i)) * w[i] for i in range(p)])
        var = reduce(lambda a, b: a + b, [F.get("cov", F.lit(i * p + j)) * (w[i] * w[j]) for i in range(p) for j in range(p) if w[i] and w[j]])
        se = F.sqrt(var)
        frames.append(fit.select(
            F.lit(name).alias("combo"), est.alias("estimate"), se.alias("se"), (est - 1.96 * se).alias("low"), (est + 1.96 * se).alias("high"), div(est * est, var).alias("chi2"),
        ))
    return reduce(DataFrame.unionByName, frames)


def relative_shift(hand: DataFrame, machine: DataFrame) -> DataFrame:
    """Change of each coefficient from the human to the machine model, in percent of the human one."""
    j = hand.select("term", F.col("estimate").alias("hand_est")).join(machine.select("term", F.col("estimate").alias("machine_est")), "term")
    d = F.col("machine_est") - F.col("hand_est")
    return j.select("term", "hand_est", "machine_est", d.alias("est_diff"), div(d * 100.0, F.abs("hand_est")).alias("rel_shift_pct"))


def _t_cdf(t: float, v: float) -> float:
    """Student distribution function by Simpson's rule on the angle form of its integral."""
    a = math.atan2(abs(t), math.sqrt(v))
    n = 2000
    th = np.linspace(0.0, a, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    area = float((w * np.cos(th) ** (v - 1)).sum() * a / n / 3)
    const = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(const * area, t)


def _t_quantile(q: float, v: float) -> float:
    lo, hi = -1.0, 1.0
    while _t_cdf(lo, v) > q and lo > -1e300:
        lo *= 4
    while _t_cdf(hi, v) < q and hi < 1e300:
        hi *= 4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, v) < q else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _tq(q: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([_t_quantile(a, b) if b and b > 0 else None for a, b in zip(q, v)], dtype=float)


def welch(runs: DataFrame, group: str, value: str, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Welch interval of the difference of two groups of runs, and the equivalence bound.

    Everything up to the summary row is an aggregate; the t quantile is read per
    summary row.  The bound is the largest absolute end of the 90 % interval.
    """
    by = by or []
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = runs.groupBy(*by).agg(
        (m(a, F.avg) - m(b, F.avg)).alias("diff"), m(a, F.var_samp).alias("_va"), m(b, F.var_samp).alias("_vb"),
        m(a, F.count).alias("n_a"), m(b, F.count).alias("n_b"),
    )
    qa, qb = div(F.col("_va"), "n_a"), div(F.col("_vb"), "n_b")
    s = s.withColumn("se", F.sqrt(qa + qb)).withColumn(
        "df", div((qa + qb) * (qa + qb), div(qa * qa, F.col("n_a") - 1) + div(qb * qb, F.col("n_b") - 1))
    )
    t95, t90 = _tq(F.lit(0.975), F.col("df")), _tq(F.lit(0.95), F.col("df"))
    s = s.withColumn("_t", t95).withColumn("_u", t90)
    return s.select(
        *by, "n_a", "n_b", "diff", "se", "df", (F.col("diff") - F.col("_t") * F.col("se")).alias("low"), (F.col("diff") + F.col("_t") * F.col("se")).alias("high"),
        (F.abs("diff") + F.col("_u") * F.col("se")).alias("equivalence_bound"),
    )


def variance_components(df: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Variance between outer groups, between inner groups within them, and within.

    Moment estimates of a nested layout with unequal sizes.  With balanced data they
    agree with restricted likelihood.
    """
    cell = df.where(value.isNotNull()).groupBy(outer, inner).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    grp = cell.groupBy(outer).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    g = grp.agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum("k").alias("b"), F.count(F.lit(1)).alias("a"), F.sum("ss").alias("T1"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("T0"), F.sum(F.col("nn") / F.col("n")).alias("c1"), F.sum("nn").alias("c2"), F.sum(F.col("n") * F.col("n")).alias("c3"),
    )
    N, a, b = F.col("N"), F.col("a"), F.col("b")
    corr = F.col("S") * F.col("S") / N
    within = div(F.col("Q") - F.col("T1"), N - b)
    k1 = div(N - F.col("c1"), b - a)
    ms_inner = div(F.col("T1") - F.col("T0"), b - a)
    v_in = div(ms_inner - within, k1)
    k2, k3 = div(F.col("c1") - F.col("c2") / N, a - 1), div(N - F.col("c3") / N, a - 1)
    v_out = div(div(F.col("T0") - corr, a - 1) - within - k2 * v_in, k3)
    return g.select(N.cast("long").alias("n"), v_out.alias("var_outer"), v_in.alias("var_inner"), within.alias("var_within"))


def target_encode(df: DataFrame, word: str, y: str, fold: str, m: float = 5.0, test_fold=None) -> DataFrame:
    """L4: smoothed success rate of the word, from training rows only.

    Without ``test_fold`` every row is encoded from the other folds.  With it,
    training rows are encoded too, leaving out their own outcome.
    Sums over all rows minus the sums of the held-out fold give the training
    sums, so no row is copied per fold.
    """
    cell = df.groupBy(word, fold).agg(F.sum(y).alias("_k"), F.count(F.lit(1)).alias("_n"))
    per_word = cell.groupBy(word).agg(F.sum("_k").alias("_tk"), F.sum("_n").alias("_tn"))
    per_fold = cell.groupBy(fold).agg(F.sum("_k").alias("_fk"), F.sum("_n").alias("_fn"))
    tot = per_fold.agg(F.sum("_fk").alias("k"), F.sum("_fn").alias("n"))
    if test_fold is None:
        j = join_groups(df, cell.join(per_word, word), [word, fold], "left")
        g = per_fold.select(fold, div((tot.select("k").scalar() - F.col("_fk")).cast("double"), tot.select("n").scalar() - F.col("_fn")).alias("_g"))
        j = join_groups(j, g, [fold], "left")
        k, n = F.col("_tk") - F.col("_k"), F.col("_tn") - F.col("_n")
        return j.withColumn("p_word", (k + m * F.col("_g")) / (n + m)).drop("_k", "_n", "_tk", "_tn", "_g")
    train = cell.where(F.col(fold) != test_fold)
    s = train.groupBy(word).agg(F.sum("_k").alias("_k"), F.sum("_n").alias("_n"))
    g = train.agg(div(F.sum("_k").cast("double"), F.sum("_n"))).scalar()
    j = join_groups(df, s, [word], "left").withColumn("_g", g)
    own = F.col(fold) != test_fold
    k = F.coalesce("_k", F.lit(0)) - F.when(own, F.col(y)).otherwise(0)
    n = F.coalesce("_n", F.lit(0)) - F.when(own, 1).otherwise(0)
    return j.withColumn("p_word", (k + m * F.col("_g")) / (n + m)).drop("_k", "_n", "_g")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def design_columns(df: DataFrame, process: str, levels: list[str], score: Column) -> tuple[DataFrame, dict[str, list[str]]]:
    """L3: the table with the features of the four designs, and their names by design."""
    dummies = {f"_is{i}": (F.col(process) == v).cast("double") for i, v in enumerate(levels[1:], 1)}
    each = {f"_z{i}": (F.col(process) == v).cast("double") * score for i, v in enumerate(levels)}
    cols = {**dummies, "_z": score, **each}
    designs = {"process": [*dummies], "boundary": ["_z"], "process+boundary": [*dummies, "_z"], "process*boundary": [*dummies, *each]}
    return df.select("*", *[c.alias(n) for n, c in cols.items()]), designs


def _newton_sums(rows: DataFrame, places: dict[str, list[int]], beta: dict[tuple[str, int], np.ndarray]) -> dict[tuple[str, int], tuple[float, np.ndarray, np.ndarray]]:
    """Per design and training set: log likelihood, its gradient and the weighted cross products, in one pass over (_y, _f, _x0, ..).

    ``places`` tells the columns of a design among the features.  A task adds up its rows, so what is shuffled
    is one row of sums for each task and training set.
    """
    keys = sorted(beta)

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            read = lambda c: c.to_numpy(zero_copy_only=False)
            null = np.column_stack([read(c.is_null()) for c in batch.columns])
            f = read(batch.column(1).fill_null(0))
            x = np.column_stack([np.ones(batch.num_rows), *[read(c.fill_null(0)) for c in batch.columns[2:]]])
            y, known = read(batch.column(0).fill_null(0)), ~null[:, 0]
            for k, (design, out) in enumerate(keys):
                train = ~null[:, 1] & (f != out)
                if not train.any():
                    continue
                train &= ~null[:, [2 + i for i in places[design]]].any(axis=1)
                m, t, ok = x[train][:, [0, *[1 + i for i in places[design]]]], y[train], known[train]
                eta = m @ beta[keys[k]]
                with np.errstate(over="ignore"):
                    q = 1.0 / (1.0 + np.exp(-eta))
                like = t * eta - np.maximum(eta, 0.0) - np.log1p(np.exp(-np.abs(eta)))
                sums = [np.where(ok, like, 0.0).sum()], m.T @ np.where(ok, t - q, 0.0), ((m * (q * (1.0 - q))[:, None]).T @ m).ravel()
                got[k] = got.get(k, 0.0) + np.concatenate(sums)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.tolist() for v in got.values()], pa.list_(pa.float64()))], ["k", "v"])

    sums = rows.mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    flat: dict[int, dict[int, float]] = {}
    for row in sums.collect():
        flat.setdefault(row["k"], {})[row["i"]] = row["v"]
    out = {}
    for k, v in flat.items():
        p = len(beta[keys[k]])
        v = np.array([v[i] for i in range(1 + p + p * p)])
        out[keys[k]] = (float(v[0]), v[1 : p + 1], v[p + 1 :].reshape(p, p))
    return out


def fold_logits(
    df: DataFrame, label: str, fold: str, folds: list[int], designs: dict[str, list[str]], tol: float = 1e-10, most: int = 50
) -> dict[tuple[str, int], np.ndarray]:
    """Logistic coefficients (intercept first) of each design fitted without each fold, by Newton steps for all of them together.

    One pass over the rows a step; what comes back is one row of sums a design and fold.  ``df`` is read once a
    step, so the caller keeps it.  A step that lowers the likelihood is halved.  A fold is done when a step gains
    no more than ``tol`` of the log likelihood and a tenth, which also ends where the features part the classes; if
    one is not done after ``most`` steps, this is an error.  A fold that leaves no row to train on keeps zeros.
    """
    features = list(dict.fromkeys(c for cols in designs.values() for c in cols))
    places = {m: [features.index(c) for c in cols] for m, cols in designs.items()}
    rows = df.select(
        F.col(label).cast("double").alias("_y"), F.col(fold).cast("long").alias("_f"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
    )
    done: dict[tuple[str, int], np.ndarray] = {}
    beta = {(m, f): np.zeros(len(cols) + 1) for m, cols in designs.items() for f in folds}
    last: dict[tuple[str, int], tuple[float, np.ndarray]] = {}
    for _ in range(most):
        sums = _newton_sums(rows, places, beta)
        for f in [f for f in beta if f not in sums]:
            done[f] = beta.pop(f)
        for f, (like, g, h) in sums.items():
            if f in last and like < last[f][0] - tol * abs(last[f][0]):
                beta[f] = (beta[f] + last[f][1]) / 2
                continue
            if f in last and like - last[f][0] <= tol * (abs(like) + 0.1):
                done[f] = beta.pop(f)
                continue
            last[f] = (like, beta[f])
            beta[f] = beta[f] + np.linalg.lstsq(h, g, rcond=1e-12)[0]
        if not beta:
            return done
    raise ValueError(f"no convergence after {most} steps without folds {sorted(beta)}")


def grouped_cv_logits(df: DataFrame, label: str, fold: str, folds: list[int], designs: dict[str, list[str]]) -> DataFrame:
    """L3: out-of-fold probabilities ``p_<design>`` of one logistic model a design; rows of other folds are left out."""
    beta = fold_logits(df, label, fold, folds, designs)

    def prob(m: str, cols: list[str]) -> Column:
        eta = None
        for f in folds:
            b = [F.lit(float(v)) for v in beta[m, f]]
            one = reduce(lambda a, c: a + c, [v * F.col(c) for v, c in zip(b[1:], cols)], b[0])
            eta = F.when(F.col(fold) == f, one) if eta is None else eta.when(F.col(fold) == f, one)
        return 1.0 / (1.0 + F.exp(-eta))

    return df.where(F.col(fold).isin(folds)).select("*", *[prob(m, cols).alias(f"p_{m}") for m, cols in designs.items()])


def grouped_cv_logit(df: DataFrame, label: str, fold: str, folds: list[int], features: list[str]) -> DataFrame:
    """L3: the same for one design, as column ``p``."""
    return grouped_cv_logits(df, label, fold, folds, {"": features}).withColumnRenamed("p_", "p")


def _stacked(pred: DataFrame, designs: list[str], keep: list[str]) -> DataFrame:
    """One row per row and design: ``model``, its place in the list, and ``p``."""
    each = F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"`p_{m}`").alias("p")) for i, m in enumerate(designs)])
    return pred.select(*keep, F.inline(each))


def cluster_aucs(pred: DataFrame, designs: list[str], cluster: str, label: str) -> DataFrame:
    """AUC per cluster and design (``model``, its place in the list) of the columns ``p_<design>``.

    Where no cluster is hot its rows are shuffled once, before they are multiplied by the designs, and counted in
    order as they are: with ties, positives see ``_neg`` negatives up to them and negatives ``_pos`` positives, and
    the pairs won with half of the ties are half of (all pairs + sum of ``_neg`` - sum of ``_pos``).
    """
    from spanaccord.operators.rank import auc

    d = mark_cool(pred.select(cluster, label, *[f"`p_{m}`" for m in designs]), cluster)
    if not known_cool(d, [cluster]):
        return auc(_stacked(d, designs, [cluster, label]), [cluster, "model"], "p", label)
    d = d.repartition(settings.parts(d.sparkSession), cluster)
    one = lambda v: F.when(F.col(label) == v, F.lit(1)).otherwise(0).cast("long")
    rows = _stacked(d.withColumns({"_y": one(1), "_z": one(0)}), designs, [cluster, "_y", "_z"]).where("p is not null")
    upto = Window.partitionBy(cluster, "model").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumns({"_pos": F.sum("_y").over(upto), "_neg": F.sum("_z").over(upto)}).groupBy(cluster, "model").agg(
        F.sum("_y").alias("n_pos"), F.sum("_z").alias("n_neg"), F.sum(F.col("_y") * F.col("_neg") - F.col("_z") * F.col("_pos")).alias("_d"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return r.select(cluster, "model", "n_pos", "n_neg", div((pairs + F.col("_d")) / 2, pairs).alias("auc"))


def cv_gain(df: DataFrame, label: str, cluster: str, fold: str, folds: list[int], base: list[str], extra: list[str], reps: int, seed: str = "1") -> DataFrame:
    """Gain in the mean per-cluster AUC from adding features, with a cluster bootstrap."""
    pred = grouped_cv_logits(df, label, fold, folds, {"auc0": base, "auc1": [*base, *extra]})
    per = cluster_aucs(pred, ["auc0", "auc1"], cluster, label).where(F.col(cluster).isNotNull())
    per = per.groupBy(cluster).agg(*[F.max(F.when(F.col("model") == i, F.col("auc"))).alias(f"auc{i}") for i in (0, 1)], F.count("model").alias("_n"))
    both = settings.cut(per.where("_n = 2").drop("_n").withColumn("gain", F.col("auc1") - F.col("auc0")))
    ci = boot_summary(boot_mean(both, cluster, "gain", reps, seed), [], "value")
    point = both.agg(F.avg("auc0").alias("auc0"), F.avg("auc1").alias("auc1"), F.avg("gain").alias("gain"), F.count("gain").alias("n_clusters"))
    return beside(point, ci).withColumn("small_increment", F.col("gain") < 0.02)


def cv_reports(pred: DataFrame, designs: list[str], cluster: str, label: str, strata: list[str]) -> DataFrame:
    """L3: pooled, stratified and mean per-cluster AUC of the out-of-fold predictions ``p_<design>``, one row a design.

    Equal scores of a stratum are folded once for the pooled and the stratified value.
    """
    from spanaccord.operators.rank import auc, stratified_auc

    g = settings.cut(_stacked(pred, designs, [*strata, label]).groupBy("model", *strata, "p", label).agg(F.count(F.lit(1)).alias("n")))
    a = auc(g, ["model"], "p", label, F.col("n")).select("model", F.col("auc").alias("pooled_auc"))
    s = stratified_auc(g, strata, "p", label, ["model"], F.col("n")).select("model", F.col("auc").alias("stratified_auc"))
    c = cluster_aucs(pred, designs, cluster, label).groupBy("model").agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_used"))
    names = pred.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(m) for m in designs])).alias("model", "name"))
    one = names.join(a, "model", "left").join(s, "model", "left").join(c, "model", "left")
    return one.select("pooled_auc", "stratified_auc", "mean_auc", F.coalesce("n_used", F.lit(0).cast("long")).alias("n_used"), F.col("name").alias("model"))
