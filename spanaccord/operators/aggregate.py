"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord.operators.groups import beside, join_groups
from spanaccord.operators.quantile import cell_quantiles, measure_cells, medians, quantiles
from spanaccord.operators.reshape import TOLERANCES_MS, evaluable_cond, first_reason, within
from spanaccord.settings import cut


def div(a, b) -> Column:
    """Division that gives null for a zero divisor."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def count_pivot(df: DataFrame, rows: list[str], col: str, values: list[str]) -> DataFrame:
    """G1: counts by rows with the values of ``col`` as columns, zero filled."""
    return df.groupBy(*rows).pivot(col, values).count().na.fill(0, values)


def error_summary(long: DataFrame, by: list[str], abs_err="abs_error_ms", err="error_ms") -> DataFrame:
    """Size, median, mean, signed mean, RMSE, MAD, 95 % quantile and tolerance rates."""
    e, s = F.col(abs_err), F.col(err)
    # the input is read once: everything else comes from how often each value occurs
    d = long.where(e.isNotNull()).groupBy(*by, e.cast("double").alias("_v"))
    cells = cut(d.agg(F.count(F.lit(1)).alias("_w"), F.sum(s).alias("_s"), F.count(s).alias("_m"))).withColumn("_k", F.lit("abs"))
    n, v, w = F.sum("_w"), F.col("_v"), F.col("_w")
    a = cells.groupBy(*by).agg(
        n.alias("n"), (F.sum(v * w) / n).alias("mean"), div(F.sum("_s"), F.sum("_m")).alias("signed_mean"),
        F.sqrt(F.sum(v * v * w) / n).alias("rmse"),
        *[(F.sum(c * w) * 100.0 / n).alias(t) for t, c in within(v, TOLERANCES_MS).items()],
    )
    q = cell_quantiles(cells, by, {"median": ("abs", 0.5), "p95": ("abs", 0.95)})
    far = join_groups(cells, q.select(*by, "median"), by).groupBy(*by, "_k", F.abs(v - F.col("median")).alias("_v")).agg(n.alias("_w"))
    return join_groups(join_groups(a, q, by), cell_quantiles(far, by, {"mad": ("abs", 0.5)}), by)


def with_totals(df: DataFrame, by: str, sums: list[str], group: Column | None = None) -> DataFrame:
    """Detail rows with a subtotal per ``group`` and a grand total."""
    g = F.lit("all") if group is None else group
    d = df.select(F.col(by).alias("item"), g.alias("grp"), *sums)
    r = d.groupBy("grp", "item").agg(*[F.sum(c).alias(c) for c in sums]).rollup("grp", "item").agg(
        F.grouping_id().alias("_g"), *[F.sum(c).alias(c) for c in sums]
    )
    level = F.when(F.col("_g") == 0, "detail").when(F.col("_g") == 1, "subtotal").otherwise("total")
    return r.select(level.alias("level"), F.coalesce("grp", F.lit("TOTAL")).alias("grp"), F.coalesce("item", F.lit("TOTAL")).alias("item"), *sums)


def rate_columns(df: DataFrame) -> DataFrame:
    """Matched, omitted and substituted units per evaluable and per all units, in percent."""
    m = F.col("displacement") + F.col("substitution")
    pct = lambda a, b: div(a * 100.0, F.col(b))
    return df.select(
        "*", m.alias("matched"), pct(m, "ref_evaluable").alias("pct_of_evaluable"), pct(m, "ref_all").alias("pct_of_all"),
        pct(F.col("omission"), "ref_evaluable").alias("pct_omitted"), pct(F.col("substitution"), "ref_evaluable").alias("pct_substituted"),
    )


def denominators(units: DataFrame, aln: DataFrame, by: str = "phone_class") -> DataFrame:
    """Reference counts and typed counts per class; insertions kept apart."""
    ref = units.groupBy(by).agg(F.count(F.lit(1)).alias("ref_all"), F.count_if(evaluable_cond()).alias("ref_evaluable"))
    typed = count_pivot(aln, [by], "error_type", ["displacement", "substitution", "omission", "insertion"])
    out = ref.join(typed, by, "full_outer")
    return rate_columns(out.na.fill(0))


def local_rate(units: DataFrame, keys=("file_id", "ipu_id")) -> DataFrame:
    """Non-excluded units per second of their window."""
    w = units.groupBy(*keys).agg(
        F.count_if(F.col("excluded_reason").isNull()).alias("n_units"), F.min("t_start").alias("_a"), F.max("t_end").alias("_b")
    )
    return w.where("n_units > 0").select(*keys, "n_units", div(F.col("n_units").cast("double"), F.col("_b") - F.col("_a")).alias("rate"))


def span_hours(units: DataFrame, by: list[str], span: list[str], start="w_start", end="w_end") -> DataFrame:
    """Total length of the distinct spans, in hours."""
    d = units.select(*by, *span, start, end).distinct()
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spans"), (F.sum(F.col(end) - F.col(start)) / 3600.0).alias("hours"))


def funnel(df: DataFrame, rules: list[tuple[Column, str]], subs: list[str] | None = None) -> DataFrame:
    """Rows per first failing rule, and sub-counts of what is left."""
    d = df.withColumn("step", F.coalesce(first_reason(rules), F.lit("included")))
    main = d.groupBy("step").agg(F.count(F.lit(1)).alias("n")).select("step", F.lit("").alias("factor"), F.lit("").alias("level"), "n")
    if not subs:
        return main
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in subs]))
    sub = d.where("step = 'included'").select("step", pairs.alias("p")).groupBy("step", "p.factor", "p.level").agg(F.count(F.lit(1)).alias("n"))
    return main.unionByName(sub)


def crosstab(df: DataFrame, cols: list[str]) -> DataFrame:
    """Contingency counts with the share of the grand total in percent."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*cols, "n", div(F.col("n") * 100.0, n.agg(F.sum("n")).scalar()).alias("pct"))


def by_conditions(df: DataFrame, conds: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """Mean and median of values under conditions that may overlap."""
    tags = F.explode(F.array(*[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in conds.items()]))
    d = df.select(tags.alias("condition"), *[v.alias(n) for n, v in values.items()])
    out = d.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 2).alias(f"{n}_mean") for n in values])
    q = cell_quantiles(measure_cells(d, ["condition"], {n: F.col(n) for n in values}), ["condition"], {f"{n}_median": (n, 0.5) for n in values})
    return join_groups(out, q.select("condition", *[F.round(f"{n}_median", 2).alias(f"{n}_median") for n in values]), ["condition"], "left")


def duration_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Medians of both durations and of the difference, its mean and sd."""
    d = df.withColumn("dur_diff_ms", F.col("dur_hand_ms") - F.col("dur_mfa_ms"))
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dur_diff_ms").alias("diff_mean"), F.stddev_samp("dur_diff_ms").alias("diff_sd"))
    cells = measure_cells(d, by, {"hand": F.col("dur_hand_ms"), "mfa": F.col("dur_mfa_ms"), "diff": F.col("dur_diff_ms")})
    return join_groups(a, cell_quantiles(cells, by, {f"{m}_median": (m, 0.5) for m in ("hand", "mfa", "diff")}), by, "left")


def pair_inventory(df: DataFrame, pair: list[str], speaker: str) -> DataFrame:
    """Tokens and distinct speakers per pair, most common first."""
    g = df.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(speaker).alias("n_speakers"))
    return g.orderBy(F.desc("n_tokens"), *pair)


def single_partner(df: DataFrame, key: list[str], partner: str) -> DataFrame:
    """Rows whose key has exactly one distinct partner."""
    one = df.groupBy(*key).agg(F.count_distinct(partner).alias("_k")).where("_k = 1").select(*key)
    return df.join(one, key, "left_semi")


def best_entry(df: DataFrame, key: list[str], prob: str, order: list[str], cols: list[str]) -> DataFrame:
    """Entry with the highest probability per key, the first on ties."""
    best = F.min_by(F.struct(prob, *cols), F.struct((-F.col(prob)).alias("_p"), *order)).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, "_b.*")


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact distinct counts."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def top_k_packed(df: DataFrame, by: list[str], a: str, b: str, k: int) -> DataFrame:
    """The k most frequent pairs per group as ``a>b:n;...``."""
    n = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), a, b)
    top = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    text = F.format_string("%s>%s:%d", F.col(a), F.col(b), F.col("n"))
    items = F.array_sort(F.collect_list(F.struct("_r", text.alias("t"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["t"]), ";").alias("top"))


def macro_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unweighted mean over groups, missing values left out."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def pool_weights(sample: DataFrame, pool: DataFrame, by: str) -> DataFrame:
    """Pool share over sample share, per category."""
    s = sample.groupBy(by).agg(F.count(F.lit(1)).alias("_s"))
    p = pool.groupBy(by).agg(F.count(F.lit(1)).alias("_p"))
    j = s.join(p, by)
    share = div(F.col("_p").cast("double"), p.agg(F.sum("_p")).scalar()) / div(F.col("_s").cast("double"), s.agg(F.sum("_s")).scalar())
    return j.select(by, share.alias("weight"))


def per_word_accuracy(df: DataFrame, word: str, correct: str, label: str, min_n: int) -> DataFrame:
    """Accuracy per word against the majority share of the word."""
    pw = df.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("acc"), F.avg(label).alias("_p"))
    pw = pw.where(F.col("n") >= min_n).withColumn("majority", F.greatest(F.col("_p"), 1 - F.col("_p")))
    q = quantiles(pw, [], "acc", {f"q{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    a = pw.agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"),
        div(F.sum(F.col("acc") * F.col("n")), F.sum("n")).alias("weighted_acc"),
        div(F.sum(F.col("majority") * F.col("n")), F.sum("n")).alias("weighted_majority"),
        F.avg((F.col("acc") < F.col("majority")).cast("int")).alias("share_below"),
    )
    return beside(a, q)


def word_rates(tokens: DataFrame, words: DataFrame, word: str, env: str, event: str, min_n: int = 5) -> DataFrame:
    """Event rate per word; the rate of its environment when the word is rare; clipped."""
    env_rate = tokens.groupBy(env).agg(F.avg(event).alias("_e"))
    word_rate = tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.avg(event).alias("_w"))
    j = words.join(word_rate, word, "left").join(env_rate, env, "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= min_n
    p = F.when(enough, F.col("_w")).otherwise(F.col("_e"))
    return j.select(
        *words.columns, F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, "word").otherwise("environment").alias("basis"),
        F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)).alias("p"),
    )


def variant_priors(df: DataFrame, key: list[str], value: str, p: str) -> DataFrame:
    """Product over positions of p for devoiced or absent and 1 - p for voiced."""
    f = F.when(F.col(value).isin("D", "A"), F.col(p)).when(F.col(value) == "V", 1 - F.col(p)).otherwise(F.lit(1.0))
    return df.groupBy(*key).agg(F.product(f).alias("prior"), F.count(F.lit(1)).alias("n_positions"))


def agreement_limits(df: DataFrame, diff: Column, by: list[str] | None = None) -> DataFrame:
    """Mean difference and mean +- 1.96 sd."""
    m, s = F.avg(diff), F.stddev_samp(diff)
    return df.groupBy(*(by or [])).agg(
        F.count(diff).alias("n"), m.alias("bias"), s.alias("sd"), (m - 1.96 * s).alias("lower"), (m + 1.96 * s).alias("upper")
    )


def coverage_by_outcome(df: DataFrame, outcome: str, coverage: Column) -> DataFrame:
    """Mean coverage per outcome."""
    return df.groupBy(outcome).agg(F.count(coverage).alias("n"), F.avg(coverage).alias("coverage"))


def run_mean_sd(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sd over the runs of a condition."""
    return runs.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def box_stats(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Quartiles and whiskers at 1.5 interquartile ranges."""
    cells = measure_cells(df, by, {"value": value})
    q = cell_quantiles(cells, by, {"q1": ("value", 0.25), "q2": ("value", 0.5), "q3": ("value", 0.75)})
    step = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - step, F.col("q3") + step)
    w = join_groups(cells, q, by).groupBy(*by).agg(
        F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.sum(F.when(inside, 0).otherwise(F.col("_w"))).alias("n_out")
    )
    return join_groups(q, w, by)


def _is_first(v: str):
    return lambda x: x["a"] == v


def lexicon_audit(lex: DataFrame, symbols: str, vowels: list[str], long_mark: str) -> DataFrame:
    """Entries, entries with a length mark, with a doubled vowel, and spots per vowel."""
    s = F.col(symbols)
    spots = F.filter(
        F.arrays_zip(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))).alias("a"), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("b")),
        lambda x: (x["a"] == x["b"]) & x["a"].isin(vowels),
    )
    d = lex.select(F.exists(s, lambda x: x.contains(long_mark)).alias("_long"), spots.alias("_spots"))
    head = d.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("_long").alias("with_length_mark"), F.count_if(F.size("_spots") > 0).alias("with_doubled_vowel"),
        *[F.sum(F.size(F.filter("_spots", _is_first(v)))).alias(f"spots_{v}") for v in vowels],
    )
    return head.unpivot([], head.columns, "quantity", "n")


def cluster_stats(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Hits and totals per cluster and group; all that rates and bootstraps need."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(n) for n, c in flags.items()])


def detection_rate(df: DataFrame, by: str, outcome: str, hit: str, decided: list[str]) -> DataFrame:
    """Share of decided rows with the wanted outcome, best first."""
    g = df.where(F.col(outcome).isin(decided)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(outcome) == hit).cast("int")).alias("detection_rate"))
    return g.orderBy(F.desc("detection_rate"), by)


def flag_share(df: DataFrame, by: list[str], flag: str, value: Column) -> DataFrame:
    """Share of a flag and mean of a value per category."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("int")).alias("share"), F.avg(value).alias("mean_value"))


def crossed_clusters(df: DataFrame, cluster: str, condition: str, at_least: int = 2) -> DataFrame:
    """Number of clusters seen under several conditions."""
    k = df.groupBy(cluster).agg(F.count_distinct(condition).alias("_k"))
    return k.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("_k") >= at_least).alias("n_crossed"))


def cluster_condition_medians(df: DataFrame, cluster: list[str], condition: str, values: list[str], value: str) -> DataFrame:
    """Median per cluster and condition, conditions as columns."""
    m = medians(df, [*cluster, condition], value, "_m")
    return m.groupBy(*cluster).pivot(condition, values).agg(F.first("_m"))


def window_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str = "") -> DataFrame:
    """Text of the ordered rows of a window, blanks left out."""
    d = df.where(F.trim(text) != "").select(*keys, *order, F.trim(text).alias("_t"))
    parts = F.array_sort(F.collect_list(F.struct(*order, "_t")))
    return d.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias("text"))


def merge_attributes(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Attributes of a merged run: first known accent type, any flag, last label as a number."""
    place = F.struct(*order)
    return runs.groupBy(*keys).agg(
        F.min_by("accent_type", F.when(F.col("accent_type").isNotNull(), place)).alias("accent_type"),
        F.bool_or("devoiced").alias("devoiced"), F.bool_or("tag_vlong").alias("tag_vlong"),
        F.max_by("label", place).try_cast("int").alias("last_label"), F.count(F.lit(1)).alias("merged_from"),
    )
