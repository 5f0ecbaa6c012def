"""Validation and guards (V1-V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-9
SOURCES = ("measured", "derived", "undeterminable", "none")
REASONS = ("unmapped_label", "zero_duration", "fd_fused_geminate", "dict_error", "devoiced_no_duration")


def row_rules() -> dict[str, Column]:
    """V1: rules that a unit row breaks."""
    zero = F.abs(F.col("t_end") - F.col("t_start")) < EPS
    return {
        "end_before_start": F.col("t_end") < F.col("t_start"),
        "zero_length": zero & ~F.coalesce("zero_vot", F.lit(False)) & F.col("excluded_reason").isNull(),
        "burst_outside": ~F.col("burst_t").between(F.col("t_start"), F.col("t_end")),
        "concordance_only": (F.col("corpus") == "jsut") & (F.col("metric_type") == "accuracy"),
        "style_missing": (F.col("corpus") == "csj") & (F.col("style") == "na"),
        "merged_from": F.col("merged_from") < 1,
        "unknown_source": ~F.col("boundary_source_start").isin(*SOURCES) | ~F.col("boundary_source_end").isin(*SOURCES),
        "unknown_reason": F.col("excluded_reason").isNotNull() & ~F.col("excluded_reason").isin(*REASONS),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule and unit."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select("*", F.explode(found).alias("rule"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """V2: keys that occur more than once."""
    return df.groupBy(*key).count().where(F.col("count") > 1)


def require_accuracy(df: DataFrame, metric: str = "metric_type", corpus: str = "corpus") -> DataFrame:
    """V3: fail when a row that only shows concordance is read as accuracy."""
    bad = F.concat(F.lit("concordance rows cannot be aggregated as accuracy: "), F.col(corpus))
    return df.withColumn(
        metric, F.when(F.col(metric) == "accuracy", F.col(metric)).otherwise(F.raise_error(bad).cast("string"))
    )


def concordance_corpora(df: DataFrame, metric: str = "metric_type", corpus: str = "corpus") -> DataFrame:
    """V3 as a report: the offending corpora and their row counts."""
    return df.where(F.col(metric) != "accuracy").groupBy(corpus).count()


def unmapped_labels(df: DataFrame, label_map: DataFrame, label: str, source: str = "source_label") -> DataFrame:
    """V4: labels without a mapping, most frequent first."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.join(label_map.select(F.col(source).alias(label)).distinct(), label, "left_anti").orderBy(F.desc("n"), label)


def coverage_check(inputs: DataFrame, outputs: DataFrame, key: str, label: str, known: DataFrame, max_unknown=0.05, min_used=0.9) -> DataFrame:
    """V5: outputs against inputs, share of unknown symbols, share of symbols used."""
    lab = outputs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(
        known.select(label).distinct().withColumn("_k", F.lit(1)), label, "full_outer"
    )
    a = lab.agg(
        F.sum("n").alias("n_symbols"),
        F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"),
        F.sum("_k").alias("n_known"),
        F.count(F.when(F.col("_k").isNotNull() & F.col("n").isNotNull(), 1)).alias("n_used"),
    )
    one = a.select(
        "*",
        inputs.agg(F.count_distinct(key)).scalar().alias("n_inputs"),
        outputs.agg(F.count_distinct(key)).scalar().alias("n_outputs"),
    )
    unknown = F.col("n_unknown") / F.nullif("n_symbols", F.lit(0))
    used = F.col("n_used") / F.nullif("n_known", F.lit(0))
    return one.select(
        "n_inputs", "n_outputs", unknown.alias("share_unknown"), used.alias("share_used"),
        ((F.col("n_outputs") == F.col("n_inputs")) & (unknown <= max_unknown) & (used >= min_used)).alias("passed"),
    )
