"""Projection, filter, predicate and reshape operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord.operators.groups import join_groups

TOLERANCES_MS = (10, 20, 25, 50)
MATCHED = ("displacement", "substitution")


def evaluable_cond() -> Column:
    return (
        F.col("excluded_reason").isNull()
        & (F.col("boundary_source_start") == "measured")
        & (F.col("boundary_source_end") == "measured")
    )


def evaluable(df: DataFrame) -> DataFrame:
    """Both ends measured and no exclusion reason."""
    return df.where(evaluable_cond())


def style_of(file_id: Column) -> Column:
    """Recording style from the first letter of the id."""
    return F.when(file_id.startswith("A"), "aps").when(file_id.startswith("R"), "read").otherwise("sps")


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id list."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def in_sets(df: DataFrame, **allowed: list[str]) -> DataFrame:
    """P5: every named column within its allowed values."""
    for c, vals in allowed.items():
        df = df.where(F.col(c).isin(vals))
    return df


def collapse_rare(df: DataFrame, col: str, n: int = 200, other: str = "other_rare") -> DataFrame:
    """Categories with fewer than ``n`` rows become one."""
    rare = df.groupBy(col).count().where(F.col("count") < n).select(col, F.lit(True).alias("_rare"))
    out = join_groups(df, rare, [col], "left")
    return out.withColumn(col, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(col))).drop("_rare")


def keep_frequent(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    return join_groups(df, df.groupBy(*cols).count().where(F.col("count") >= n).select(*cols), cols, "left_semi")


def keep_two_sided(df: DataFrame, cols: list[str], flag: str, n: int = 5) -> DataFrame:
    """Rows of groups with at least ``n`` positives and ``n`` negatives."""
    both = df.groupBy(*cols).agg(F.sum(flag).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return join_groups(df, both.where((F.col("_p") >= n) & (F.col("_n") - F.col("_p") >= n)).select(*cols), cols, "left_semi")


def with_errors(df: DataFrame) -> DataFrame:
    """Signed and absolute errors in ms of the outer edges."""
    on = (F.col("hyp_start") - F.col("t_start")) * 1000.0
    off = (F.col("hyp_end") - F.col("t_end")) * 1000.0
    return df.select(
        "*", on.alias("onset_error_ms"), off.alias("offset_error_ms"),
        F.abs(on).alias("abs_onset_ms"), F.abs(off).alias("abs_offset_ms"),
    )


def with_logs(df: DataFrame, err: str, hand: str, machine: str) -> DataFrame:
    """Log transforms of an error and of a pair of durations."""
    return df.select(
        "*",
        F.log(F.col(err) + 5.0).alias("log_err5"),
        F.log(F.col(err) + 1.0).alias("log_err1"),
        (F.log(F.col(machine)) - F.log(F.col(hand))).alias("dlog"),
    )


def to_boundary_long(aln: DataFrame) -> DataFrame:
    """P10: one row per boundary; omissions and insertions one row without error."""
    matched = F.col("error_type").isin(*MATCHED)
    pair = F.struct  # (boundary, error)
    both = F.array(
        pair(F.lit("onset").alias("boundary_type"), F.col("onset_error_ms").alias("error_ms")),
        pair(F.lit("offset").alias("boundary_type"), F.col("offset_error_ms").alias("error_ms")),
    )
    none = F.lit(None).cast("double").alias("error_ms")
    one = F.array(
        pair(F.when(F.col("error_type") == "insertion", "insertion_marker").otherwise("none").alias("boundary_type"), none)
    )
    cols = [c for c in aln.columns if c not in ("onset_error_ms", "offset_error_ms")]
    long = aln.select(*cols, F.explode(F.when(matched, both).otherwise(one)).alias("_b")).select(
        *cols, "_b.boundary_type", "_b.error_ms"
    )
    return long.where(~F.col("boundary_type").isin("onset", "offset") | F.col("error_ms").isNotNull()).withColumn(
        "abs_error_ms", F.abs("error_ms")
    )


def to_source_long(df: DataFrame, hand: str = "dur_hand_ms", machine: str = "dur_mfa_ms") -> DataFrame:
    """Human and machine measure as two rows with a ``source`` factor."""
    ids = [c for c in df.columns if c not in (hand, machine)]
    both = df.select(*ids, F.col(hand).alias("hand"), F.col(machine).alias("mfa"))
    return both.unpivot(ids, ["hand", "mfa"], "source", "dur_ms")


def within(err: Column, thresholds=TOLERANCES_MS) -> dict[str, Column]:
    """Inclusive tolerance flags."""
    return {f"within{t}": (F.abs(err) <= t).cast("int") for t in thresholds}


def zscore(df: DataFrame, col: str, by: list[str], train: Column | None = None, out: str = "z") -> DataFrame:
    """Z-score inside groups, with mean and sd of the training rows only."""
    x = F.col(col) if train is None else F.when(train, F.col(col))
    st = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    return join_groups(df, st, by, "left").withColumn(out, (F.col(col) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def most_frequent(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The most frequent value per group; ties go to the smaller name."""
    n = df.groupBy(*by, col).count()
    return n.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("count"), F.col(col))).alias(f"ref_{col}"))


def top_bottom(df: DataFrame, by: list[str], score: list[Column], k: int) -> DataFrame:
    """The first k and the last k rows of each group by ``score``.

    ``row_number() <= k`` is pushed below the shuffle, so each task sends at
    most k rows per group and end.
    """
    up = Window.partitionBy(*by).orderBy(*score)
    down = Window.partitionBy(*by).orderBy(*[s.desc() for s in score])
    first = df.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= k).withColumn("side", F.lit("bottom"))
    last = df.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= k).withColumn("side", F.lit("top"))
    return first.unionByName(last).withColumnRenamed("_r", "rank")


def drop_masked(df: DataFrame, keys: list[str], masked: Column) -> DataFrame:
    """Drop every window that has a masked row."""
    return df.join(df.where(masked).select(*keys).distinct(), keys, "left_anti")
