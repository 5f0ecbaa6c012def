"""Lookup joins and run comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.quantile import medians


def map_label(df: DataFrame, label_map: DataFrame, label: str = "label") -> DataFrame:
    """First row of the table wins; a miss gives class ``unknown``."""
    first = label_map.groupBy(F.col("source_label").alias(label)).agg(
        F.min_by(F.struct("machine_label", "category"), "ord").alias("_m")
    )
    return df.join(first, label, "left").select(
        *df.columns,
        F.coalesce("_m.machine_label", label).alias("mapped"),
        F.coalesce("_m.category", F.lit("unknown")).alias("category"),
    )


def map_reverse(df: DataFrame, label_map: DataFrame, label: str = "label") -> DataFrame:
    """Machine label to source label, last row wins."""
    last = label_map.groupBy(F.col("machine_label").alias(label)).agg(
        F.max_by(F.struct("source_label", "category"), "ord").alias("_m")
    )
    return df.join(last, label, "left").select(
        *df.columns, F.col("_m.source_label").alias("source_label"), F.col("_m.category").alias("category")
    )


def compatible(df: DataFrame, label_map: DataFrame, source: str, machine: str) -> DataFrame:
    """Is the pair of labels a row of the table."""
    pairs = label_map.select(F.col("source_label").alias(source), F.col("machine_label").alias(machine)).distinct()
    return df.join(pairs.withColumn("_y", F.lit(True)), [source, machine], "left").withColumn(
        "compatible", F.coalesce("_y", F.lit(False))
    ).drop("_y")


def join_units(aln: DataFrame, units: DataFrame, cols: list[str]) -> DataFrame:
    """Unit attributes on alignment rows; ``unit_found`` marks misses."""
    u = units.select(F.col("unit_id").alias("ref_unit_id"), *cols, F.lit(True).alias("_y"))
    return aln.join(u, "ref_unit_id", "left").withColumn("unit_found", F.coalesce("_y", F.lit(False))).drop("_y")


def join_id_list(aln: DataFrame, units: DataFrame, key: str, ids: str = "hyp_unit_ids") -> DataFrame:
    """Earliest start, latest end, and start of the first and end of the last id."""
    e = aln.select(key, F.posexplode(ids).alias("_p", "unit_id"))
    j = e.join(units.select("unit_id", "t_start", "t_end"), "unit_id")
    return j.groupBy(key).agg(
        F.min("t_start").alias("h_min"), F.max("t_end").alias("h_max"),
        F.min_by("t_start", "_p").alias("h_start"), F.max_by("t_end", "_p").alias("h_end"),
        F.count(F.lit(1)).alias("n_found"),
    )


def match_by_length(a: DataFrame, b: DataFrame, keys: list[str], id_col: str, len_a: str, len_b: str, order: str, tol: float = 0.01) -> DataFrame:
    """Partner with equal keys: the first within the tolerance, or the only one.

    ``order`` ranks the partners.  Copies are folded to one row per key and
    length on both sides before they meet, and lengths meet in cells one
    tolerance wide, so a key shared by very many rows never pairs them all.
    """
    per_len = b.groupBy(*keys, len_b).agg(F.min(order).alias("_o"))
    near = per_len.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(len_b) / tol) - 1, F.floor(F.col(len_b) / tol) + 1)))
    wanted = a.select(*keys, len_a).distinct().withColumn("_cell", F.floor(F.col(len_a) / tol))
    fit = (
        wanted.join(near, [*keys, "_cell"])
        .where(F.abs(F.col(len_a) - F.col(len_b)) < tol)
        .groupBy(*keys, len_a).agg(F.min("_o").alias("_fit"))
    )
    only = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_only"))
    j = a.join(only, keys).join(fit, [*keys, len_a], "left")
    return j.select(*keys, id_col, F.coalesce("_fit", F.when(F.col("_n") == 1, F.col("_only"))).alias("partner"))


def locate_word(items: DataFrame, words: DataFrame, keys: list[str], index: str, label: str) -> DataFrame:
    """The word at the given index if its label agrees, else the first equal label."""
    first = words.groupBy(*keys, F.col("word").alias(label)).agg(F.min("pos").alias("_first"))
    at = words.select(*keys, F.col("pos").alias(index), F.col("word").alias("_at"))
    j = items.join(at, [*keys, index], "left").join(first, [*keys, label], "left")
    return j.withColumn("found_pos", F.when(F.col("_at") == F.col(label), F.col(index)).otherwise(F.col("_first"))).drop("_at", "_first")


def shared_boundaries(pairs: DataFrame, tol: float = 0.0005) -> DataFrame:
    """Boundaries that two matched neighbours share, on one or both sides.

    ``pairs`` has ref_unit_id, t_start, h_start, h_end, prev_uid and prev_t_end.
    """
    prev = pairs.select(F.col("ref_unit_id").alias("prev_uid"), F.col("h_end").alias("prev_h_end"))
    j = pairs.join(prev, "prev_uid", "left")
    ref = F.coalesce(F.col("prev_h_end").isNotNull() & (F.abs(F.col("t_start") - F.col("prev_t_end")) <= tol), F.lit(False))
    both = ref & F.coalesce(F.abs(F.col("h_start") - F.col("prev_h_end")) <= tol, F.lit(False))
    return j.withColumn("prev_matched", F.col("prev_h_end").isNotNull()).withColumn("shared_ref", ref).withColumn("shared_both", both)


def vocab_intersect(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Size of two vocabularies and of their intersection."""
    m = a.select(col).distinct().withColumn("_a", F.lit(1)).join(b.select(col).distinct().withColumn("_b", F.lit(1)), col, "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return m.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), both.alias("n_both"), (both / F.nullif(F.count("_a"), F.lit(0))).alias("share"))


def patch_lexicon(base: DataFrame, new: DataFrame, key: str = "word") -> DataFrame:
    """Rows of the listed words replaced by new rows."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def exclude_used(df: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in another sample."""
    return df.join(used.select(*keys).distinct(), keys, "left_anti")


def compare_runs(a: DataFrame, b: DataFrame, key: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """Keys in both runs or one, and decisions changed to and from 1."""
    by = by or []
    left = a.select(*key, *by, F.col(value).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(*key, *by, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    j = left.join(right, [*key, *by], "full_outer")
    ia, ib = F.col("_ia").isNotNull(), F.col("_ib").isNotNull()
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return j.groupBy(*by).agg(
        n(ia & ib, "n_both"), n(ia & ~ib, "only_a"), n(~ia & ib, "only_b"),
        n((F.col("_a") == 0) & (F.col("_b") == 1), "to_one"), n((F.col("_a") == 1) & (F.col("_b") == 0), "to_zero"),
        n(F.col("_a") != F.col("_b"), "flips"),
    )


def common_keys(runs: list[DataFrame], key: str, status: str) -> DataFrame:
    """Keys seen in every run, with whether their status differs."""
    u = reduce(DataFrame.unionByName, [r.select(key, status, F.lit(i).alias("_r")) for i, r in enumerate(runs)])
    g = u.groupBy(key).agg(F.count_distinct("_r").alias("_k"), F.count_distinct(status).alias("_s"))
    return g.where(F.col("_k") == len(runs)).select(key, (F.col("_s") > 1).alias("differs"))


def first_by_priority(frames: list[DataFrame], key: list[str], value: list[str]) -> DataFrame:
    """Value of the first source that has the key."""
    u = reduce(DataFrame.unionByName, [f.select(*key, *value, F.lit(i).alias("_p")) for i, f in enumerate(frames)])
    best = F.min_by(F.struct(*value, F.col("_p").alias("source_rank")), F.struct("_p", *value)).alias("_b")
    return u.groupBy(*key).agg(best).select(*key, "_b.*")


def system_pairs(df: DataFrame, a: str, b: str, same: str = "system") -> DataFrame:
    """Every pair of the two lists of system names.

    The lists hold one entry per system, so they are gathered into one row and
    unfolded.
    """
    lists = df.agg(F.collect_set(a).alias("_a"), F.collect_set(b).alias("_b"))
    return lists.select(F.explode("_a").alias("system_a"), "_b").select("system_a", F.explode("_b").alias("system_b"))


def attach_variants(df: DataFrame, variants: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Variant columns by two keys; without a row the variant is not valid."""
    return df.join(variants, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def candidate_table(decisions: DataFrame, devs: DataFrame, variants: DataFrame, key: str = "cand_id") -> DataFrame:
    """Decisions with the median deviation of the word and of the site, and the safety flag.

    ``devs`` has one row per boundary: key, dev_ms and at_site.
    """
    word = medians(devs, [key], "dev_ms", "dev_word_ms")
    site = medians(devs.where("at_site"), [key], "dev_ms", "dev_site_ms")
    n = devs.groupBy(key).agg(F.count(F.lit(1)).alias("n_bound_word"), F.count(F.when(F.col("at_site"), 1)).alias("n_bound_site"))
    out = decisions.join(word, key, "left").join(site, key, "left").join(n, key, "left").join(variants, key, "left")
    zero = F.lit(0)
    return out.select(
        *decisions.columns, "dev_word_ms", "dev_site_ms",
        F.coalesce("n_bound_word", zero).alias("n_bound_word"), F.coalesce("n_bound_site", zero).alias("n_bound_site"),
        (F.coalesce("n_bound_word", zero) > 0).cast("int").alias("has_boundary"),
        F.coalesce("identity_safe", zero).alias("identity_safe"),
    )
