"""Sampling and splitting designs (D1-D8), all driven by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord import settings
from spanaccord.functions.hashing import h32, hex_hash
from spanaccord.operators.groups import join_groups
from spanaccord.operators.resample import cluster_index
from spanaccord.operators.scan import _c, number, scan, total

SALTS = 64
#: width of the cells of a hash of 32 bits, of which there are 1,024
HASH_CELL = 1 << 22


def cap_sample(df: DataFrame, strata: list[str], cap: int, key, seed: str = "1") -> DataFrame:
    """At most ``cap`` rows per stratum, chosen by hash.

    A row among the first of its stratum is among the first of its salt too, so
    a first cut runs per salt and spreads a large stratum over many tasks; the
    second cut then sees at most ``cap * SALTS`` rows of it.
    """
    h = hex_hash(seed, _c(key))
    d = df.withColumn("_h", h).withColumn("_k", _c(key)).withColumn("_salt", h32(seed, "salt", _c(key)) % SALTS)
    order = [F.col("_h"), F.col("_k")]
    a = d.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_salt").orderBy(*order))).where(F.col("_r") <= cap)
    b = a.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_r") <= cap)
    return b.drop("_h", "_k", "_salt", "_r")


def speaker_split(df: DataFrame, speaker: str, style: str, frac: float = 0.2, seed: str = "1") -> DataFrame:
    """Speakers to test or train inside strata of their combination of styles."""
    s = df.groupBy(speaker).agg(F.array_join(F.sort_array(F.collect_set(style)), "+").alias("stratum"))
    out = scan(
        s, ["stratum"], [hex_hash(seed, F.col(speaker)), speaker], {"_r": number(), "_n": total(F.lit(1).cast("long"))},
        split_on=h32(seed, F.col(speaker)),
    )
    return out.select(speaker, "stratum", F.when(F.col("_r") <= F.bround(F.col("_n") * frac), "test").otherwise("train").alias("split"))


def case_control(df: DataFrame, processes: list[str], cap: int, process="process", label="human", unit="utterance_id", key="cand_id", seed="1") -> DataFrame:
    """Negatives of each process up to ``cap``, then as many positives; one row per unit overall.

    A row beyond the cap leaves its unit free for later passes, so the passes
    run one after another.  Each pass keeps at most ``cap`` rows, hence the used
    units stay below ``2 * cap * len(processes)`` and may be broadcast.
    """
    used, out, got = None, None, {}
    for lab in (0, 1):
        for p in processes:
            n = cap if lab == 0 else got[p]
            if n == 0:
                if lab == 0:
                    got[p] = 0
                continue
            pool = df.where((F.col(process) == p) & (F.col(label) == lab))
            if used is not None:
                pool = pool.join(F.broadcast(used), unit, "left_anti")
            order = F.struct(hex_hash(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
            one = pool.groupBy(unit).agg(F.min_by(F.struct(*df.columns), order).alias("_x"), F.min(order).alias("_o"))
            picked = settings.cut(one.orderBy("_o").limit(n).select("_x.*"))
            got[p] = picked.count() if lab == 0 else got[p]
            out = picked if out is None else out.unionByName(picked)
            used = out.select(unit)
    return out


def balanced_draws(df: DataFrame, word: str, label: str, key, draws: int, seed: str = "1") -> DataFrame:
    """Per draw and word, as many rows of either class as the rarer class has.

    The hashes are counted in equal cells first: the running counts tell the cell in which the wanted number
    is reached.  Rows of lower cells are in, those of higher ones out, and only the rows of that cell are ranked,
    so no class of a word is sorted as a whole.
    """
    n = df.groupBy(word).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    n = n.select(F.col(word), F.least("_p", "_q").alias("_k")).where(F.col("_k") > 0).where(F.col(word).isNotNull())
    h = h32(seed, F.col("draw"), _c(key))
    d = join_groups(df, n, [word]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.withColumn("_h", h).withColumn("_key", _c(key)).withColumn("_cell", F.floor(F.col("_h") / HASH_CELL).cast("int"))
    by = ["draw", word, label]
    cells = d.groupBy(*by, "_k", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell")))
    edge = cells.where("_upto >= _k and _upto - _n < _k").select(*by, F.col("_cell").alias("_edge"), (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_left"))
    d = join_groups(d, edge, by, "left")
    inside = d.where("_edge is null or _cell < _edge")
    ranked = d.where("_cell = _edge").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_key")))
    both = inside.unionByName(ranked.where("_r <= _left").drop("_r"))
    return both.select(word, *[c for c in df.columns if c != word], "draw")


def spread_sample(df: DataFrame, category: str, kind: list[str], speaker: str, key, per_cat: int, seed: str = "1") -> DataFrame:
    """One row per type and speaker, least used speakers first, ``per_cat`` per category.

    The use of a speaker is stated as the rank of the row among the speaker's
    rows of the category, which needs no sequential counter.
    """
    h = F.struct(hex_hash(seed, _c(key)).alias("h"), _c(key).alias("k"))
    cols = [c for c in df.columns if c not in (category, *kind, speaker)]
    one = df.groupBy(category, *kind, speaker).agg(F.min_by(F.struct(*cols), h).alias("_x"), F.min(h).alias("_h"))
    r = scan(one, [category, speaker], ["_h"], {"use": number()}, split_on=h32(seed, F.col("_h.k")))
    salted = r.withColumn("_salt", h32("salt", F.col("_h.k")) % SALTS)
    a = salted.withColumn("_r", F.row_number().over(Window.partitionBy(category, "_salt").orderBy("use", "_h"))).where(F.col("_r") <= per_cat)
    b = a.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy("use", "_h"))).where(F.col("_r") <= per_cat)
    return b.select(category, *kind, speaker, "use", F.col("_r").alias("rank"), "_x.*")


def cross_half_rates(df: DataFrame, speaker: str, by: str, flag: str, seed: str = "1") -> DataFrame:
    """Rates per category estimated on one random half of the speakers for the other half."""
    idx = cluster_index(df.select(F.concat(F.lit(seed), F.col(speaker)).alias("_s"), speaker).distinct().select("_s"), "_s")
    half = idx.select(F.expr(f"substring(_s, {len(seed) + 1})").alias(speaker), F.when(F.col("idx") < F.ceil(F.col("n") / 2), "A").otherwise("B").alias("half"))
    r = df.join(half, speaker).groupBy("half", by).agg(F.count(F.lit(1)).alias("n"), F.avg(flag).alias("rate"))
    return r.select(F.when(F.col("half") == "A", "B").otherwise("A").alias("apply_to"), by, "n", "rate")


def grouped_folds(df: DataFrame, speaker: str, k: int | None = None) -> DataFrame:
    """Fold per speaker: leave one out, or k folds dealt in hash order."""
    idx = cluster_index(df, speaker)
    return idx.select(speaker, (F.col("idx") if k is None else F.col("idx") % k).alias("fold"))
