"""Neighbour and run operators (W1-W14), all on ``scan``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.operators.quantile import medians
from spanaccord.operators.scan import (
    first_after, lag, last_before, lead, max_before, number, running_sum, scan, total,
)

CLOSURE, GEMINATE, LONG, MORAIC_NASAL = "SclS", "Q", "H", "N"
VOWELS = ("a", "i", "u", "e", "o")
NASALS = ("m", "n", "ny", "my")
# fixed values: sounds that a preceding closure belongs to
STOP_AFFRICATE = (
    "k", "g", "t", "d", "b", "p", "kj", "gj", "ky", "gy", "ty", "dy", "py", "by", "gw", "kw", "c", "cj", "cy", "z",
)
IPU = ["file_id", "ipu_id"]
TIME = ["t_start", "unit_id"]


def next_class(df: DataFrame, keys=IPU, order=TIME, col="phone_class") -> DataFrame:
    """Class of the next unit of the window, ``final`` at its end."""
    out = scan(df, keys, order, {"_next": lead(col)})
    return out.withColumn("following_context", F.coalesce("_next", F.lit("final"))).drop("_next")


def prev_in_file(df: DataFrame) -> DataFrame:
    """Class and label of the unit before, over the whole file."""
    order = ["t_start", "unit_id", "phone_class", "label"]
    return scan(df, ["file_id"], order, {"prev_class": lag("phone_class"), "prev_label": lag("label")})


def prev_in_window(df: DataFrame) -> DataFrame:
    """Id and end of the unit before, only inside the same window."""
    return scan(df, IPU, ["t_start", "t_end", "unit_id"], {"prev_uid": lag("unit_id"), "prev_t_end": lag("t_end")})


def next_skipping(df: DataFrame, skip: list[str]) -> DataFrame:
    """Class and label of the next unit whose class is not skipped."""
    nxt = F.when(~F.col("phone_class").isin(skip), F.struct("phone_class", "label"))
    out = scan(df, IPU, TIME, {"_n": first_after(nxt)})
    return out.select(
        *[c for c in out.columns if c != "_n"], F.col("_n.phone_class").alias("next_class"), F.col("_n.label").alias("next_label")
    )


def absorb_marker(df: DataFrame, keys=IPU, order=TIME, sym: str = "sym") -> DataFrame:
    """A closure joins the stop after it, unless a geminate stands before it."""
    s = F.col(sym)
    a = scan(df, keys, order, {"_p": lag(s), "_n": lead(s)}, keep_piece=True)
    gone = (s == CLOSURE) & ~F.coalesce(F.col("_p") == GEMINATE, F.lit(False)) & F.coalesce(F.col("_n").isin(*STOP_AFFRICATE), F.lit(False))
    a = a.withColumn("_gone", gone)
    mark = F.when(F.col("_gone"), F.struct("t_start", "t_end"))
    b = scan(a, keys, order, {"_m": lag(mark)})
    return b.where(~F.col("_gone")).withColumn("burst_t", F.col("_m.t_end")).withColumn(
        "t_start", F.coalesce("_m.t_start", "t_start")
    ).drop("_p", "_n", "_gone", "_m")


def merge_runs(df: DataFrame, keys=IPU, order=TIME, sym: str = "sym") -> DataFrame:
    """Number the merged runs of each window in column ``run``.

    The rule that looks at the head of the run equals "the last symbol before
    this row that is no closure is a geminate".
    """
    s = F.col(sym)
    info = F.struct(s.alias("s"), F.col("is_vowel").alias("v"))
    a = scan(
        df, keys, order,
        {"_p": lag(info), "_h": last_before(F.when(s != CLOSURE, s))}, keep_piece=True,
    )
    p, pv = F.col("_p.s"), F.col("_p.v")
    merge = (
        ((s == LONG) & pv)
        | ((p == GEMINATE) & (s == CLOSURE))
        | ((p == CLOSURE) & (F.col("_h") == GEMINATE))
        | ((p == MORAIC_NASAL) & s.isin(*NASALS))
        | (F.col("devoiced") & F.col("is_vowel") & ~pv)
    )
    a = a.withColumn("_new", F.when(F.coalesce(merge, F.lit(False)), 0).otherwise(1).cast("long")).drop("_p", "_h")
    return scan(a, keys, order, {"run": running_sum("_new")}).drop("_new")


def merge_pairs(df: DataFrame, keys: list[str], order: list, link: Column, link_to: str) -> DataFrame:
    """Pairs taken from the left without overlap, numbered in ``pair``.

    ``link`` says whether a row may pair with the next one, whose ``link_to``
    value is available as ``_next``.  Inside a run of links the odd-ranked ones
    start a pair.
    """
    a = scan(df, keys, order, {"_next": lead(link_to), "_rn": number()}, keep_piece=True)
    a = a.withColumn("_link", F.coalesce(link, F.lit(False)))
    b = scan(a, keys, order, {"_stop": last_before(F.when(~F.col("_link"), F.col("_rn")))}, keep_piece=True)
    b = b.withColumn("_start", F.col("_link") & ((F.col("_rn") - F.coalesce("_stop", F.lit(0))) % 2 == 1))
    c = scan(b, keys, order, {"_second": lag("_start")}, keep_piece=True)
    c = c.withColumn("_head", F.when(F.coalesce("_second", F.lit(False)), 0).otherwise(1).cast("long"))
    return scan(c, keys, order, {"pair": running_sum("_head")}).drop("_next", "_rn", "_link", "_stop", "_start", "_second", "_head")


def inner_boundaries(runs: DataFrame, keys: list[str], order=TIME, eps: float = 1e-9) -> DataFrame:
    """Boundaries inside each merged run and where they come from."""
    run = [*keys, "run"]
    zero = F.abs(F.col("t_end") - F.col("t_start")) < eps
    nxt = F.struct(F.col("start_uncertain").alias("su"), zero.alias("z"))
    a = scan(
        runs.withColumn("_d", F.col("devoiced").cast("int")), run, order,
        {"_n": lead(nxt), "position": number(), "_dev": total("_d")},
    ).where(F.col("_n").isNotNull())
    derived = F.col("end_uncertain") | F.col("_n.su") | zero | F.col("_n.z")
    return a.select(
        *run, F.col("t_end").alias("t"), (F.col("position") - 1).alias("position"),
        F.when(~derived, "measured").when(F.col("_dev") > 0, "undeterminable").otherwise("derived").alias("source"),
    )


def word_position(df: DataFrame, keys=("file_id", "word"), order=TIME) -> DataFrame:
    """Zero-based position of a symbol in its word."""
    out = scan(df, list(keys), order, {"_r": number()})
    return out.withColumn("word_phone_index", F.col("_r") - 1).drop("_r")


def unit_ids(df: DataFrame, key: str = "file_id", order=TIME) -> DataFrame:
    """Id from the file and a running index."""
    out = scan(df, [key], order, {"_r": number()})
    return out.withColumn("new_id", F.format_string("%s_%04d", F.col(key), F.col("_r") - 1)).drop("_r")


def fill_gaps(df: DataFrame, keys: list[str], total_len: str, text: str) -> DataFrame:
    """Clip overlaps to the running end and fill the gaps with empty text.

    ``df`` has keys, start, end, text and the total length of its file.
    """
    d = df.select(*keys, F.greatest("start", F.lit(0.0)).alias("start"), F.least("end", total_len).alias("end"), text, total_len)
    d = d.where("end > start")
    s = scan(d, keys, ["start", "end", text], {"_cur": max_before("end")})
    s = s.withColumn("_cur", F.coalesce("_cur", F.lit(0.0))).withColumn("_s", F.greatest("start", "_cur")).where("end > _s")
    pieces = F.array_compact(
        F.array(
            F.when(F.col("_s") > F.col("_cur"), F.struct(F.col("_cur").alias("start"), F.col("_s").alias("end"), F.lit("").alias("text"))),
            F.struct(F.col("_s").alias("start"), F.col("end").alias("end"), F.col(text).alias("text")),
        )
    )
    inner = s.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.start", "p.end", "p.text")
    last = df.groupBy(*keys).agg(
        F.max(total_len).alias("end"),
        F.coalesce(F.max(F.when(F.least("end", total_len) > F.greatest("start", F.lit(0.0)), F.least("end", total_len))), F.lit(0.0)).alias("start"),
    ).where("end > start").select(*keys, "start", "end", F.lit("").alias("text"))
    return inner.unionByName(last)


def nearest_nonempty(df: DataFrame, keys: list[str], order: list, ids: str) -> DataFrame:
    """Last id before and first id after a row among rows with ids."""
    has = F.size(ids) > 0
    return scan(
        df, keys, order,
        {
            "prev_id": last_before(F.when(has, F.element_at(ids, -1))),
            "next_id": first_after(F.when(has, F.element_at(F.col(ids), 1))),
        },
    )


def concentration(df: DataFrame, col: str, shares=(0.5, 0.8, 0.9), top: int = 10) -> DataFrame:
    """Number of types that cover a share of the tokens; share of the top types.

    Types of one count form a cell, so what is ordered grows with the distinct counts, not with the types.
    """
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    cells = n.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("_neg", -F.col("n"))
    s = scan(cells, [], ["_neg"], {"cum": running_sum(F.col("n") * F.col("c")), "all": total(F.col("n") * F.col("c")), "rn": running_sum("c")})
    s = s.withColumn("before", F.col("cum") - F.col("n") * F.col("c")).withColumn("first", F.col("rn") - F.col("c"))

    def types(p: float) -> Column:
        want = F.lit(p) * F.col("all")
        k = F.greatest(F.ceil((want - F.col("before")) / F.col("n")), F.lit(1))
        k = F.when((k > 1) & (F.col("before") + (k - 1) * F.col("n") >= want), k - 1).otherwise(k)
        return F.min(F.when(F.col("cum") >= want, F.col("first") + k))

    return s.agg(
        *[types(p).cast("long").alias(f"types_{int(p * 100)}") for p in shares],
        (F.sum(F.greatest(F.least("c", F.lit(top) - F.col("first")), F.lit(0)) * F.col("n")) / F.max("all")).alias(f"top{top}_share"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_types"),
    )


def order_by_median(df: DataFrame, col: str, value) -> DataFrame:
    """Classes ranked by the median of a value."""
    return scan(medians(df, [col], value), [], ["median", col], {"rank": number()})
