"""Ordered scans (lag, lead, running sums, carried values) that survive hot keys.

A plain window sorts every key inside one task, so a file that holds a third of
the table is a third of the job in one task.  Here such keys are found by a
count, cut into equally filled pieces by quantiles of the ordering column, and
scanned piece by piece.  What a piece needs from its neighbours is one summary
row per piece; their number is bounded by ``settings.MAX_PARTS`` (times a small
factor), so that table is safe to broadcast whatever the input size.

Ordinary keys stay in piece 0 and take the plain window.  One count per key is
run first; where it finds no hot key the plan is the plain window alone, and the
key columns remember that (column metadata), so a later scan by the same or
finer keys does not count again.  Where hot keys exist, the rows are read
several times and are therefore checkpointed once per scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord import settings

PIECE = "_piece"


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column | None = None


def lag(expr) -> Spec:
    """Value of the row before."""
    return Spec("lag", _c(expr))


def lead(expr) -> Spec:
    """Value of the row after."""
    return Spec("lead", _c(expr))


def last_before(expr) -> Spec:
    """Last non-null value among the rows before."""
    return Spec("last_before", _c(expr))


def first_after(expr) -> Spec:
    """First non-null value among the rows after."""
    return Spec("first_after", _c(expr))


def running_sum(expr) -> Spec:
    """Sum of all rows up to and including this one."""
    return Spec("running_sum", _c(expr))


def running_xor(expr) -> Spec:
    """Exclusive or of all rows up to and including this one; nulls count as 0."""
    return Spec("running_xor", F.coalesce(_c(expr), F.lit(0).cast("long")))


def max_before(expr) -> Spec:
    """Maximum over the rows before."""
    return Spec("max_before", _c(expr))


def min_from(expr) -> Spec:
    """Minimum over this row and the rows after."""
    return Spec("min_from", _c(expr))


def number() -> Spec:
    """1-based row number."""
    return Spec("running_sum", F.lit(1).cast("long"))


def total(expr) -> Spec:
    """Sum over all rows of the key."""
    return Spec("total", _c(expr))


def lowest(expr) -> Spec:
    """Minimum over all rows of the key."""
    return Spec("lowest", _c(expr))


def highest(expr) -> Spec:
    """Maximum over all rows of the key."""
    return Spec("highest", _c(expr))


def _c(expr) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def with_pieces(df: DataFrame, keys: list[str], split_on: Column | str, recheck: bool = False) -> DataFrame:
    """Add ``_piece``: 0 for ordinary keys, 1..k in order of ``split_on`` for hot ones.

    A key is hot when it holds more than one share of the table
    (``rows / parts``) and more than ``spark.spanaccord.hotRows`` rows.  Rows with
    equal ``split_on`` always share a piece.  ``recheck`` counts even where an
    earlier scan found no hot key (after a union or a join that adds rows).
    """
    if not recheck and known_cool(df, keys):
        return df.select("*", no_piece())
    spark = df.sparkSession
    parts, floor = settings.parts(spark), settings.hot_rows(spark)
    split_on = _c(split_on)
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n"))
    seen = sized.agg(F.max("_hot_n").alias("top"), F.sum("_hot_n").alias("rows")).first()
    if seen.top is None or seen.top <= max(floor, seen.rows / parts):
        return df.select("*", no_piece())
    df = settings.cut(df)
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n"))
    share = sized.agg(F.greatest(F.sum("_hot_n") / F.lit(float(parts)), F.lit(float(floor)))).scalar()
    hot = sized.withColumn("_hot_share", share).where("_hot_n > _hot_share")
    marks = [i / parts for i in range(1, parts)]
    if keys:
        rows = df.join(F.broadcast(hot), keys)          # fewer than `parts` hot keys exist
    else:
        rows = df.withColumn("_hot_n", sized.scalar()).withColumn("_hot_share", share).where("_hot_n > _hot_share")
    cuts = (
        rows.groupBy(*keys)
        .agg(
            F.percentile_approx(split_on.cast("double"), marks, 10 * parts).alias("_hot_q"),
            F.ceil(F.max(F.col("_hot_n") / F.col("_hot_share"))).alias("_hot_k"),
        )
        # keep about k of the marks: all hot keys together keep at most 2 * parts of them
        .withColumn(
            "_hot_cuts",
            F.expr(f"filter(_hot_q, (x, i) -> floor((i + 1) * _hot_k / {parts}) > floor(i * _hot_k / {parts}))"),
        )
        .select(*keys, "_hot_cuts")
    )
    at = split_on.cast("double")
    if keys:
        out = df.join(F.broadcast(cuts), keys, "left")
    else:
        out = df.withColumn("_hot_cuts", cuts.select("_hot_cuts").scalar())
    piece = F.when(F.col("_hot_cuts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_hot_cuts", lambda c: c < at)) + 1
    )
    return out.withColumn(PIECE, piece.cast("int")).drop("_hot_cuts")


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    specs: dict[str, Spec],
    split_on: Column | str | None = None,
    keep_piece: bool = False,
    recheck: bool = False,
) -> DataFrame:
    """Add one column per spec, computed along ``order`` inside ``keys``.

    ``split_on`` is the numeric column that leads the order (default: the first
    order column).  If ``_piece`` is already there it is reused.
    """
    order = [_c(o) for o in order]
    if PIECE not in df.columns:
        df = with_pieces(df, keys, order[0] if split_on is None else split_on, recheck)
    if not is_split(df):
        return _plain(df, keys, order, specs, keep_piece)
    df = settings.cut(df)
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ordered = Window.partitionBy(*keys, PIECE).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    after = ordered.rowsBetween(1, Window.unboundedFollowing)
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys, PIECE)

    across = Window.partitionBy(*keys).orderBy(PIECE)
    across_before = across.rowsBetween(Window.unboundedPreceding, -1)
    across_after = across.rowsBetween(1, Window.unboundedFollowing)
    across_all = Window.partitionBy(*keys)

    summaries, carries, joins, local = [], [], [], []
    for name, s in specs.items():
        m, c = f"_m_{name}", f"_c_{name}"
        if s.kind == "lag":
            summaries.append(F.max_by(F.struct(s.expr.alias("v")), place).alias(m))
            carries.append(F.lag(f"{m}.v").over(across).alias(c))
            first = F.row_number().over(ordered) == 1
            joins.append(F.when(F.col(f"_f_{name}"), F.col(c)).otherwise(F.col(f"_l_{name}")).alias(name))
            local += [(f"_l_{name}", F.lag(s.expr).over(ordered)), (f"_f_{name}", first)]
        elif s.kind == "lead":
            summaries.append(F.min_by(F.struct(s.expr.alias("v")), place).alias(m))
            carries.append(F.lead(f"{m}.v").over(across).alias(c))
            ended = F.lead(F.lit(1)).over(ordered).isNull()
            joins.append(F.when(F.col(f"_f_{name}"), F.col(c)).otherwise(F.col(f"_l_{name}")).alias(name))
            local += [(f"_l_{name}", F.lead(s.expr).over(ordered)), (f"_f_{name}", ended)]
        elif s.kind == "last_before":
            summaries.append(F.max_by(s.expr, F.when(s.expr.isNotNull(), place)).alias(m))
            carries.append(F.last(m, ignorenulls=True).over(across_before).alias(c))
            local.append((f"_l_{name}", F.last(s.expr, ignorenulls=True).over(before)))
            joins.append(F.coalesce(f"_l_{name}", c).alias(name))
        elif s.kind == "first_after":
            summaries.append(F.min_by(s.expr, F.when(s.expr.isNotNull(), place)).alias(m))
            carries.append(F.first(m, ignorenulls=True).over(across_after).alias(c))
            local.append((f"_l_{name}", F.first(s.expr, ignorenulls=True).over(after)))
            joins.append(F.coalesce(f"_l_{name}", c).alias(name))
        elif s.kind == "running_sum":
            summaries.append(F.sum(s.expr).alias(m))
            carries.append(F.sum(m).over(across_before).alias(c))
            local.append((f"_l_{name}", F.sum(s.expr).over(upto)))
            joins.append(
                F.when(F.col(c).isNull(), F.col(f"_l_{name}"))
                .otherwise(F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.col(c))
                .alias(name)
            )
        elif s.kind == "running_xor":
            summaries.append(F.bit_xor(s.expr).alias(m))
            carries.append(F.bit_xor(m).over(across_before).alias(c))
            local.append((f"_l_{name}", F.bit_xor(s.expr).over(upto)))
            joins.append(F.col(f"_l_{name}").bitwiseXOR(F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(name))
        elif s.kind == "max_before":
            summaries.append(F.max(s.expr).alias(m))
            carries.append(F.max(m).over(across_before).alias(c))
            local.append((f"_l_{name}", F.max(s.expr).over(before)))
            joins.append(F.greatest(f"_l_{name}", c).alias(name))
        elif s.kind == "min_from":
            summaries.append(F.min(s.expr).alias(m))
            carries.append(F.min(m).over(across_after).alias(c))
            local.append((f"_l_{name}", F.min(s.expr).over(onward)))
            joins.append(F.least(f"_l_{name}", c).alias(name))
        elif s.kind == "total":
            summaries.append(F.sum(s.expr).alias(m))
            carries.append(F.sum(m).over(across_all).alias(c))
            local.append((f"_l_{name}", F.sum(s.expr).over(whole)))
            joins.append(F.coalesce(c, f"_l_{name}").alias(name))
        elif s.kind in ("lowest", "highest"):
            of = F.min if s.kind == "lowest" else F.max
            summaries.append(of(s.expr).alias(m))
            carries.append(of(m).over(across_all).alias(c))
            local.append((f"_l_{name}", of(s.expr).over(whole)))
            joins.append(F.coalesce(c, f"_l_{name}").alias(name))
        else:
            raise ValueError(s.kind)

    carry = (
        df.where(F.col(PIECE) > 0).groupBy(*keys, PIECE).agg(*summaries).select(*keys, PIECE, *carries)
    )
    body = df.select("*", *[e.alias(n) for n, e in local])
    joined = body.join(F.broadcast(carry), [*keys, PIECE], "left")
    kept = [c for c in df.columns if c not in specs and (keep_piece or c != PIECE)]
    return joined.select(*kept, *joins)


def known_cool(df: DataFrame, keys: list[str]) -> bool:
    """Did an earlier scan find no hot key for a part of these keys."""
    have = set(keys)
    return any(set(c.split(",")) <= have for k in keys if k in df.columns for c in df.schema[k].metadata.get("cool", []))


def mark_cool(df: DataFrame, key: str) -> DataFrame:
    """Let ``key`` remember that it is not hot, where a count of the rows shows it.

    Meant for rows that are folded by this and finer keys before the scan: a fold has no more rows than were
    counted here, so it need not be made twice.
    """
    spark = df.sparkSession
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if top is not None and top > settings.hot_rows(spark):
        return df
    meta = dict(df.schema[key].metadata)
    meta["cool"] = sorted({*meta.get("cool", []), key})
    return df.select(*[F.col(key).alias(key, metadata=meta) if c == key else F.col(f"`{c}`") for c in df.columns])


def no_piece() -> Column:
    """The piece column of a table known to have no hot key."""
    return F.lit(0).alias(PIECE, metadata={"split": False})


def is_split(df: DataFrame) -> bool:
    """False when no hot key was found and the piece is a constant."""
    return df.schema[PIECE].metadata.get("split", True)


def _plain(df, keys, order, specs, keep_piece) -> DataFrame:
    """The same scans as ordinary windows."""
    w = Window.partitionBy(*(keys or [PIECE])).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    made = {
        "lag": lambda e: F.lag(e).over(w),
        "lead": lambda e: F.lead(e).over(w),
        "last_before": lambda e: F.last(e, ignorenulls=True).over(before),
        "first_after": lambda e: F.first(e, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "running_sum": lambda e: F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "running_xor": lambda e: F.bit_xor(e).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "max_before": lambda e: F.max(e).over(before),
        "min_from": lambda e: F.min(e).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "total": lambda e: F.sum(e).over(Window.partitionBy(*(keys or [PIECE]))),
        "lowest": lambda e: F.min(e).over(Window.partitionBy(*(keys or [PIECE]))),
        "highest": lambda e: F.max(e).over(Window.partitionBy(*(keys or [PIECE]))),
    }
    kept = [c for c in df.columns if c not in specs and (keep_piece or c != PIECE)]
    out = df.select(*kept, *[made[s.kind](s.expr).alias(n) for n, s in specs.items()])
    if not keys or keys[0] not in kept:
        return out
    # renamed above the windows: below them the rows would count as dealt by another column and be dealt again
    meta = dict(df.schema[keys[0]].metadata)
    meta["cool"] = sorted({*meta.get("cool", []), ",".join(keys)})
    return out.select(*[F.col(c).alias(c, metadata=meta) if c == keys[0] else F.col(f"`{c}`") for c in out.columns])
