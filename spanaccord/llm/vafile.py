"""Operator 1: exact top-k inner product search over a vector-approximation file."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import LongType

from spanaccord.llm.common import cut


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; beyond 64 bits the nearest bound."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


@arrow_udf(LongType())
def inner(left: pa.Array, right: pa.Array) -> pa.Array:
    """Exact inner products of vectors of whole numbers, row by row; beyond 64 bits the nearest bound."""
    starts = left.offsets.to_numpy()
    a, b = (v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for v in (left, right))
    sizes, starts = np.diff(starts), starts[:-1] - starts[0]
    reach = np.abs(a.astype(np.float64)).max(initial=0.0) * np.abs(b.astype(np.float64)).max(initial=0.0) * sizes.max(initial=0)
    out = np.zeros(len(sizes), dtype=np.int64)
    some = sizes > 0
    if reach < 2.0**62:
        if some.any():
            out[some] = np.add.reduceat(a * b, starts[some])
    else:
        whole = a.astype(object) * b.astype(object)
        out[:] = [min(max(int(whole[i : i + n].sum()), -(2**63) + 1), 2**63 - 1) if n else 0 for i, n in zip(starts, sizes)]
    return pa.array(out)


def _sound(embedding: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


def _pack(v: Column, width: int) -> Column:
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2 * width, "0")), ""))


def approximate(vectors: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The approximation file: (dims, cid, cells binary), one byte a component, and the cells' (dims, low, width).

    Every dimension is cut into 2**bits equal cells between its least and greatest value over all vectors.
    """
    per = vectors.select(F.size("v").alias("dims"), F.posexplode("v").alias("i", "x")).groupBy("dims", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
    width = F.greatest(F.lit(1.0), F.ceil((high - low + 1) / (1 << bits)).cast("double"))
    marks = per.groupBy("dims").agg(F.sort_array(F.collect_list(F.struct("i", low.alias("lo"), width.alias("w")))).alias("m"))
    marks = cut(marks.select("dims", F.transform("m", lambda m: m["lo"]).alias("low"), F.transform("m", lambda m: m["w"]).alias("width")))
    cell = F.transform("v", lambda x, i: F.floor((x - F.get(F.col("low"), i)) / F.get(F.col("width"), i)))
    placed = vectors.withColumn("dims", F.size("v")).join(F.broadcast(marks), "dims")
    return placed.select("dims", "cid", _pack(cell, 1).alias("cells")), marks


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, candidate_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the greatest inner product for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``; the result is (query_id, rank, vec_id, score), rank from 1, ties
    to the smaller vec_id.  Rows with a null vec_id, a null vector or a null or non-finite component take no
    part; only vectors of the query's length are compared; an empty vector scores 0.  Rows with the query's
    own vec_id are not candidates.  Rows equal in vec_id and vector count once; of different vectors with one
    query id the least asks.  Components are exact to 64 bits and stand at the nearest bound beyond, and so do scores.

    Equal vectors are folded to a class that keeps its k+1 least ids, which is all a result can hold.  The
    scan reads cells in blocks of candidates and queries and bounds every score from both sides; a candidate
    goes on only if its upper bound reaches the k-th best lower bound.  Exact vectors are then read in the
    order of the upper bounds: the k best first, then those whose bound still reaches the k-th exact score,
    after which the k-th result is certain.
    """
    sound = lambda df: df.where(_sound(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = sound(vectors).distinct().withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "v", "ids"))
    asked = cut(sound(queries).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id"))
    n, m = classes.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))

    cells, marks = approximate(classes, bits)
    file = cells.join(F.broadcast(marks), "dims").select(F.pmod(F.xxhash64("cid"), F.lit(c_blocks)).alias("c"), "dims", F.lit(0).alias("side"), F.col("cid").alias("id"), F.col("cells").alias("data"), "low", "width")
    file = file.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    ask = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q"), F.size("q").alias("dims"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("vector"))
    ask = ask.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "cid": [], "lower": [], "upper": []}).astype({"query_id": "int64", "cid": "int64", "lower": "float64", "upper": "float64"})
        if not len(left) or not len(right):
            return none
        low, width = (np.array(left[n].iloc[0], dtype=np.float64) for n in ("low", "width"))
        dims = len(low)
        cell = np.frombuffer(b"".join(left["data"]), dtype=np.uint8).reshape(len(left), dims)
        lo = low + cell * width
        hi = lo + width - 1
        q = np.array(right["vector"].tolist(), dtype=np.float64).reshape(len(right), dims)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # doubles are exact to 2**53; beyond, leave room for rounding
        slack = (np.abs(q) @ np.maximum(np.abs(lo).max(0), np.abs(hi).max(0)) * 2.0**-44 if dims else np.zeros(len(q)))
        slack = np.where(slack < 2.0**-2, 0.0, slack)[:, None]
        upper = up @ hi.T + down @ lo.T + slack
        lower = up @ lo.T + down @ hi.T - slack
        own = right["id"].to_numpy()[:, None]
        # a class that may hold only the query itself must not raise the floor
        solo = left["alone"].to_numpy()[None, :] & (left["least"].to_numpy()[None, :] == own)
        floor = np.full(len(q), -np.inf)
        if lower.shape[1] >= k:
            floor = np.partition(np.where(solo, -np.inf, lower), -k, axis=1)[:, -k]
        i, j = np.nonzero((upper >= floor[:, None]) & ~solo)
        return pd.DataFrame({"query_id": right["id"].to_numpy()[i], "cid": left["id"].to_numpy()[j], "lower": lower[i, j], "upper": upper[i, j]})

    # two columns without nulls, so that ids stay whole numbers on the way
    alone = classes.select(F.col("cid").alias("id"), (F.size("ids") == 1).alias("alone"), F.get("ids", F.lit(0)).alias("least"))
    scanned = file.join(alone, "id").groupBy("c", "q", "dims").cogroup(ask.groupBy("c", "q", "dims")).applyInPandas(bounds, "query_id long, cid long, lower double, upper double")
    scanned = cut(scanned)
    kth = scanned.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower"), "cid"))).where(F.col("r") == k).select("query_id", F.col("lower").alias("floor"))
    left = scanned.join(kth, "query_id", "left").where("floor is null or upper >= floor").select("query_id", "cid", "upper")
    order = left.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "cid")))
    order = cut(order)

    def exact(pairs: DataFrame) -> DataFrame:
        got = pairs.join(asked, "query_id").join(classes, "cid")
        return got.select("query_id", inner(F.col("q"), F.col("v")).alias("score"), F.explode(F.filter("ids", lambda i: i != F.col("query_id"))).alias("vec_id"))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = cut(exact(order.where(F.col("r") <= k)))
    certain = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("reach"))
    rest = order.where(F.col("r") > k).join(certain, "query_id", "left").where("reach is null or upper >= reach")
    ranked = first.union(exact(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH e0 AS (SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT *, row_number() OVER () AS r FROM e0),
x AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
a AS (SELECT vec_id, v, r FROM e WHERE vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v) = 1),
dot AS (SELECT p.r AS ar, q.r AS br, sum(p.x * q.x) AS s FROM x p JOIN x q USING (i) WHERE p.r IN (SELECT r FROM a) GROUP BY ALL)
SELECT a.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, e.vec_id, CAST(coalesce(dot.s, 0) AS BIGINT) AS score
FROM a JOIN e ON len(a.v) = len(e.v) AND a.vec_id <> e.vec_id LEFT JOIN dot ON dot.ar = a.r AND dot.br = e.r
WINDOW w AS (PARTITION BY a.vec_id ORDER BY coalesce(dot.s, 0) DESC, e.vec_id) QUALIFY row_number() OVER w <= 5"""
