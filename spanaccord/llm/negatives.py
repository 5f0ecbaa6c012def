"""Operator 12: hard negatives by exact integer products in a residue number system."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanaccord.llm.common import cut

#: products of residues below 1/2 LARGEST add up exactly in float32 over this many components
LARGEST, STRETCH = 256, 1024
NONE = np.iinfo(np.int64).min


def moduli(bound: int) -> list[int]:
    """The greatest primes below ``LARGEST`` whose product exceeds 2 * bound; more primes where these do not do."""
    prime = lambda n: all(n % d for d in range(2, int(n**0.5) + 1))
    found, product, n = [], 1, LARGEST
    while product <= 2 * bound + 1:
        n -= 1
        if n < 3:
            raise OverflowError("the primes do not span the scores")
        if prime(n):
            found.append(n)
            product *= n
    return found


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers nearest to zero, as float32."""
    r = v % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices; those beyond 64 bits stand at the nearest bound.

    The component matrices are multiplied modulo each prime in float32: |residue| <= 127 and 1,024 components
    at a time keep every partial sum below 2**24, where float32 is exact.  The signed score follows from its
    residues by mixed radix digits (Chinese remaindering); their number follows from the norms.
    """
    # the norms bound every score (Cauchy and Schwarz); doubles are rounded up
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max())) if m.size else 0.0
    primes = moduli(int(norm(a) * norm(b) * (1 + 1e-9)) + 1)
    exact: np.ndarray | None = None
    digits, radix = [], 1
    for p in primes:
        left, right = residues(a, p), residues(b, p)
        r = np.zeros((len(a), len(b)), dtype=np.float32)
        for lo in range(0, a.shape[1], STRETCH):
            r += left[:, lo : lo + STRETCH] @ right[:, lo : lo + STRETCH].T
            r -= p * np.rint(r / p)
        # digit of this prime: what is missing to the residue, over the product of the primes before
        r = r.astype(np.int64)
        for q, d in digits:
            r = (r - d) * pow(q, -1, p) % p
        digits.append((p, np.where(r > p // 2, r - p, r)))
    wide = float(np.prod([float(p) for p in primes])) >= 2.0**62
    for p, d in digits:
        d = d.astype(object) if wide else d
        exact = d if exact is None else exact + d * radix
        radix *= p
    if wide:
        exact = np.clip(exact, np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max).astype(np.int64)
    return exact


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Which k entries of each row come first by falling score, equal ones in the order of the columns; NONE never does."""
    if scores.shape[1] <= k:
        return scores > NONE
    kth = np.partition(scores, -k, axis=1)[:, -k, None]
    above, equal = scores > kth, scores == kth
    return (above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))) & (scores > NONE)


class Best:
    """The k first candidates met so far of every row, in rising order of their least id."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.score, self.cid = k, np.full((rows, k), NONE), np.zeros((rows, k), dtype=np.int64)

    def meet(self, rows: slice, scores: np.ndarray, cid: np.ndarray) -> None:
        fresh = (scores > self.score[rows].min(1, keepdims=True)).any(1)
        at = np.arange(rows.start, rows.stop)[fresh]
        if not len(at):
            return
        s = np.concatenate([self.score[at], scores[fresh]], axis=1)
        keep = first(s, self.k)
        i, j = np.nonzero(keep)
        to = (np.cumsum(keep, axis=1) - 1)[i, j]
        ids = np.where(j < self.k, self.cid[at][i, np.minimum(j, self.k - 1)], cid[np.maximum(j - self.k, 0)])
        # places that stay free lie behind the taken ones
        score, kept = np.full((len(at), self.k), NONE), np.zeros((len(at), self.k), dtype=np.int64)
        score[i, to], kept[i, to] = s[i, j], ids
        self.score[at], self.cid[at] = score, kept


def _matrix(b: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    v = b.column("v").filter(pa.array(rows))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(int(rows.sum()), -1)


def scan(asked: DataFrame, classes: DataFrame, k: int, own_label: bool, anchor_block: int, tile: int) -> DataFrame:
    """The k first classes of every asked row in every stripe of the classes: (ask_id, cid, score).

    ``asked`` is (ask_id, dims, label, v, lo, hi): scores have to lie in [lo, hi], and the class has the same
    label (``own_label``) or another one.  Blocks of asked rows meet stripes of classes; a task keeps its block
    and the best so far while the classes of its stripe stream by, so a stripe has no size limit and gives k
    rows for each asked row, however many classes it holds.
    """
    spark = asked.sparkSession
    n, m = classes.count(), asked.count()
    blocks = max(1, -(-m // anchor_block))
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    stripes = max(1, min(-(-wanted // blocks), -(-n // tile)))
    one = lambda df, kind: df.withColumn("kind", F.lit(kind))
    a = asked.withColumn("block", F.pmod(F.xxhash64("ask_id"), F.lit(blocks)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    c = classes.withColumn("stripe", F.pmod(F.xxhash64("cid"), F.lit(stripes)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    nothing = F.lit(None).cast("long")
    # classes come in the order of their least id, so that equal scores stay in that order
    both = one(a, 0).select("block", "stripe", "dims", "kind", F.col("ask_id").alias("id"), F.lit(0).cast("long").alias("least"), "label", "lo", "hi", "v").unionByName(
        one(c, 1).select("block", "stripe", "dims", "kind", F.col("cid").alias("id"), "least", "label", nothing.alias("lo"), nothing.alias("hi"), "v"))
    dealt = both.repartition(blocks * stripes, "block", "stripe").sortWithinPartitions("block", "stripe", "dims", "kind", "least", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                ids, best = held[0], held[4]
                i, j = np.nonzero(best.score > NONE)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best.cid[i, j]), pa.array(best.score[i, j])], names=["ask_id", "cid", "score"])

        for b in batches:
            cols = [b.column(x).to_numpy(zero_copy_only=False) for x in ("block", "stripe", "dims", "kind")]
            cuts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in cols], axis=0)]) if b.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows]):
                now, side, piece = tuple(int(x[lo]) for x in cols[:3]), int(cols[3][lo]), b.slice(lo, hi - lo)
                if now != key:
                    yield from out()
                    key, parts, held = now, [], None
                if side == 0:
                    parts.append(piece)
                    continue
                if not parts and held is None:
                    continue
                every = np.ones(piece.num_rows, dtype=bool)
                number = lambda p, x: p.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
                if held is None:
                    whole = [np.concatenate([number(p, x) for p in parts]) for x in ("id", "label", "lo", "hi")]
                    vectors = np.concatenate([_matrix(p, np.ones(p.num_rows, dtype=bool)) for p in parts])
                    # rows that ask for several ranges of one vector share its products
                    distinct, which = np.unique(vectors, axis=0, return_inverse=True) if vectors.shape[1] else (vectors[:1], np.zeros(len(vectors), dtype=np.int64))
                    order = np.argsort(which.reshape(-1), kind="stable")
                    held = (whole[0][order], whole[1][order], whole[2][order], whole[3][order], Best(len(order), k), distinct, which.reshape(-1)[order])
                    parts = []
                _, label, least, most, best, distinct, which = held
                cid, other, v = number(piece, "id"), number(piece, "label"), _matrix(piece, every)
                for c0 in range(0, len(cid), tile):
                    for d0 in range(0, len(distinct), tile):
                        got = products(distinct[d0 : d0 + tile], v[c0 : c0 + tile])
                        r0, r1 = np.searchsorted(which, [d0, d0 + len(got)])
                        for r in range(r0, r1, tile):
                            at = slice(r, min(r + tile, r1))
                            s = got[which[at] - d0]
                            same = label[at, None] == other[None, c0 : c0 + tile]
                            fits = (same == own_label) & (s >= least[at, None]) & (s <= most[at, None])
                            best.meet(at, np.where(fits, s, NONE), cid[c0 : c0 + tile])
        yield from out()

    return cut(dealt.mapInArrow(run, "ask_id long, cid long, score long"))


def sound(embedding: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, anchor_block: int = 16384, tile: int = 1024, label: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For every anchor and each of its positives the first negatives whose scores lie in the window.

    ``rows`` has vec_id, embedding and label; ``anchors`` says of a row whether it asks.  The result is
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).  Positives are the anchor's
    ``positives`` first rows of its label; negatives are rows of other labels with low * positive_score <=
    100 * score <= high * positive_score, the first ``negatives`` of them, rank from 1.  First is the greater
    score, floor(scale * x) of the components multiplied, then the smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part.  Rows equal in
    vec_id, label and vector count once; of rows that differ but share an anchor's id the least (label, vector) asks, and
    none of them is its partner.  Vectors meet only vectors of their length; empty ones score 0.  Components
    beyond 64 bits stand at the nearest bound, and so do scores.  Clashing or further columns are not read.

    Rows equal in label and vector are folded to a class with its least ids, one more than are wanted: no
    result can hold more.  All anchors meet all classes in blocks twice, for positives and within windows.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = rows.where(sound(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    plain = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    if label is not None:
        plain = plain.withColumn("label", label(F.col("vec_id"), F.col("label")).cast("long"))
    plain = plain.distinct()
    spare = max(positives, negatives) + 1
    rank = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    folded = plain.select("vec_id", "label", "v").withColumn("r", rank).where(F.col("r") <= spare).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut(folded.select(F.monotonically_increasing_id().alias("cid"), F.get("ids", F.lit(0)).alias("least"), F.size("v").alias("dims"), "label", "v", "ids"))
    own = plain.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    asking = cut(own.select(F.col("vec_id").alias("anchor_id"), F.size("a.v").alias("dims"), "a.label", "a.v"))
    ids = classes.select("cid", "ids")

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        """Classes to rows: the first k rows of each group."""
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("vec_id", F.explode("ids")).where("vec_id <> anchor_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # every class but one that holds the anchor alone gives a row, so one class more than rows wanted is enough
    least = F.lit(NONE + 1).cast("long")
    near = scan(asking.withColumn("ask_id", F.col("anchor_id")).withColumn("lo", least).withColumn("hi", F.lit(2**63 - 1).cast("long")), classes.drop("ids"), positives + 1, True, anchor_block, tile)
    pos = cut(ranked(near.withColumnRenamed("ask_id", "anchor_id").join(ids, "cid"), ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # decimal: the multiples of a score can pass 64 bits
    d = F.col("positive_score").cast("decimal(25,0)")
    bound = lambda c: F.least(F.greatest(c, F.lit(NONE + 1).cast("decimal(25,0)")), F.lit(2**63 - 1).cast("decimal(25,0)")).cast("long")
    ranges = pos.select("anchor_id", "positive_score").distinct().select("anchor_id", "positive_score", bound(F.ceil(d * window[0] / 100)).alias("lo"), bound(F.floor(d * window[1] / 100)).alias("hi")).where("lo <= hi")
    wanted = cut(ranges.join(asking, "anchor_id").withColumn("ask_id", F.monotonically_increasing_id()))
    far = scan(wanted, classes.drop("ids"), negatives + 1, False, anchor_block, tile)
    neg = ranked(far.join(wanted.select("ask_id", "anchor_id", "positive_score"), "ask_id").join(ids, "cid"), ["ask_id"], negatives)
    return pos.join(neg.select("anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_label(vec_id: Column, label: Column) -> Column:
    """Every seventh row gets the next of ten labels."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


MINE_SQL = """
WITH e0 AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT *, row_number() OVER () AS r FROM e0),
x AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
a AS (SELECT r, vec_id, label, v FROM e WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
dot AS (SELECT p.r AS ar, q.r AS br, sum(p.x * q.x) AS s FROM x p JOIN x q USING (i) WHERE p.r IN (SELECT r FROM a) GROUP BY ALL),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, CAST(coalesce(dot.s, 0) AS BIGINT) AS s
  FROM a JOIN e ON len(a.v) = len(e.v) AND a.vec_id <> e.vec_id LEFT JOIN dot ON dot.ar = a.r AND dot.br = e.r),
pos AS (SELECT anchor_id, other_id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, s AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other_id) QUALIFY row_number() OVER w <= 10"""
