"""Operator 13: a trie of conversation prefixes by ROLLUP over positional turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import cut
from spanaccord.operators.scan import number, running_sum, running_xor, scan

#: turns in one block of positional columns
BLOCK = 8
#: rows of one conversation that meet one row of a table by conversation
SLICE = 4096
#: tasks over which the children of one node are dealt
SALTS = 64
#: conversation numbers written out in one piece
PIECE = 512


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, a, b, n): turns numbered from 1 in order, their 120-bit id and the bytes of their text.

    Order is by turn, null first; turns that are equal there come in the order of their ids.  The id is cut
    from the SHA-256 of role and text, so that no text is moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substr("s", F.lit(at), F.lit(15)), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("s"), F.octet_length(text).cast("long").alias("n"))
    ids = rows.select("conv_id", "turn", part(1).alias("a"), part(16).alias("b"), "n")
    return cut(scan(ids, ["conv_id"], ["turn", "a", "b"], {"p": number()}).select("conv_id", "p", "a", "b", "n"))


def sliced(per_conv: DataFrame, rows: Column) -> DataFrame:
    """One row for each slice of a conversation with that many rows: a long conversation is many keys."""
    return per_conv.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(rows / SLICE))))


def rebuilt(turns: DataFrame, group: int = 5, lengths: int = 9) -> DataFrame:
    """(conv_id, d, a, b, n, len): the first h turns of conversation c - c % group, then c's own after its first h.

    h is crc32 of the decimal c modulo ``lengths``.  A conversation without a turn gives one row whose a is null.
    """
    c = turns.groupBy("conv_id").agg(F.max("p").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % lengths)
    c = c.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    c = c.join(c.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    c = c.withColumn("copied", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn("len", F.col("copied") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    c = cut(c.select("conv_id", "base", "h", "own", "copied", "len"))
    heads = turns.where(F.col("p") < lengths).withColumnRenamed("conv_id", "base")
    first = heads.join(c, "base").where("p <= h").select("conv_id", F.col("p").alias("d"), "a", "b", "n", "len")
    # a conversation may hold any share of the rows, so its slices are keys of their own
    own = turns.withColumn("slice", F.floor(F.col("p") / SLICE)).join(sliced(c, F.col("own")), ["conv_id", "slice"]).where("p > h")
    none = F.lit(None).cast("long")
    return first.unionByName(own.select("conv_id", (F.col("p") - F.col("h") + F.col("copied")).alias("d"), "a", "b", "n", "len")).unionByName(
        c.where("len = 0").select("conv_id", F.lit(1).cast("long").alias("d"), none.alias("a"), none.alias("b"), none.alias("n"), "len"))


def mixed(d: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two words that a turn at a depth adds to the key of a prefix."""
    return F.xxhash64(d, a, b), F.xxhash64(F.lit(1), b, d, a)


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, k, len, p1, p2, x1, x2, t1 ...): the turns of block k in columns, keyed by the prior block's node.

    The node is named by the exclusive or of its turns' words, each hashed with its depth: two longs that every
    block has without waiting for the blocks before it.  x is the key with this block, p that without.
    """
    at = F.pmod(F.col("d") - 1, F.lit(size))
    present = F.col("a").isNotNull()
    x1, x2 = mixed(F.col("d"), F.col("a"), F.col("b"))
    cells = [F.max(F.when(at == j, F.col(c))).alias(f"{c}{j + 1}") for j in range(size) for c in ("a", "b", "n")]
    wide = rows.groupBy("conv_id", F.floor((F.col("d") - 1) / size).alias("k")).agg(F.max("len").alias("len"), F.bit_xor(F.when(present, x1)).alias("y1"), F.bit_xor(F.when(present, x2)).alias("y2"), *cells)
    run = scan(wide, ["conv_id"], ["k"], {"x1": running_xor("y1"), "x2": running_xor("y2")})
    prior = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"y{i}", F.lit(0).cast("long"))).alias(f"p{i}") for i in (1, 2)]
    turn = [F.when(F.col(f"a{j}").isNotNull(), F.struct(F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b"), F.col(f"n{j}").alias("n"))).alias(f"t{j}") for j in range(1, size + 1)]
    return cut(run.select("conv_id", "k", "len", *prior, "x1", "x2", *turn))


def rollup(rows: DataFrame, aggregates: str, size: int) -> DataFrame:
    """All prefixes of all blocks in one aggregate: (k, p1, p2, t1 ..., level, aggregates).

    Level j of block k is the prefix of depth k * size + j.  Level 0 is the root in block 0 and else the node
    that the prior block ends with, which is left out; so are levels beyond a conversation's end.
    """
    names = ", ".join(f"t{j}" for j in range(1, size + 1))
    real = " ".join(f"WHEN {j} THEN t{j} IS NOT NULL" for j in range(1, size + 1))
    return rows.sparkSession.sql(f"""
        SELECT * FROM (SELECT k, p1, p2, {names}, {size} - bit_count(grouping_id()) AS level, {aggregates}
                       FROM {{rows}} GROUP BY k, p1, p2, ROLLUP ({names}))
        WHERE CASE level {real} ELSE k = 0 END""", rows=rows)


def at_level(names: str, size: int, start: int = 1) -> str:
    return "CASE level " + " ".join(f"WHEN {j} THEN {names.format(j)}" for j in range(start, size + 1)) + " END"


def owners(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """What each conversation adds to the subtrees it belongs to: by block (g0 ...) and as a whole.

    A node is owned by its least member.  Members only get fewer with depth, so a conversation owns the nodes
    from some depth to its end; saved bytes are summed from there, and its end is a leaf or not.
    """
    nodes = rollup(rows, "count(*) AS n_convs, min(conv_id) AS owner, max(len) AS reach", size)
    depth = F.col("k") * size + F.col("level")
    saved = (F.col("n_convs") - 1) * F.coalesce(F.expr(at_level("t{}.n", size)), F.lit(0))
    own = nodes.select(F.col("owner").alias("conv_id"), "k", "level", (-depth).alias("up"), saved.alias("saved"), (F.col("reach") == depth).cast("long").alias("leaf"))
    summed = cut(scan(own, ["conv_id"], ["up"], {"below": running_sum("saved")}).select("conv_id", "k", "level", "up", "below", "leaf"))
    by_block = summed.groupBy("conv_id", "k").agg(*[F.max(F.when(F.col("level") == j, F.col("below"))).alias(f"g{j}") for j in range(size + 1)])
    whole = summed.groupBy("conv_id").agg(F.max("below").alias("total"), F.max("leaf").alias("leaf"), (-F.min("up")).alias("last"))
    return by_block, whole


def end_digests(rows: DataFrame, size: int) -> DataFrame:
    """(depth, x1, x2, ends): SHA-256 of the rising numbers of the conversations that end at a node.

    Numbers are written in pieces of a bounded range, so that no group is gathered; the pieces of a node then
    stream through the digest in order, one batch in memory at a time.
    """
    last = rows.where((F.col("k") + 1) * size >= F.col("len")).select(F.col("len").alias("depth"), "x1", "x2", "conv_id", F.floor(F.col("conv_id") / PIECE).alias("at"))
    pieces = last.groupBy("depth", "x1", "x2", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            done = []
            for *now, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "x1", "x2", "ids"))):
                if now != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "x1", "x2", "ends"), d)) for d in done])
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "x1", "x2", "ends"), (*key, digest.hexdigest())))])

    return dealt.mapInArrow(run, "depth long, x1 long, x2 long, ends string")


def trie(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all conversations in ``rows``: (conv_id, d, a, b, n, len) as ``rebuilt`` gives them.

    Returns conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.  Two rollups over the blocks: the first finds each node's owner and members, the second sums
    over the members of each node what ``owners`` says they add to its subtree.  Every step is linear in turns,
    whatever the longest conversation.
    """
    b = blocks(rows, size)
    by_block, whole = owners(b, size)
    per_slice = sliced(whole.withColumnRenamed("leaf", "own_leaf"), F.col("last") / size)
    met = b.withColumn("slice", F.floor(F.col("k") / SLICE)).join(by_block, ["conv_id", "k"], "left").join(per_slice, ["conv_id", "slice"], "left")
    value = [F.coalesce(f"g{j}", "total", F.lit(0).cast("long")).alias(f"v{j}") for j in range(size + 1)]
    valued = met.select("conv_id", "k", "len", "p1", "p2", *[f"t{j}" for j in range(1, size + 1)], F.coalesce("own_leaf", F.lit(0).cast("long")).alias("leaf"), *value)
    sums = ", ".join(f"sum(v{j}) AS s{j}" for j in range(size + 1))
    found = rollup(valued, f"count(*) AS n_convs, min(conv_id) AS conv_id, sum(leaf) AS n_leaves, {sums}", size)
    key, above = [], []
    for i in (1, 2):
        now = F.col(f"p{i}")
        steps = [now]
        for j in range(1, size + 1):
            steps.append(steps[-1].bitwiseXOR(mixed(F.col("k") * size + j, F.col(f"t{j}.a"), F.col(f"t{j}.b"))[i - 1]))
        pick = lambda shift: F.coalesce(*[F.when(F.col("level") == j, steps[max(0, j - shift)]) for j in range(size + 1)])
        key.append(pick(0).alias(f"x{i}"))
        above.append(pick(1).alias(f"u{i}"))
    nodes = cut(found.select("conv_id", (F.col("k") * size + F.col("level")).alias("depth"), *key, *above, "n_convs", "n_leaves", F.expr(at_level("s{}", size, 0)).alias("saved_tokens")))

    # children are counted in salted parts; a part, not the node, is the key under which they look up their parent
    salt = F.pmod(F.xxhash64("x1", "x2", "depth"), F.lit(SALTS)).alias("salt")
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("x1"), F.col("u2").alias("x2"), salt)
    parts = up.groupBy("depth", "x1", "x2", "salt").agg(F.count("*").alias("c"))
    counts = parts.groupBy("depth", "x1", "x2").agg(F.sum("c").alias("n_children"))
    parents = parts.join(nodes.select("depth", "x1", "x2", "conv_id"), ["depth", "x1", "x2"]).select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), "salt", F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(counts, ["depth", "x1", "x2"], "left").join(end_digests(b, size), ["depth", "x1", "x2"], "left")
    full = full.withColumn("salt", salt).join(parents, ["depth", "u1", "u2", "salt"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, group: int = 5, lengths: int = 9, size: int = BLOCK) -> DataFrame:
    """The trie over the rebuilt conversations (``rebuilt``) of a table (conv_id, turn, role, text).

    Null roles and texts are read as empty; rows with a null conv_id take no part.  Turns of one conversation
    with equal turn come in the order of their ids (``turn_rows``), so repeated rows are repeated turns.  c % group
    has the sign of c.  An empty table has no member and so no node.  Further columns are not read.
    """
    return trie(rebuilt(turn_rows(conversations), group, lengths), size)


TRIE_SQL = """
WITH crc AS (SELECT conv_id, xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda acc, x: list_reduce([xor(acc, x)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 30)) AS p FROM t0),
parts AS (SELECT c.conv_id, 0 AS side, t.p, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
seq AS (SELECT c.conv_id, coalesce(list(struct_pack(role := q.role, text := q.text) ORDER BY side, p) FILTER (q.p IS NOT NULL), []) AS s FROM crc c LEFT JOIN parts q USING (conv_id) GROUP BY c.conv_id),
pre AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS s FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (SELECT d AS depth, s, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, (count(*) - 1) * coalesce(strlen(s[d].text), 0) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY d, s),
sub AS (SELECT u AS depth, s[1:u] AS s, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (depth = u + 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM node) GROUP BY u, s[1:u])
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, sub.n_children, sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sub ON sub.depth = n.depth AND sub.s = n.s LEFT JOIN node p ON p.depth = n.depth - 1 AND p.s = n.s[1:n.depth - 1]"""
