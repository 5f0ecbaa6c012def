"""Operator 10: SimHash near duplicates by bit-sliced comparison."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import components, cut, likely, text_of

#: planes between two looks at whether any lane is still near enough
CHUNK = 9
#: distinct sets, and bytes of their hashes, that a sub-block of compared sets holds at most, on average
SETS, SET_BYTES = 1024, 8 << 20
_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints

def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words; of the whole sequence if it is shorter; empty without words.

    A-Z are lower-cased; words are parted by ASCII white space.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], dtype=np.uint64)
    s = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return np.array([h(s[a:z], seed) for a, z in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits from each hash (a multiply-xorshift round)."""
    x = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(h: np.ndarray, words: int, bits: np.ndarray) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 where it is set in over half the hashes."""
    out = np.zeros(words, dtype=np.uint64)
    if not len(h):
        return out
    lanes = np.arange(8, dtype=np.int64) * 256
    for w in range(words):
        x = h if w == 0 else _mix(h, w)
        seen = np.bincount((x.astype("<u8").view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048).reshape(8, 256)
        on = (seen @ bits).ravel() * 2 > len(h)
        out[w] = np.packbits(on, bitorder="little").view("<u8")[0]
    return out


def least_by_bin(h: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation min-hash: the least hash of each of ``bins`` equal ranges; an empty range takes that of the next filled one."""
    u = np.unique(_mix(h, bins)) if len(h) else np.zeros(1, dtype=np.uint64)
    edges = (np.arange(bins + 1, dtype=object) * 2**64 // bins)
    at = np.searchsorted(u, np.array(edges[:-1], dtype=np.uint64))
    filled = np.append(at[1:], len(u)) > at
    put = np.flatnonzero(filled)
    source = put[np.searchsorted(put, np.arange(bins)) % len(put)]
    return u[at[source]] + (source - np.arange(bins)).astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, seed: int = 42, minhash: tuple[int, int] | None = None, hashed: bool = False) -> DataFrame:
    """(doc_id, hash of the text or null, fp binary of ``words`` little-endian 64-bit words, keys array<long>, same, n).

    Null texts count as empty; without words the fingerprint is zero.  ``minhash=(tables, rows)``
    fills ``keys`` with one key per table from ``rows`` least hashes each; else it is empty.  With it shingles
    are sets: one that is repeated counts once in the fingerprint, ``same`` is a 128-bit hash of the set and
    ``n`` its size; else both are null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = _byte_bits()
        for b in batches:
            fps, keys, same, sizes = [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, shingle, seed)
                if minhash:
                    h = np.unique(h)
                same.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()) if minhash else None)
                sizes.append(len(h) if minhash else None)
                fps.append(fingerprint(h, words, bits).astype("<u8").tobytes())
                if minhash:
                    least = least_by_bin(h, minhash[0] * minhash[1]).reshape(minhash)
                    k = np.arange(minhash[0], dtype=np.uint64)
                    for c in range(minhash[1]):
                        k = _mix(k, 0) ^ least[:, c]
                    keys.append(k.view(np.int64).tolist())
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(same, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "hash", "fp", "keys", "same", "n"])

    mark = F.xxhash64(text_of()) if hashed else F.lit(None).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"), mark.alias("hash")).mapInArrow(run, "doc_id long, hash long, fp binary, keys array<long>, same binary, n long")


# ---------------------------------------------------------- bit-sliced compare

def _slice(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 fingerprints a word, and a spare word."""
    n = len(fps)
    wide = -(-n // 64) * 64
    rows = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.zeros((rows.shape[1], wide + 64), dtype=np.uint8)
    planes[:, :n] = rows.T
    return np.packbits(planes, axis=1, bitorder="little").view("<u8")


def _later(planes: np.ndarray, s: int) -> np.ndarray:
    """Planes whose lane l is lane l+s."""
    k, r = divmod(s, 64)
    width = planes.shape[-1] - 1
    out = np.zeros((*planes.shape[:-1], width), dtype=np.uint64)
    if r:
        out[..., : width - k] = (planes[..., k:width] >> np.uint64(r)) | (planes[..., k + 1 : width + 1] << np.uint64(64 - r))
    else:
        out[..., : width - k] = planes[..., k:width]
    return out


def _near(a: np.ndarray, b: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``valid`` in which the planes a and b differ in at most ``radius`` bits.

    Three planes at a time go through a full adder into bitwise counters that start
    so high that the first difference beyond the radius overflows them; the planes
    are left alone once every lane has overflowed.
    """
    depth = max(1, (radius + 1).bit_length())
    start = (1 << depth) - 1 - radius
    ones = ~np.uint64(0)
    count = [np.full(valid.shape, ones if start >> i & 1 else np.uint64(0)) for i in range(depth)]
    over = ~valid

    def add(x: np.ndarray, level: int) -> None:
        for i in range(level, depth):
            count[i], x = count[i] ^ x, count[i] & x
        np.bitwise_or(over, x, out=over)

    for lo in range(0, len(a), CHUNK):
        d = a[lo : lo + CHUNK] ^ b[lo : lo + CHUNK]
        i = 0
        while i + 2 < len(d):
            x, y, z = d[i], d[i + 1], d[i + 2]
            t = x ^ y
            add(t ^ z, 0)
            if depth > 1:
                add((x & y) | (t & z), 1)
            else:
                np.bitwise_or(over, (x & y) | (t & z), out=over)
            i += 3
        for x in d[i:]:
            add(x, 0)
        if (over == ones).all():
            break
    return ~over


def spanning_links(group: np.ndarray, fps: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Row pairs that join all rows of a group connected by distances up to ``radius``.

    ``group`` is sorted.  Rows s apart are compared for s = 1, 2, ... in all groups at
    once; a group is left when its rows are joined or have all met.  With ``alike`` only
    pairs for which it holds as well connect.
    """
    n = len(group)
    parent = np.arange(n)
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    rows, s, again = np.arange(n), 1, 1
    planes = g = None
    while True:
        if s == again:  # look anew at which groups are open
            while (parent[parent] != parent).any():
                parent = parent[parent]
            g_all = group[rows]
            first = np.r_[True, g_all[1:] != g_all[:-1]] if len(rows) else np.empty(0, bool)
            at = np.flatnonzero(first)
            size = np.diff(np.r_[at, len(rows)])
            lo, hi = (np.minimum.reduceat(parent[rows], at), np.maximum.reduceat(parent[rows], at)) if len(at) else (size, size)
            keep = np.repeat((size > s) & (lo != hi), size)
            if not keep.any():
                return links
            if planes is None or not keep.all():
                rows = rows[keep]
                g = group[rows]
                planes = _slice(fps[rows])
            again = s + max(1, s // 4)
        same = g[:-s] == g[s:]
        if not same.any():
            s = again
            continue
        width = planes.shape[1] - 1
        mask = np.zeros(width * 64, dtype=np.uint8)
        mask[: len(same)] = same
        hits = _near(planes[:, :width], _later(planes, s), np.packbits(mask, bitorder="little").view("<u8"), radius)
        for i in np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little")).tolist():
            a, b = root(rows[i]), root(rows[i + s])
            if a != b and (alike is None or alike(rows[i], rows[i + s])):
                parent[max(a, b)] = min(a, b)
                links.append((int(rows[i]), int(rows[i + s])))
        s += 1


def near_links(rows: DataFrame, radius: int, block: int = 8192, flush: int = 60_000) -> DataFrame:
    """Links (a, b) that connect all fingerprints of a key within ``radius`` bits of each other.

    ``rows``: (key long, fp binary), each pair once.  A key of over ``block`` fingerprints is cut
    into sub-blocks, every two of which meet in one task, so no key is gathered whole and no pair
    is left out.  A block gives fewer links than it has rows.
    """
    big = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("cuts", F.ceil(F.col("n") / block))
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts"))
    dealt = (
        rows.join(big.select("key", "cuts"), "key", "left")
        .withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))))
        .withColumn("task", F.when(F.col("cuts").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", F.least(mine, F.col("other")), F.greatest(mine, F.col("other")))))
        .select("task", "key", "fp")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(x: pd.DataFrame) -> pd.DataFrame:
            group = x["task"].to_numpy()
            fps = np.frombuffer(b"".join(x["fp"]), dtype="<u8").reshape(len(x), -1)
            pairs = spanning_links(group, fps, radius)
            f = x["fp"].to_numpy()
            return pd.DataFrame({"a": [f[i] for i, _ in pairs], "b": [f[j] for _, j in pairs]})

        for x in parts:
            held.append(x)
            if sum(map(len, held)) >= flush:
                x = pd.concat(held, ignore_index=True)
                last = x["task"].searchsorted(x["task"].iloc[-1])
                if last:
                    yield solve(x.iloc[:last])
                held = [x.iloc[last:].reset_index(drop=True)]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    found = dealt.repartition("task").sortWithinPartitions("task", "fp").mapInPandas(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def band_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Keys of a 64-bit fingerprint: two within ``radius`` bits share one, by the pigeonhole principle.

    The bits are cut into ``blocks`` runs; a key holds all runs but ``radius``.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [F.shiftrightunsigned(F.shiftleft(fp, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i]) for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(n), *[runs[i] for i in c]) for n, c in enumerate(itertools.combinations(range(blocks), blocks - radius))])


def _grouped(prints: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint."""
    found = components(near_links(rows, radius))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = ids.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    roots = placed.where("root is not null").groupBy("root").agg(F.min("least").alias("_least"))
    # a fingerprint without a link is a component of its own
    return placed.join(roots, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("_least")).alias("component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4, seed: int = 42) -> DataFrame:
    """Components of documents linked by 64-bit fingerprints within ``radius`` bits: (doc_id, fingerprint, component_id).

    One row per row of ``docs`` (``doc_id``, ``text``).  Equal fingerprints are folded first, so copies
    make no pairs.  A null text is empty; documents without words have fingerprint zero and link like
    others.  Repeated doc_ids keep a row each; a null doc_id never names a component that has another id.
    """
    prints = cut(fingerprints(docs, shingle, 1, seed).select("doc_id", "fp"))
    number = _long(F.col("fp"))
    distinct = prints.select("fp").distinct()
    rows = distinct.select(F.explode(band_keys(number, radius, blocks)).alias("key"), "fp")
    groups = _grouped(prints, rows, radius)
    return prints.join(groups.select("fp", "component_id"), "fp").select("doc_id", F.lower(_big_hex(F.col("fp"))).alias("fingerprint"), "component_id")


def _byte(fp: Column, i: int) -> Column:
    return F.substring(F.hex(fp), 2 * i + 1, 2)


def _big_hex(fp: Column) -> Column:
    return F.concat(*[_byte(fp, i) for i in range(7, -1, -1)])


def _long(fp: Column) -> Column:
    """The first little-endian 64-bit word as a (signed) long."""
    half = lambda lo: F.conv(F.concat(*[_byte(fp, i) for i in range(lo + 3, lo - 1, -1)]), 16, 10).cast("long")
    return F.shiftleft(half(4), 32).bitwiseOR(half(0))


def jaccard_links(members: DataFrame, radius: int, similarity: float, flush: int = 64 << 20) -> DataFrame:
    """Links (a, b) that connect all sets of a group with Jaccard similarity of at least ``similarity``.

    ``members``: (root, cuts, fp, same, set), one row for each set; ``set`` has its sorted 64-bit hashes.  Pairs
    within ``radius`` bits whose sets are not yet joined are counted exactly.  A group is cut into ``cuts``
    sub-blocks, every two of which meet in one task.
    """
    mine = F.pmod(F.xxhash64("same"), F.col("cuts"))
    dealt = (
        members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        .select(F.xxhash64("root", F.least(mine, F.col("other")), F.greatest(mine, F.col("other"))).alias("task"), "fp", "same", "set")
    )

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(v, dtype="<u8") for v in x["set"]]

        def alike(i: int, j: int) -> bool:
            n, m = len(sets[i]), len(sets[j])
            if min(n, m) / max(n, m, 1) < similarity:
                return False
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both / (n + m - both) >= similarity

        pairs = spanning_links(x["task"].to_numpy(), np.frombuffer(b"".join(x["fp"]), dtype="<u8").reshape(len(x), -1), radius, alike)
        name = x["same"].to_numpy()
        return pd.DataFrame({"a": [name[i] for i, _ in pairs], "b": [name[j] for _, j in pairs]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for x in parts:
            held.append(x)
            size += int(x["set"].map(len).sum())
            if size >= flush:
                x = pd.concat(held, ignore_index=True)
                last = x["task"].searchsorted(x["task"].iloc[-1])
                if last:
                    yield solve(x.iloc[:last])
                held = [x.iloc[last:].reset_index(drop=True)]
                size = int(held[0]["set"].map(len).sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    found = dealt.repartition("task").sortWithinPartitions("task", "fp").mapInPandas(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(root, cuts, fp, same, set) from rows with ``text`` in place of ``set``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle, seed)).astype("<u8").tobytes() for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(sets, pa.binary())], names=["root", "cuts", "fp", "same", "set"])

    return rows.select("root", "cuts", "fp", "same", "text").mapInArrow(run, "root long, cuts long, fp binary, same binary, set binary")


def _alike(docs: DataFrame, shingle: int = 5, words: int = 4, radius: int = 72, tables: int = 16, rows: int = 4, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """(doc_id, hash, root): documents with equal roots are connected by pairs of at least ``similarity``.

    Equal sets are folded first.  Fingerprints within ``radius`` bits under a shared key give groups of
    candidates; the sets of groups with more than one are made again from one text each, and compared.
    """
    prints = cut(fingerprints(docs, shingle, words, seed, (tables, rows), True))
    wide = components(near_links(_keyed(prints), radius)).withColumnRenamed("node", "fp")
    sets = prints.groupBy("same").agg(F.min("fp").alias("fp"), F.max("n").alias("n"), F.min(F.struct("doc_id", "hash")).alias("who"))
    # a label may at worst bring more candidates together: the sets decide
    placed = sets.join(wide, "fp", "left").withColumn("root", F.coalesce("root", F.xxhash64("fp")))
    cuts = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") * 8 / SET_BYTES)).cast("long")
    sizes = placed.groupBy("root").agg(F.count("*").alias("sets"), cuts.alias("cuts")).where("sets > 1").drop("sets")
    place = lambda i, h: F.xxhash64(i, h).alias("_at")
    chosen = cut(placed.join(sizes, "root").select("root", "cuts", "fp", "same", F.col("who.doc_id").alias("_id"), F.col("who.hash").alias("_hash"), place("who.doc_id", "who.hash")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_i"), text_of().alias("text"), F.xxhash64(text_of()).alias("_h")).withColumn("_at", place("_i", "_h"))
    met = likely(texts, "_at", chosen.select("_at").distinct()).join(chosen, "_at").where(F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    links = jaccard_links(_sets(met.dropDuplicates(["same"]), shingle, seed), radius, similarity)
    found = components(links).withColumnRenamed("node", "same")
    label = F.coalesce(F.unhex(F.lpad(F.hex("root"), 16, "0")), F.concat(F.lit(b"="), F.col("same")))
    return prints.select("doc_id", "hash", "same").join(found, "same", "left").select("doc_id", "hash", label.alias("root"))


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """Components of documents with a Jaccard similarity of their shingle sets of at least ``similarity``: (doc_id, component_id).

    Links are decided by the exact sets.  Candidates share one of ``tables`` keys of ``rows`` least hashes
    (0.9998 of pairs at 0.8) and differ in at most ``radius`` bits of the long fingerprint: for similarity 0.8
    in 39 of 256 on average with a spread of 6, or 48 for the shortest sets of 4 and 5.  Edge cases are those
    of ``simhash_groups``.
    """
    alike = _alike(docs, **options)
    ids = alike.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return alike.select("doc_id", "root").join(ids, "root").select("doc_id", "component_id")


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp), each pair once: fingerprints under the keys of all their documents."""
    return prints.select(F.posexplode("keys").alias("t", "k"), "fp").select(F.xxhash64("t", "k").alias("key"), "fp").distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of ``similar_groups``: that with the least doc_id.

    Equal doc_ids are told apart by the text's hash; rows equal in both are one document, of which one row
    stays.  A row with a null doc_id stays only where its group holds no other.
    """
    key = F.xxhash64(text_of())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash")).alias("k")
    stay = _alike(docs, **options).groupBy("root").agg(first).select(F.col("k.doc_id").alias("_stay"), F.col("k.hash").alias("_hash"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("_id"), key.alias("_key"))
    met = rows.join(stay, rows["_id"].eqNullSafe(stay["_stay"]) & (rows["_key"] == stay["_hash"]), "left_semi")
    return met.dropDuplicates(["_id", "_key"]).select("row.*")
