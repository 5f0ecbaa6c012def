"""Operator 2: benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import arrow_udf

from spanaccord.llm.common import map_rows, text_of
from spanaccord.settings import scratch

#: characters of benchmark text that one pass holds; a larger benchmark takes several passes
PASS_CHARS = 16_000_000
#: neighbouring pieces that are checked together before the whole item: in groups of so many pieces, one group has
#: fewer errors than pieces and holds an intact one, or the item is beyond its budget
GROUPS = (2, 4)


def fold(text: str) -> str:
    """Lower case, white space runs as one blank; the number of characters between blanks stays."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return " ".join(low.split())


def unfolded(text: str, start: int, end: int) -> tuple[int, int]:
    """Offsets in ``text`` of the span [start, end) of ``fold(text)``."""
    at, a, b = 0, None, 0
    for m in re.finditer(r"\S+", text):
        n = m.end() - m.start()
        if a is None and start < at + n + 1:
            a = m.start() + min(n, max(0, start - at))
        if end > at:
            b = m.start() + min(n, end - at)
        at += n + 1
        if at > end and a is not None:
            break
    return a or 0, b


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets: one survives any ``errors`` edits."""
    n, k = len(item), errors + 1
    return [(n * i // k, item[n * i // k : n * (i + 1) // k]) for i in range(k)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def search(pattern: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the pattern to any part of ``text`` and the first end where it is met, if at most ``most``."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


class Index:
    """Pieces of all items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple]] = {}
        for item_id, text in items:
            t = fold(text)
            if not t:
                continue
            e = budget(len(t), rate)
            cutup = pieces(t, e)
            groups = {(size, g): self._group(cutup[g * size : (g + 1) * size], size) for size in GROUPS for g in range(-(-len(cutup) // size))}
            for j, (off, p) in enumerate(cutup):
                where.setdefault(p, []).append((len(self.items), off, [groups[size, j // size] for size in GROUPS]))
            self.items.append((item_id, len(t), e, masks(t), masks(t[::-1])))
        self.tree = ahocorasick.Automaton()
        for p, v in where.items():
            self.tree.add_word(p, (len(p), v))
        if where:
            self.tree.make_automaton()
        self.some = bool(where)

    @staticmethod
    def _group(members: list[tuple[int, str]], size: int) -> tuple:
        text = "".join(p for _, p in members)
        return members[0][0], len(text), len(members) - 1, masks(text)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that occurs within its budget; offsets in ``text``."""
        if not self.some:
            return []
        t = fold(text)
        lines: dict[int, set[int]] = {}
        for end, (n, users) in self.tree.iter(t):
            for k, off, groups in users:
                start = end + 1 - n - off
                if all(e == 0 or search(g, m, t[max(0, start + at - e) : start + at + m + e], e) for at, m, e, g in groups):
                    lines.setdefault(k, set()).add(start)
        out = []
        for k, starts in lines.items():
            item_id, n, e, forth, back = self.items[k]
            best = None
            run = sorted(starts)
            while run:
                j = 1
                while j < len(run) and run[j] - run[j - 1] <= 2 * e + 1:
                    j += 1
                lo, hi = max(0, run[0] - e), min(len(t), run[j - 1] + n + e)
                run = run[j:]
                if hi - lo < n - e:
                    continue
                got = search(forth, n, t[lo:hi], e if best is None else best[0] - 1)
                if got:
                    z = lo + got[1]
                    a = search(back, n, t[max(0, z - n - e) : z][::-1], got[0])
                    best = (got[0], z - a[1], z)
                    if got[0] == 0:
                        break
            if best:
                out.append((item_id, best[0], *unfolded(text, best[1], best[2])))
        return sorted(out, key=lambda r: (r[0] is None, r))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """(doc_id, item_id, distance, start, end): items that occur in a document within ``rate`` edits a character.

    Texts are compared in lower case with white space runs as one blank; start and end are code points of
    the document's own text.  One row per pair, the nearest and then first place.  Items for
    which the rate allows no edit must occur exactly; null and empty texts match nothing.  Equal items and repeated rows
    each give their own rows.

    The documents are not shuffled.  The benchmark is sized first; beyond ``PASS_CHARS`` characters it is
    read in several passes of bounded size, each written to the shared folder before the next part of the benchmark
    is fetched, so that neither a task nor the driver holds more than one part.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // PASS_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for p in range(passes):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()]

        def make(part=part):
            index = Index(part, rate)

            def run(b: dict) -> dict:
                got = [(d, *m) for d, t in zip(b["doc_id"], b["text"]) for m in index.find(t)]
                return {n: [g[i] for g in got] for i, n in enumerate(("doc_id", "item_id", "distance", "start", "end"))}

            return run

        found = map_rows(rows, make, "doc_id long, item_id long, distance long, start long, end long")
        found = found if passes == 1 else _written(found, "matches")
        out = found if out is None else out.union(found)
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item (see ``matches``)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // PASS_CHARS))
    out = docs
    for p in range(passes):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()]
        out = out.where(_clean(part, rate)(text_of()))
        out = out if passes == 1 else _written(out, "clean")
    return out


def _clean(part: list[tuple], rate: float):
    made: list[Index] = []

    @arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(part, rate))
        return pa.array([not made[0].find(t) for t in texts.to_pylist()], pa.bool_())

    return clean
