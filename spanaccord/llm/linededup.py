"""Operator 9: line deduplication by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import components, cut, likely, text_of

#: indexed lines of one segment that an array holds, on average; a segment has as many arrays as that takes
BLOCK = 128
#: (least characters, edits) of the length bands: shorter lines are copies only if equal
BANDS = ((10, 1), (20, 2))
#: characters after which a comparison looks whether its bands are empty
RUN = 24


def segment_keys(lines: DataFrame, budget: int) -> DataFrame:
    """(key, i, indexed) of lines (i, line): segments of each line and the substrings that may equal a segment of another.

    The line is looked up as the longer of a pair, in the lines shorter by 0 to ``budget`` characters.  The
    positions are those at which both the part before and the part after can stay within the budget.  Parts
    are taken from four bytes a character, so that no part has to be sought from the start of the line.
    """
    parts = budget + 1
    places = [(d, k, shift) for d in range(budget + 1) for k in range(parts) for shift in range(max(-k, d - (budget - k)), min(k, d + (budget - k)) + 1)]
    wide = lines.select("i", F.encode("line", "UTF-32").alias("wide"))
    rows = wide.select("i", "wide", F.shiftright(F.length("wide"), 2).alias("n"), F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(s).alias("s")) for d, k, s in places])).alias("p"))
    rows = rows.select("i", "wide", "n", "p.k", "p.s", (F.col("n") - F.col("p.d")).alias("m"), ((F.col("p.d") == 0) & (F.col("p.s") == 0)).cast("int").alias("indexed"))
    base, more = F.floor(F.col("m") / parts).cast("int"), F.col("m") % parts
    at = base * F.col("k") + F.greatest(F.lit(0), F.col("k") - parts + more) + F.col("s")
    rows = rows.select("i", "wide", "n", "k", "m", "indexed", at.alias("at"), (base + (F.col("k") >= parts - more).cast("int")).alias("size"))
    key = F.shiftrightunsigned(F.xxhash64("k", "m", F.substr("wide", F.col("at") * 4 + 1, F.col("size") * 4)), 16)
    return rows.where("at >= 0 and at + size <= n").select(key.alias("key"), "i", "indexed")


def codes(line: Column, budget: int) -> Column:
    """Code points of a line behind ``budget`` marks that equal none."""
    points = F.when(F.length(line) > 0, F.transform(F.split(line, ""), lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array_repeat(F.lit(-1), budget), points)


def equal_ends(p: Column, q: Column, n_p: Column, n_q: Column) -> Column:
    """(ahead, behind): characters that two lines of n_p and n_q characters share at the start and, beside those, at the end.

    Both counts are found bit by bit, from the highest power of two that fits.
    """
    short = F.least(n_p, n_q)
    powers = F.transform(F.sequence(F.length(F.bin(short)) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    ahead = F.aggregate(powers, F.lit(0), lambda a, w: F.when((a + w <= short) & (F.substr(p, a + 1, w) == F.substr(q, a + 1, w)), a + w).otherwise(a))

    def rest(a: Column) -> Column:
        from_end = lambda line, n, b, w: F.substr(line, n - b - w + 1, w)
        behind = F.aggregate(powers, F.lit(0), lambda b, w: F.when((a + b + w <= short) & (from_end(p, n_p, b, w) == from_end(q, n_q, b, w)), b + w).otherwise(b))
        return F.struct(a.alias("ahead"), behind.alias("behind"))

    return F.get(F.transform(F.array(ahead), rest), F.lit(0))


def within(x: Column, y: Column, budget: int, ahead: Column | None = None, behind: Column | None = None) -> Column:
    """Whether two ``codes`` are within ``budget`` edits: banded bit-parallel automaton.

    One word holds, for every number of errors, a band of 2*budget+1 bits: the diagonals reached with so
    many errors.  A character of y moves all bands at once; nothing outside the band is looked at, and a
    pair whose bands are empty is left.  Characters known to be equal at both ends, which never change the
    distance, are passed over.
    """
    ahead, behind = F.lit(0) if ahead is None else ahead, F.lit(0) if behind is None else behind
    last = F.size(y) - (budget + 1) - behind
    wide = 2 * budget + 1
    full = (1 << wide) - 1
    first = 0
    for e in range(budget + 1):
        first |= sum(1 << (budget + d) for d in range(e + 1)) << (wide * e)

    def step(state: Column, j: Column) -> Column:
        c = F.get(y, j + budget)
        eq = F.lit(0).cast("long")
        for d in range(-budget, budget + 1):
            eq = eq + F.when(F.get(x, j + (budget + d)) == c, F.lit(1 << (budget + d)).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.when(state == 0, state).otherwise(_advance(state, eq))

    def _advance(state: Column, eq: Column) -> Column:
        # eq is used once for each number of errors: name it through a one-element transform
        def moved(q: Column) -> Column:
            old = [F.shiftright(state, wide * e).bitwiseAND(F.lit(full).cast("long")) for e in range(budget + 1)]
            new = [old[0].bitwiseAND(q)]
            for e in range(1, budget + 1):
                v = old[e].bitwiseAND(q).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(full).cast("long")))
                new.append(v)
            word = new[0]
            for e in range(1, budget + 1):
                word = word.bitwiseOR(F.shiftleft(new[e], wide * e))
            return word

        return F.get(F.transform(F.array(eq), moved), F.lit(0))

    def run(state: Column, lo: Column) -> Column:
        steps = F.sequence(lo, F.least(lo + (RUN - 1), last))
        return F.when(state == 0, state).otherwise(F.aggregate(steps, state, step))

    runs = F.when(last >= ahead, F.sequence(ahead, last, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(runs, F.lit(first).cast("long"), run)
    at = F.size(x) - F.size(y) + budget
    top = F.shiftright(end, wide * budget)
    return (F.abs(F.size(x) - F.size(y)) <= budget) & (F.getbit(top, F.greatest(at, F.lit(0))) == 1)


def _lines(docs: DataFrame) -> DataFrame:
    """(d, t, pos, line): lines that are not blank.  d and t, the id and a hash of the text, name the document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), text_of().alias("x"))
    return rows.select("d", F.xxhash64("x").alias("t"), F.posexplode(F.split("x", "\n")).alias("pos", "line")).where(F.trim("line") != "")


def _name(line: Column) -> list[Column]:
    """Two independent hashes: 128 bits that stand for the line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(9), line).alias("b")]


def _cuts(live: DataFrame) -> DataFrame:
    """(key, cuts): arrays that the indexed lines of each key are dealt to; keys without one are missing."""
    return live.where("indexed = 1").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("cuts"))


def _index(probe: DataFrame) -> DataFrame:
    """(key, s, others): the indexed lines of each key in its arrays."""
    return probe.where("indexed = 1").groupBy("key", F.pmod(F.xxhash64("line"), F.col("cuts")).alias("s")).agg(F.collect_list(F.struct("line", "c")).alias("others"))


def near_lines(lines: DataFrame, budget: int = 2, min_chars: int = 20, max_chars: int | None = None) -> DataFrame:
    """Links (a, b) between different lines within ``budget`` edits, both of ``min_chars`` to ``max_chars`` characters.

    ``lines`` has the column line.  One shuffle of (key, least and greatest line number), added up inside
    every task first, finds the segments that different lines share; the keys of such segments alone are made
    again, and the lines under them fetched, through filters of fixed size and exact joins.  Line numbers are
    48 bits of a hash: what they confuse is told apart by the texts.  Lines indexed under one key are counted,
    dealt to arrays of bounded size and compared inside the row, so a frequent segment emits its links and not
    its pairs; the arrays of a key go to different tasks.  Every line under a key is still compared with every
    one indexed there.  a and b are 32 hex digits, a < b.
    """
    long = lines.where((F.length("line") >= min_chars) & (F.lit(True) if max_chars is None else F.length("line") <= max_chars)).select("line", F.shiftrightunsigned(F.xxhash64("line"), 16).alias("i"))
    keys = segment_keys(long, budget)
    shared = cut(keys.groupBy("key").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("indexed").alias("some")).where("lo < hi and some = 1").select("key"))
    live = cut(likely(keys, "key", shared).distinct().join(shared, "key", "left_semi"))
    wanted = live.select("i").distinct()
    texts = likely(long.select("i", "line"), "i", wanted).distinct().join(wanted, "i", "left_semi")
    texts = cut(texts.select("i", "line", codes(F.col("line"), budget).alias("c")))
    probe = live.join(_cuts(live), "key").join(texts, "i").select("key", "indexed", "cuts", "line", "c")
    index = _index(probe)
    size = F.size("c")
    new = lambda x: (x["line"] < F.col("line")) | (F.size(x["c"]) < size)

    def close(x: Column) -> Column:
        ends = equal_ends(x["line"], F.col("line"), F.size(x["c"]) - budget, size - budget)
        return F.exists(F.array(ends), lambda e: within(x["c"], F.col("c"), budget, e["ahead"], e["behind"]))

    near = F.filter("others", lambda x: new(x) & (x["line"] != F.col("line")) & close(x))
    met = probe.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).join(index, ["key", "s"])
    found = met.select("line", F.explode(near).alias("o")).select(_hex(F.col("line")).alias("p"), _hex(F.col("o.line")).alias("q"))
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def banded_lines(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """Links between different lines, the edits allowed following the length of the shorter line.

    ``bands``: (least characters, edits), rising.  A band takes its lines and those of the next ones that its edits
    still reach from its longest line, so that pairs across two bands meet under the stricter budget.
    """
    found = [near_lines(lines, edits, least, None if i + 1 == len(bands) else bands[i + 1][0] - 1 + edits) for i, (least, edits) in enumerate(bands)]
    return reduce(DataFrame.union, found).distinct()


def _hex(line: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.xxhash64(line), F.xxhash64(F.lit(9), line))])


def repeated_lines(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """(d, t, pos, near): occurrences of lines that repeat an earlier one, by equality or within the edits of their band.

    Links are followed: lines connected through others form a class, and the class keeps its first occurrence
    in the order of doc_id (null first), text hash and position.  ``near`` tells that the kept line is a
    different text.
    """
    occurs = _lines(docs).select("d", "t", "pos", *_name(F.col("line")))
    firsts = occurs.groupBy("a", "b").agg(F.min(F.struct("d", "t", "pos")).alias("k"), F.count("*").alias("n"))
    part = lambda at: F.conv(F.substring("node", at, 16), 16, -10).cast("long")
    classes = components(banded_lines(_lines(docs), bands)).select(part(1).alias("a"), part(17).alias("b"), "root")
    held = cut(firsts.join(classes, ["a", "b"], "left").where("n > 1 or root is not null").select("a", "b", "k", "root"))
    keeper = held.where("root is not null").groupBy("root").agg(F.min(F.struct("k", "a", "b")).alias("best"))
    near = (F.col("a") != F.col("best.a")) | (F.col("b") != F.col("best.b"))
    ruled = held.join(keeper, "root", "left").select("a", "b", F.coalesce("best.k", "k").alias("keep"), F.coalesce(near, F.lit(False)).alias("near"))
    return occurs.join(ruled, ["a", "b"]).where(~F.struct("d", "t", "pos").eqNullSafe(F.col("keep"))).select("d", "t", "pos", "near")


def _by_document(repeats: DataFrame) -> DataFrame:
    return repeats.distinct().groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "near"))).alias("gone"))


def _beside(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows with columns _d and _t joined to the positions that go."""
    r = _by_document(repeats)
    return rows.join(r, rows["_d"].eqNullSafe(r["d"]) & (rows["_t"] == r["t"]), "left").drop("d", "t")


def line_report(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_copies, n_near, removed (positions from 0, comma-joined).

    n_lines counts lines that are not blank.  Blank lines are never removed; null and empty texts have no
    lines.  Rows that repeat another in doc_id and text are one document and get the same answer.
    """
    x = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(x).alias("_t"), F.size(F.filter(F.split(x, "\n"), lambda v: F.trim(v) != "")).cast("long").alias("n_lines"))
    near = F.size(F.filter("gone", lambda g: g["near"]))
    return _beside(rows, repeated_lines(docs, bands)).withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<pos:int,near:boolean>>"))).select(
        F.col("_d").alias("doc_id"), "n_lines", (F.size("gone") - near).cast("long").alias("n_copies"), near.cast("long").alias("n_near"),
        F.array_join(F.transform("gone", lambda g: g["pos"].cast("string")), ",").alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """``docs`` with all columns, repeated lines taken out of ``text``.

    A document left without any line although it had some is a copy throughout and goes; null and empty
    texts stay as they are.  ``n_chars``, where there is one, follows the text.  The row travels as one column, so
    columns of any name may be beside those read.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(text_of()).alias("_t"))
    both = _beside(rows, repeated_lines(docs, bands))
    gone = F.transform("gone", lambda g: g["pos"])
    left = F.when(F.col("gone").isNotNull(), F.filter(F.split(F.col("_row")["text"], "\n"), lambda v, i: ~F.array_contains(gone, i)))
    kept = both.select("_row", left.alias("_left")).where("_left is null or exists(_left, v -> trim(v) <> '')")
    text = F.array_join("_left", "\n")
    new = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    same = F.col("_left").isNull()
    return kept.select(*[F.when(same, F.col("_row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
