"""Alignment of two label sequences.

A1 aligns the units of two sources per (file, window) under a score with gaps,
one-to-many steps and a limit on how far apart in time a pair may be.  Two
things keep it distributed:

* A window is first cut wherever no pair across the cut could be near enough.
  Such pairs score worse than leaving both units alone, so no best alignment
  uses them and the pieces can be solved apart.  The cuts come from ordered
  scans, so one very long window is spread too.
* A piece is one row of arrays; a vectorised function maps arrays to steps and
  the rest stays in the engine.  It keeps the cells near the diagonal only, so
  that its memory grows with the units within reach of one another.

Among equally good alignments the choice at the end of a piece can depend on
whether the next piece begins with additions.  Each piece is therefore solved
for both cases, and a scan over the pieces picks the case.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanaccord.operators.groups import join_groups
from spanaccord.operators.intervals import assign_beside, build_windows
from spanaccord.operators.scoring import DEVOICED_VOWELS, VOICED_VOWELS
from spanaccord.operators.scan import first_after, is_split, known_cool, lag, max_before, min_from, no_piece, running_sum, scan, total

# fixed values: scores of the alignment and the farthest allowed pair in seconds
MATCH, MISMATCH, GAP, FAR_S, MAX_SPAN = 2, -1, -2, 0.15, 3
DEFAULT = {"config": "default", "match": MATCH, "mismatch": MISMATCH, "gap": GAP, "far": FAR_S}

#: the two solutions of a piece under a parameter set, b only where it differs from a; for the form of a step see ``_code``
_STEP = T.ArrayType(T.LongType())
_STEPS = T.ArrayType(T.StructType([
    T.StructField("a", _STEP), T.StructField("b", _STEP), T.StructField("oa", T.IntegerType()), T.StructField("ob", T.IntegerType()),
]))
_EDIT = T.StructType([
    T.StructField("cost", T.DoubleType()), T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("gap_of", T.ArrayType(T.IntegerType())),
])


class _Band:
    """Best scores of the cells that a pair can reach, row by row; all other cells follow from these.

    Units of both sides come by start, so the hypothesis units within ``far`` of a reference unit are a run whose ends never
    fall.  Row i (after i reference units) is kept from the first such unit of reference i - 1 to the last that any
    before it may use.  Right of that only additions are left, and a column left of a row's start has not changed,
    but for omissions, since the last row that held it.
    """

    def __init__(self, r0, r1, ok, parts, h0, h1, lab, match, mismatch, gap, far):
        n, m = len(r0), len(h0)
        self.n, self.m, self.gap = n, m, gap
        self.one: dict[tuple[int, int], int] = {}
        self.many: dict[tuple[int, int, int], int] = {}
        self.start, self.rows = [0], [np.zeros(1, dtype=np.int64)]
        lo = np.searchsorted(h0, r0 - far - 1e-6, "left")
        hi = np.searchsorted(h0, r0 + far + 1e-6, "right")
        top = 0
        for i in range(n):
            a = int(lo[i])
            top = max(top, min(m, int(hi[i]) + MAX_SPAN - 1))
            prev = self._from(i, a, top)
            best = prev + gap
            good = set(ok[i]) if ok[i] is not None else ()
            near = a + np.flatnonzero((np.abs(h0[a : hi[i]] - r0[i]) <= far) & (np.abs(h1[a : hi[i]] - r1[i]) <= far))
            for j in near.tolist():
                self.one[i, j] = match if lab[j] in good else mismatch
                best[j + 1 - a] = max(best[j + 1 - a], prev[j - a] + self.one[i, j])
            k = len(parts[i])
            if 2 <= k <= MAX_SPAN:
                sets = [set(p) if p is not None else () for p in parts[i]]
                for f in range(a, min(int(hi[i]), m - k + 1)):
                    j = f + k - 1
                    if abs(h0[f] - r0[i]) <= far and abs(h1[j] - r1[i]) <= far and all(lab[f + q] in sets[q] for q in range(k)):
                        self.many[k, i, j] = match * k
                        best[j + 1 - a] = max(best[j + 1 - a], prev[f - a] + match * k)
            if a:
                best[0] = max(best[0], self.at(i, a - 1) + 2 * gap)
            step = -gap * np.arange(len(best))
            self.start.append(a)
            self.rows.append(np.maximum.accumulate(best + step) - step)      # additions to the left, all at once

    def _from(self, i: int, a: int, top: int) -> np.ndarray:
        """Row i from column a to column top."""
        row, skip = self.rows[i], a - self.start[i]
        known = row[skip:] if skip < len(row) else row[-1:] + self.gap * (skip - len(row) + 1)
        return np.concatenate([known, known[-1] + self.gap * np.arange(1, top - a + 2 - len(known))])

    def at(self, i: int, j: int) -> int:
        k = bisect_right(self.start, j, 0, i + 1) - 1
        row, x = self.rows[k], j - self.start[k]
        value = row[x] if x < len(row) else row[-1] + self.gap * (x - len(row) + 1)
        return int(value) + self.gap * (i - k)


#: kinds of a step: addition before all units of a piece, omission made while additions are open, other
_LEAD, _OPEN, _BODY = 0, 1, 2


def _walk(s: _Band, pending: bool):
    """Steps from the end; ``pending`` means additions of a later piece are still open."""
    i, j, gap = s.n, s.m, s.gap
    out = []
    if pending:
        while i > 0 and s.at(i, j) == s.at(i - 1, j) + gap:
            i -= 1
            out.append((i, -1, 0, _OPEN))
    closed = i > 0
    while i > 0:
        took, now = None, s.at(i, j)
        for k in range(2, MAX_SPAN + 1):
            if (k, i - 1, j - 1) in s.many and now == s.at(i - 1, j - k) + s.many[k, i - 1, j - 1]:
                took = (i - 1, j - k, k)
                break
        if took is None and (i - 1, j - 1) in s.one and now == s.at(i - 1, j - 1) + s.one[i - 1, j - 1]:
            took = (i - 1, j - 1, 1)
        if took is not None:
            out.append((*took, _BODY))
            i, j = took[0], took[1]
        elif now == s.at(i - 1, j) + gap:
            i -= 1
            out.append((i, -1, 0, _BODY))
        else:
            j -= 1
            out.append((-1, j, 1, _BODY))
    left_open = j > 0 or (pending and not closed)
    return out + [(-1, q, 1, _LEAD) for q in range(j - 1, -1, -1)], int(left_open)


def _code(step, ok, lab) -> int:
    """A step (unit of the first side or -1, first unit of the other or -1, their number, kind) in one number, with a bit for labels that go together."""
    r, h, k, c = step
    return (r + 1) << 34 | (h + 1) << 5 | int(r >= 0 and k > 0 and ok[r] is not None and lab[h] in ok[r]) << 4 | k << 2 | c


def _solver(configs: list[dict]):
    """Both solutions of a piece, one after the other for each parameter set."""

    @F.pandas_udf(_STEPS)
    def solve(r0: pd.Series, r1: pd.Series, ok: pd.Series, parts: pd.Series, h0: pd.Series, h1: pd.Series, lab: pd.Series) -> pd.Series:
        arr = lambda x: np.asarray(x, dtype=float)
        out = []
        for a0, a1, o, p, b0, b1, l in zip(r0, r1, ok, parts, h0, h1, lab):
            row = []
            for c in configs:
                s = _Band(arr(a0), arr(a1), o, p, arr(b0), arr(b1), l, c["match"], c["mismatch"], c["gap"], c["far"])
                (sa, oa), (sb, ob) = _walk(s, False), _walk(s, True)
                d = lambda x: [_code(y, o, l) for y in x[::-1]]  # noqa: B023, E731
                row.append({"a": d(sa), "b": None if sb == sa else d(sb), "oa": oa, "ob": ob})
            out.append(row)
        return pd.Series(out)

    return solve


def label_compat(labels: DataFrame, label_map: DataFrame) -> DataFrame:
    """Per source label: the machine labels it goes with, whole and part by part."""
    m = label_map.where("machine_label <> '-'").groupBy(F.col("source_label").alias("_l")).agg(F.collect_set("machine_label").alias("_m"))
    whole = labels.select("label").distinct()
    parts = whole.select("label", F.posexplode(F.filter(F.split("label", r"[+\s]+"), lambda x: x != "")).alias("_i", "_l")).join(m, "_l", "left")
    parts = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("parts"))
    return whole.join(m.withColumnRenamed("_l", "label").withColumnRenamed("_m", "ok"), "label", "left").join(parts, "label", "left")


def align_windows(ref: DataFrame, hyp: DataFrame, label_map: DataFrame, configs: list[dict] | None = None) -> DataFrame:
    """A1, A2: typed alignment of evaluable units per (file, window), for each parameter set.

    ``ref``: file_id, ipu_id, unit_id, t_start, t_end, label_source, phone_class, and where known the window's
    ipu_start and ipu_end; where these are null or missing the units' own times bound the window.
    ``hyp``: file_id, unit_id, t_start, t_end, label, phone_class.
    Files without units on one of the sides are left out.
    """
    configs = configs or [DEFAULT]
    cool = known_cool(ref, ["file_id", "ipu_id"]) and known_cool(hyp, ["file_id"])
    compat = label_compat(ref.select(F.col("label_source").alias("label")), label_map)
    ref = ref.withColumn("ipu_id", F.coalesce("ipu_id", F.lit("_nofile")))
    times = [c if c in ref.columns else None for c in ("ipu_start", "ipu_end")]
    windows = build_windows(ref, w_start=times[0], w_end=times[1])
    cols = ["unit_id", "t_start", "t_end", "label", "phone_class"]
    r = ref.select("file_id", "ipu_id", *[F.col("label_source").alias("label") if c == "label" else c for c in cols])
    both = assign_beside(hyp.select("file_id", *cols), windows, r, ["file_id"]).withColumnRenamed("_is_beside", "is_ref")

    # one cut for all parameter sets: what is apart by the widest limit is apart by the others
    far = F.lit(max(c["far"] for c in configs))
    key = ["file_id", "ipu_id"]
    order = ["t_start", "is_ref", "unit_id"]
    s = scan(both, key, order, {"_prev": lag("t_start"), "_end": max_before("t_end"), "_next_end": min_from("t_end")}, keep_piece=True, recheck=not cool)
    apart = F.coalesce((F.col("t_start") - F.col("_prev") > far) & (F.col("_next_end") - F.col("_end") > far), F.lit(True))
    s = scan(s.withColumn("_cut", apart.cast("long")), key, order, {"_part": running_sum("_cut")}, keep_piece=True)

    split = is_split(s)
    s = join_groups(s.drop("_piece"), compat, ["label"], "left")
    own = ["t_start", "unit_id", "t_end", "label", "phone_class"]
    side = lambda c, *more: F.array_sort(F.collect_list(F.when(c, F.struct(*own, *more))))  # noqa: E731  (by start, then id)
    g = s.groupBy(*key, "_part").agg(side(F.col("is_ref"), "ok", "parts").alias("R"), side(~F.col("is_ref")).alias("H"))
    g = g.withColumn("_s", _solver(configs)("R.t_start", "R.t_end", "R.ok", "R.parts", "H.t_start", "H.t_end", "H.label"))
    # an array for each column, so that what is not asked for is not dealt out again
    sides = [f"{t}_{c}" for t in "RH" for c in own]
    g = g.select(*key, "_part", "_s", *[F.col(f"{n[0]}.{n[2:]}").alias(n) for n in sides])

    # which of the two solutions holds: the open additions of the next piece
    if not split:
        g = g.select("*", no_piece())        # no hot window among the units, so none among the pieces
    each = range(len(configs))
    oa, ob = [F.col("_s")[i]["oa"] for i in each], [F.col("_s")[i]["ob"] for i in each]
    turns = [((oa[i] == 1) & (ob[i] == 0)).cast("long") for i in each]
    g = g.select("*", *[t.alias(f"_turn{i}") for i, t in enumerate(turns)])
    c = scan(g, key, ["_part"], {n: spec(f"_turn{i}") for i in each for n, spec in ((f"_t{i}", running_sum), (f"_all{i}", total))}, keep_piece=True)
    known = [F.when(oa[i] == ob[i], F.struct(oa[i].alias("o"), F.col(f"_t{i}").alias("t"))) for i in each]
    c = scan(c, key, ["_part"], {f"_k{i}": first_after(known[i]) for i in each}, keep_piece=True)
    is_open = [(F.coalesce(F.col(f"_k{i}.o"), F.lit(0)) + F.coalesce(F.col(f"_k{i}.t"), f"_all{i}") - F.col(f"_t{i}")) % 2 == 1 for i in each]
    # open omissions come after the additions they were made over: in the next piece that has anything else
    kind = lambda x: x.bitwiseAND(F.lit(3))
    steps = [F.when(is_open[i], F.coalesce(F.col("_s")[i]["b"], F.col("_s")[i]["a"])).otherwise(F.col("_s")[i]["a"]) for i in each]
    through = [is_open[i] & ~F.exists(steps[i], lambda x: kind(x) == _BODY) for i in each]
    held = F.array(*[F.struct(F.lit(p["config"]).alias("config"), steps[i].alias("steps"), through[i].alias("through")) for i, p in enumerate(configs)])
    c = c.select(*key, "_part", "_piece", *sides, held.alias("_c"))
    c = scan(c, key, ["_part"], {f"_to{i}": first_after(F.when(~F.col("_c")[i]["through"], F.col("_part"))) for i in each})
    c = c.select(*key, "_part", *sides, F.posexplode("_c").alias("_n", "_c"), F.array(*[f"_to{i}" for i in each]).alias("_to"))
    c = c.select("_c.config", *key, "_part", *sides, F.get("_to", F.col("_n")).alias("_to"), F.col("_c.through").alias("_through"), F.col("_c.steps").alias("_steps"))
    e = c.select("config", *key, "_part", "_to", "_through", *sides, F.posexplode("_steps").alias("step", "_x"))
    bits = lambda at, mask: F.shiftright("_x", at).bitwiseAND(F.lit(mask)).cast("int")
    x = F.struct((F.shiftright("_x", 34).cast("int") - 1).alias("r"), (bits(5, (1 << 29) - 1) - 1).alias("h"), (bits(4, 1) == 1).alias("ok"), bits(2, 3).alias("k"), bits(0, 3).alias("c"))
    e = e.withColumn("x", x)
    moved = (F.col("x.c") == _OPEN) | ((F.col("x.c") == _LEAD) & F.col("_through"))
    place = F.struct(F.when(moved, F.col("_to")).otherwise(F.col("_part")).alias("part"), F.col("x.c").alias("kind"), F.col("_part").alias("own"), F.col("step").alias("step"))
    r = lambda c: F.get(f"R_{c}", F.col("x.r"))
    has = F.col("x.k") > 0
    first, last = (lambda c: F.get(f"H_{c}", F.col("x.h"))), (lambda c: F.get(f"H_{c}", F.col("x.h") + F.col("x.k") - 1))
    all_of = lambda c: F.when(has, F.slice(f"H_{c}", F.col("x.h") + 1, F.col("x.k"))).otherwise(F.slice(f"H_{c}", F.lit(1), F.lit(0)))
    ms = lambda a, b: F.when((F.col("x.r") >= 0) & has, (a - b) * 1000.0)
    return classify_pairs(
        e.select(
            "config", *key, place.alias("position"),
            r("unit_id").alias("ref_unit_id"), all_of("unit_id").alias("hyp_unit_ids"),
            r("label").alias("ref_label_source"), all_of("label").alias("hyp_labels"),
            F.coalesce(r("phone_class"), F.when(has, first("phone_class"))).alias("phone_class"),
            ms(first("t_start"), r("t_start")).alias("onset_error_ms"), ms(last("t_end"), r("t_end")).alias("offset_error_ms"),
            F.col("x.k").alias("n_hyp_units"), F.col("x.ok").alias("_ok"),
        ), "ref_unit_id", "n_hyp_units", F.col("_ok"),
    ).drop("_ok")


def classify_pairs(df: DataFrame, ref_id: str, n_hyp: str, compatible: Column) -> DataFrame:
    """A5: omission, insertion, displacement (one-to-many included) or substitution."""
    t = (
        F.when(F.col(ref_id).isNull(), "insertion").when(F.col(n_hyp) == 0, "omission").when(F.col(n_hyp) > 1, "displacement")
        .when(compatible, "displacement").otherwise("substitution")
    )
    return df.withColumn("error_type", t)


# ---- edit alignments of short symbol sequences -------------------------------------------------

# fixed values: vowels of both kinds and the high vowels that differ by voicing only
ALL_VOWELS = frozenset(("a", "aː", "e", "eː", "i", "iː", "o", "oː", "ɯ", "ɯː", "ɨ", "ɨː", "i̥", "ɯ̥", "ɨ̥"))
HIGH_BASE = {"i": "I", "i̥": "I", "iː": "I", "ɯ": "U", "ɯ̥": "U", "ɨ": "U", "ɨ̥": "U", "ɯː": "U", "ɨː": "U"}


def _edit_table(cost: np.ndarray) -> np.ndarray:
    n, m = cost.shape
    step = np.arange(m + 1.0)
    d = np.empty((n + 1, m + 1))
    d[0] = step
    for i in range(n):
        best = d[i] + 1.0
        best[1:] = np.minimum(best[1:], d[i, :-1] + cost[i])
        d[i + 1] = np.minimum.accumulate(best - step) + step
    return d


def _back(d: np.ndarray, cost: np.ndarray) -> tuple[list[int], list[int]]:
    """Partner of each left position (-1 for none) and gap of each right position (-1 for paired)."""
    i, j = cost.shape
    left, right = [-1] * i, [-1] * j
    while i > 0 or j > 0:
        if i > 0 and j > 0 and abs(d[i, j] - d[i - 1, j - 1] - cost[i - 1, j - 1]) < 1e-9:
            i, j = i - 1, j - 1
            left[i] = j
        elif i > 0 and abs(d[i, j] - d[i - 1, j] - 1.0) < 1e-9:
            i -= 1
        else:
            j -= 1
            right[j] = i
    return left, right


def _unit_cost(a, b):
    return np.array([[0.0 if x == y else 1.0 for y in b] for x in a]).reshape(len(a), len(b))


def _sound_cost(a, b):
    def c(x, y):
        if x == y:
            return 0.0
        if (x in ALL_VOWELS) != (y in ALL_VOWELS):
            return 9.0
        return 0.4 if HIGH_BASE.get(x) is not None and HIGH_BASE.get(x) == HIGH_BASE.get(y) else 1.0

    return np.array([[c(x, y) for y in b] for x in a]).reshape(len(a), len(b))


@F.pandas_udf(_EDIT)
def _edit(a: pd.Series, b: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y, k in zip(a, b, kind):
        cost = (_unit_cost if k == "unit" else _sound_cost)(x, y)
        d = _edit_table(cost)
        left, gap = _back(d, cost)
        rows.append((float(d[-1, -1]), left, gap))
    return pd.DataFrame(rows, columns=["cost", "left", "gap_of"])


def edit_align(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """Edit alignment of two array columns, solved once per distinct pair.

    Adds ``cost``, ``left`` (position in b of each element of a, -1 for none)
    and ``gap_of`` (gap of a into which each element of b is inserted, -1 for none).
    """
    pairs = df.select(a, b).distinct().withColumn("_e", _edit(a, b, F.lit(kind)))
    return df.join(pairs.select(a, b, "_e.cost", "_e.left", "_e.gap_of"), [a, b])


def align_classes(df: DataFrame, a: str, b: str) -> DataFrame:
    """A3: unit-cost alignment; keeps the pairs (i, j) of equal elements."""
    e = edit_align(df, a, b, "unit")
    equal = F.filter(
        F.transform("left", lambda j, i: F.struct(i.alias("i"), j.alias("j"))),
        lambda p: (p["j"] >= 0) & (F.get(F.col(a), p["i"]) == F.get(F.col(b), p["j"])),
    )
    return e.withColumn("pairs", equal).drop("left", "gap_of")


def align_prons(df: DataFrame, a: str, b: str) -> DataFrame:
    """A4: weighted alignment of two pronunciations."""
    return edit_align(df, a, b, "sound")


def pair_deviations(df: DataFrame, key: list[str], site: str = "site") -> DataFrame:
    """Absolute edge deviations of the aligned pairs, all and beside the site.

    ``df``: key, ref and hyp (arrays of struct t_start, t_end, label) and the
    index of the site, whose pairs are site - 1 and site.
    """
    d = df.withColumn("_a", F.transform("ref", lambda x: x["label"])).withColumn("_b", F.transform("hyp", lambda x: x["label"]))
    e = align_classes(d, "_a", "_b").select(*key, site, "ref", "hyp", F.explode("pairs").alias("p"), F.size("ref").alias("n_ref"))
    r, h = F.get("ref", F.col("p.i")), F.get("hyp", F.col("p.j"))
    dev = F.explode(F.array(F.abs(r["t_start"] - h["t_start"]), F.abs(r["t_end"] - h["t_end"])))
    return e.select(*key, "n_ref", F.col("p.i").alias("i"), dev.alias("dev_s"), F.coalesce((F.col("p.i") == F.col(site)) | (F.col("p.i") == F.col(site) - 1), F.lit(False)).alias("at_site"))


def deviation_summary(devs: DataFrame, key: list[str]) -> DataFrame:
    """Medians of the deviations in ms and the share of reference symbols that found a partner."""
    from spanaccord.operators.quantile import medians

    d = devs.withColumn("dev_ms", F.col("dev_s") * 1000.0)
    n = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n_devs"), (F.count(F.lit(1)) / 2 / F.max("n_ref")).alias("coverage"))
    word = medians(d, key, "dev_ms", "dev_word_ms")
    return n.join(word, key).join(medians(d.where("at_site"), key, "dev_ms", "dev_site_ms"), key, "left")


def value_of(symbol: Column) -> Column:
    """V for a voiced vowel, D for a devoiced one, A for none, null for a consonant."""
    return F.when(symbol.isNull(), "A").when(symbol.isin(*VOICED_VOWELS), "V").when(symbol.isin(*DEVOICED_VOWELS), "D")


def values_at(places: DataFrame, lexicon: DataFrame, word: str = "word", pron: str = "pron") -> DataFrame:
    """Values that the variants of a word take at a position or in a gap of the chosen one.

    ``places``: word, pron (array), pos or gap.  Gives one row per place with
    ``vals`` (sorted, joined); places whose pronunciation is no variant drop out.
    Every variant in question is aligned with every variant of its word, once for all its places: the variants
    come in blocks, every pair of blocks is a row of its own, and what leaves it is one set of values a place.
    """
    lex = lexicon.select(F.col(word).alias("_word"), F.col(pron).alias("_pron")).where("_word is not null and _pron is not null").distinct()
    p = places.select(word, pron, "pos", "gap").distinct()
    known = p.join(lex, (p[word] == F.col("_word")) & (p[pron] == F.col("_pron")), "left_semi")
    asked = known.select(F.col(word).alias("_word"), F.col(pron).alias("_pron")).distinct()
    right = _blocks(lex)
    n = right.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_block")).alias("_to"))
    left = _blocks(asked).join(n, "_word").select("_word", F.col("_prons").alias("_left"), F.explode("_to").alias("_block"))
    met = left.join(right, ["_word", "_block"])
    seen = met.select("_word", F.explode(_block_values("_left", "_prons")).alias("_e")).select("_word", F.col("_e.pron").alias("_pron"), F.posexplode("_e.masks").alias("_at", "_mask"))
    seen = seen.groupBy("_word", "_pron", "_at").agg(F.bit_or("_mask").alias("_mask"))
    at = F.when(F.col("pos").isNotNull(), F.when(F.col("pos").between(0, F.size(pron) - 1), F.col("pos"))).when(F.col("gap").between(0, F.size(pron)), F.col("gap") + F.size(pron))
    k = known.withColumn("_p", at)
    j = k.join(seen, (k[word] == seen["_word"]) & (k[pron] == seen["_pron"]) & (k["_p"] == seen["_at"]), "left")
    bit = lambda b, v: F.when(F.col("_mask").bitwiseAND(F.lit(b)) > 0, v).otherwise("")
    vals = F.when(F.col("_mask").isNull(), "A").otherwise(F.concat(bit(1, "A"), bit(2, "D"), bit(4, "V")))
    return j.select(k[word], k[pron], "pos", "gap", vals.alias("vals"))


#: pronunciations in a block, and cells of the edit tables that are solved together
BLOCK, CELLS_AT_ONCE = 128, 1 << 20


def _blocks(prons: DataFrame) -> DataFrame:
    """(_word, _block, _prons): the distinct pronunciations of a word in blocks of about BLOCK."""
    n = prons.groupBy("_word").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    d = prons.join(n, "_word").withColumn("_block", F.pmod(F.xxhash64("_pron"), F.col("_n")))
    return d.groupBy("_word", "_block").agg(F.collect_list("_pron").alias("_prons"))


def _value_mask(symbol) -> int:
    """``value_of`` as a bit: A 1, D 2, V 4, none 0."""
    return 1 if symbol is None else 4 if symbol in VOICED_VOWELS else 2 if symbol in DEVOICED_VOWELS else 0


def _edit_tables(cost: np.ndarray) -> np.ndarray:
    """``_edit_table`` of many pairs of equal lengths."""
    k, n, m = cost.shape
    step = np.arange(m + 1.0)
    d = np.empty((k, n + 1, m + 1))
    d[:, 0] = step
    for i in range(n):
        best = d[:, i] + 1.0
        best[:, 1:] = np.minimum(best[:, 1:], d[:, i, :-1] + cost[:, i])
        d[:, i + 1] = np.minimum.accumulate(best - step, axis=1) + step
    return d


def _pair_masks(d: np.ndarray, cost: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The steps of ``_back`` for many pairs of equal lengths: value bits at the n positions, then in the n + 1 gaps."""
    k, n, m = cost.shape
    out = np.zeros((k, 2 * n + 1), dtype=np.int64)
    i, j = np.full(k, n), np.full(k, m)
    live = np.arange(k) if n or m else np.arange(0)
    while len(live):
        a, b = i[live], j[live]
        here = d[live, a, b]
        up, left = np.maximum(a - 1, 0), np.maximum(b - 1, 0)
        pair = np.zeros(len(live), dtype=bool)
        if n and m:
            c = cost[live, up, left]
            pair = (a > 0) & (b > 0) & (np.abs(here - d[live, up, left] - c) < 1e-9)
        lone = ~pair & (a > 0) & (np.abs(here - d[live, up, b] - 1.0) < 1e-9)
        put = ~pair & ~lone
        x = live[pair]
        out[x, up[pair]] = bits[x, left[pair]]
        x = live[lone]
        out[x, up[lone]] = 1
        x = live[put]
        out[x, n + a[put]] |= bits[x, left[put]]
        i[live] = a - (pair | lone)
        j[live] = b - (pair | put)
        live = live[(i[live] > 0) | (j[live] > 0)]
    gaps = out[:, n:]
    out[:, n:] = np.where(gaps & 4, 4, np.where(gaps & 2, 2, 1))
    return out


def _joint_masks(left: list, right: list) -> list[np.ndarray]:
    """For each pronunciation of ``left`` the value bits over all of ``right``, at its positions, then in its gaps."""
    symbols = sorted({x for p in (*left, *right) for x in p}, key=lambda x: (x is not None, x or ""))
    code = {x: c for c, x in enumerate(symbols)}
    table, bit = _sound_cost(symbols, symbols), np.array([_value_mask(x) for x in symbols], dtype=np.int64)

    def by_length(prons):
        out = {}
        for at, p in enumerate(prons):
            out.setdefault(len(p), []).append((at, [code[x] for x in p]))
        return [(n, [at for at, _ in v], np.array([c for _, c in v], dtype=np.int64).reshape(len(v), n)) for n, v in out.items()]

    masks = [np.zeros(2 * len(p) + 1, dtype=np.int64) for p in left]
    others = by_length(right)
    for n, at, a in by_length(left):
        for m, _, b in others:
            rows = max(1, CELLS_AT_ONCE // (len(b) * (n + 1) * (m + 1)))
            for lo in range(0, len(a), rows):
                some = a[lo:lo + rows]
                x, y = np.repeat(some, len(b), axis=0), np.tile(b, (len(some), 1))
                cost = table[x[:, :, None], y[:, None, :]] if n and m else np.zeros((len(x), n, m))
                got = _pair_masks(_edit_tables(cost), cost, bit[y] if m else np.zeros((len(x), 0), dtype=np.int64))
                joint = np.bitwise_or.reduce(got.reshape(len(some), len(b), 2 * n + 1), axis=1)
                for r, own in enumerate(at[lo:lo + rows]):
                    masks[own] |= joint[r]
    return masks


_MASKS = T.ArrayType(T.StructType([T.StructField("pron", T.ArrayType(T.StringType())), T.StructField("masks", T.ArrayType(T.LongType()))]))


@F.pandas_udf(_MASKS)
def _block_values(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([
        [{"pron": list(p), "masks": m.tolist()} for p, m in zip(x, _joint_masks([list(p) for p in x], [list(p) for p in y]))] for x, y in zip(left, right)
    ])
