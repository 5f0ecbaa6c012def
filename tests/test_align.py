"""Alignment against a direct solution of whole windows, and small worked cases."""

import random

import numpy as np
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from spanaccord.operators import align as A

MAP = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("d", "a"), ("a+b", "z")]


@pytest.fixture(scope="module")
def label_map(spark):
    return spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(MAP)], "ord int, source_label string, machine_label string, category string")


def best(ref, hyp, match=2, mismatch=-1, gap=-2, far=0.15):
    """All of one window at once; among equals 1:2, 1:3, 1:1, omission, addition, from the end."""
    ok = set(MAP)

    def near(r, f, l):
        return abs(f[1] - r[1]) <= far and abs(l[2] - r[2]) <= far

    def moves(i, j):
        if i and j:
            parts = ref[i - 1][3].split("+")
            for k in (2, 3):
                if j >= k and len(parts) == k and all((p, h[3]) in ok for p, h in zip(parts, hyp[j - k:j])) and near(ref[i - 1], hyp[j - k], hyp[j - 1]):
                    yield match * k, (i - 1, j - k)
            one = 2 * gap - 1
            if near(ref[i - 1], hyp[j - 1], hyp[j - 1]):
                one = match if (ref[i - 1][3], hyp[j - 1][3]) in ok else mismatch
            yield one, (i - 1, j - 1)
        if i:
            yield gap, (i - 1, j)
        if j:
            yield gap, (i, j - 1)

    @lru_cache(None)
    def score(i, j):
        return 0 if i == j == 0 else max(s + score(*to) for s, to in moves(i, j))

    out, i, j = [], len(ref), len(hyp)
    while i or j:
        for s, (p, q) in moves(i, j):
            if s + score(p, q) == score(i, j):
                out.append((ref[p][0] if p < i else None, tuple(h[0] for h in hyp[q:j])))
                i, j = p, q
                break
    return out[::-1]


def inside(ref, hyp):
    """Units of the second side that belong to the window of the first."""
    a, b = min(r[1] for r in ref), max(r[2] for r in ref)
    return [h for h in hyp if h[2] > a and h[1] < b and (a <= (h[1] + h[2]) / 2 < b or (h[1] >= a and h[2] <= b))]


def sides(spark, windows):
    r = [(f"f{w % 3}", f"w{w}", *u) for w, (ref, _) in enumerate(windows) for u in ref]
    h = [(f"f{w % 3}", f"w{w}", *u) for w, (_, hyp) in enumerate(windows) for u in hyp]
    cols = "file_id string, ipu_id string, unit_id string, t_start double, t_end double, {} string"
    ref = spark.createDataFrame(r, cols.format("label_source")).withColumn("phone_class", F.lit("x"))
    hyp = spark.createDataFrame(h, cols.format("label")).withColumn("phone_class", F.lit("x")).drop("ipu_id")
    return ref, hyp


def make(rng, w, n):
    """A window far from the others, with units of both sides at close times."""
    t, ref, hyp = 1000.0 * w, [], []
    # long units at both ends hold all others inside the window
    for k in range(n):
        d = rng.choice([0.02, 0.05, 0.1, 0.2, 0.4])
        if rng.random() < 0.85:
            ref.append((f"r{w}_{k}", round(t, 4), round(t + d, 4), rng.choice(["a", "b", "c", "d", "a+b", "b+c+a"])))
        for q in range(rng.choice([0, 1, 1, 1, 2])):
            s = t + rng.choice([-0.1, -0.03, 0.0, 0.02, 0.07, 0.12]) + q * d / 2
            hyp.append((f"h{w}_{k}_{q}", round(max(s, 1000.0 * w), 4), round(max(s, 1000.0 * w) + d * rng.choice([0.5, 1.0, 1.2]), 4), rng.choice(["a", "b", "c"])))
        t += d + rng.choice([0.0, 0.0, 0.0, 0.18, 0.3])
    ref.append((f"r{w}_end", round(t, 4), round(t + 3, 4), "c"))
    ref.sort(key=lambda x: (x[1], x[0]))
    hyp.sort(key=lambda x: (x[1], x[0]))
    return ref, hyp


def test_equals_direct_solution(spark, label_map):
    rng = random.Random(5)
    windows = [make(rng, w, rng.randint(1, 14)) for w in range(120)]
    ref, hyp = sides(spark, windows)
    got = {}
    for r in A.align_windows(ref, hyp, label_map).collect():
        got.setdefault(r.ipu_id, []).append((r.position, r.ref_unit_id, tuple(r.hyp_unit_ids)))
    cut = 0
    for w, (rf, hy) in enumerate(windows):
        rows = sorted(got[f"w{w}"], key=lambda x: tuple(x[0]))
        cut += len({p.own for p, _, _ in rows}) > 1
        assert [(a, b) for _, a, b in rows] == best(rf, inside(rf, hy)), w
    assert cut > 30                      # windows were really cut apart


def test_one_window_holding_most_rows(spark, label_map):
    rng = random.Random(8)
    windows = [make(rng, 0, 90)] + [make(rng, w, 2) for w in range(1, 6)]
    ref, hyp = sides(spark, windows)
    out = A.align_windows(ref, hyp, label_map).where("ipu_id = 'w0'").orderBy("position").collect()
    rows = [(r.position, r.ref_unit_id, tuple(r.hyp_unit_ids)) for r in out]
    assert [(a, b) for _, a, b in rows] == best(windows[0][0], inside(*windows[0]))


def test_worked_cases(spark, label_map):
    # exact, 80 ms shift, 160 ms shift, one to two, wrong label, extra unit
    ref = [("r1", 0.0, 0.1, "a"), ("r2", 1.0, 1.1, "b"), ("r3", 2.0, 2.1, "c"), ("r4", 3.0, 3.3, "a+b"), ("r5", 4.0, 4.1, "c"), ("r6", 5.0, 9.0, "a")]
    hyp = [("h1", 0.0, 0.1, "a"), ("h2", 1.08, 1.18, "b"), ("h3", 2.16, 2.26, "c"), ("h4", 3.0, 3.1, "a"), ("h5", 3.1, 3.3, "b"), ("h6", 4.0, 4.1, "b"), ("h7", 6.0, 6.2, "a")]
    r, h = sides(spark, [(ref, hyp)])
    out = [(x.ref_unit_id, tuple(x.hyp_unit_ids), x.error_type) for x in A.align_windows(r, h, label_map).orderBy("position").collect()]
    assert out == [
        ("r1", ("h1",), "displacement"), ("r2", ("h2",), "displacement"), (None, ("h3",), "insertion"), ("r3", (), "omission"),
        ("r4", ("h4", "h5"), "displacement"), ("r5", ("h6",), "substitution"), (None, ("h7",), "insertion"), ("r6", (), "omission"),
    ]


def test_shift_of_both_sides_changes_nothing(spark, label_map):
    rng = random.Random(2)
    ref, hyp = sides(spark, [make(rng, w, 8) for w in range(10)])
    move = lambda d: d.withColumn("t_start", F.col("t_start") + 64.0).withColumn("t_end", F.col("t_end") + 64.0)
    key = lambda d: sorted((x.ref_unit_id or "", tuple(x.hyp_unit_ids), x.error_type) for x in d.collect())
    a, b = A.align_windows(ref, hyp, label_map), A.align_windows(move(ref), move(hyp), label_map)
    assert key(a) == key(b)
    refs = [x.ref_unit_id for x in a.where("ref_unit_id is not null").collect()]
    assert len(refs) == len(set(refs)) == ref.count()


def test_window_times_keep_additions(spark, label_map):
    """Units beside the reference units but inside the window are additions; without window times they are outside."""
    r, h = sides(spark, [([("r1", 2.0, 2.1, "a")], [("h0", 1.0, 1.1, "b"), ("h1", 2.0, 2.1, "a"), ("h2", 3.0, 3.1, "c"), ("h3", 9.0, 9.1, "c")])])
    rows = lambda d: [(x.ref_unit_id, tuple(x.hyp_unit_ids), x.error_type) for x in A.align_windows(d, h, label_map).orderBy("position").collect()]
    wide = r.withColumn("ipu_start", F.lit(0.5)).withColumn("ipu_end", F.lit(4.0))
    assert rows(wide) == [(None, ("h0",), "insertion"), ("r1", ("h1",), "displacement"), (None, ("h2",), "insertion")]
    assert rows(r) == [("r1", ("h1",), "displacement")] == rows(wide.withColumn("ipu_start", F.lit(None).cast("double")).withColumn("ipu_end", F.lit(None).cast("double")))


def test_band_equals_full_table():
    """Scores of all cells, kept or not, are those of the full table."""
    rng = random.Random(9)
    for _ in range(200):
        n, m, far = rng.randint(0, 9), rng.randint(0, 12), rng.choice([0.05, 0.15, 0.4, 5.0])
        r0 = sorted(rng.uniform(0, 2) for _ in range(n))
        h0 = sorted(rng.uniform(0, 2) for _ in range(m))
        r1, h1 = [x + rng.uniform(0, 0.3) for x in r0], [x + rng.uniform(0, 0.3) for x in h0]
        lab = [rng.choice("abc") for _ in range(m)]
        parts = [[[p] for p in rng.choice(["a", "b", "ab", "bca"])] for _ in range(n)]
        ok = [p[0] if len(p) == 1 else None for p in parts]
        s = A._Band(np.array(r0), np.array(r1), ok, parts, np.array(h0), np.array(h1), lab, 2, -1, -2, far)
        full = [[-2 * j for j in range(m + 1)]]
        for i in range(n):
            row = []
            for j in range(m + 1):
                c = [full[i][j] - 2] + ([row[j - 1] - 2] if j else [])
                near = lambda f, e: abs(h0[f] - r0[i]) <= far and abs(h1[e] - r1[i]) <= far  # noqa: B023, E731
                if j and near(j - 1, j - 1):
                    c.append(full[i][j - 1] + (2 if ok[i] and lab[j - 1] in ok[i] else -1))
                k = len(parts[i])
                if 2 <= k <= min(3, j) and near(j - k, j - 1) and all(lab[j - k + q] in parts[i][q] for q in range(k)):
                    c.append(full[i][j - k] + 2 * k)
                row.append(max(c))
            full.append(row)
        assert [[s.at(i, j) for j in range(m + 1)] for i in range(n + 1)] == full


def test_sweep_far_limit(spark, label_map):
    r, h = sides(spark, [([("r1", 0.0, 0.3, "a")], [("h1", 0.1, 0.3, "a")])])
    grid = [dict(A.DEFAULT, config="near", far=0.05), A.DEFAULT]
    got = {(x.config, x.error_type) for x in A.align_windows(r, h, label_map, grid).collect()}
    assert got == {("near", "omission"), ("near", "insertion"), ("default", "displacement")}


def test_sweep_equals_each_parameter_set_alone(spark, label_map):
    rng = random.Random(12)
    ref, hyp = sides(spark, [make(rng, w, rng.randint(1, 12)) for w in range(40)])
    grid = [dict(A.DEFAULT, config="near", far=0.05), A.DEFAULT, dict(A.DEFAULT, config="wide", far=0.4), dict(A.DEFAULT, config="strict", match=3, mismatch=-5, gap=-1)]
    key = lambda d: sorted(((x.ipu_id, tuple(x.position), x.ref_unit_id or "", tuple(x.hyp_unit_ids), tuple(x.hyp_labels), x.error_type, x.n_hyp_units) for x in d.collect()))
    order = lambda rows: [(r[0], *r[2:]) for r in rows]  # noqa: E731  (pieces are numbered by the widest limit)
    got = A.align_windows(ref, hyp, label_map, grid)
    for c in grid:
        assert order(key(got.where(F.col("config") == c["config"]))) == order(key(A.align_windows(ref, hyp, label_map, [c])))


def test_sweep_deals_units_out_once(spark, label_map, whole_keys):
    """Rows are not multiplied by the parameter sets, and one exchange by file serves windows, pieces and arrays."""
    rng = random.Random(3)
    ref, hyp = sides(spark, [make(rng, w, 5) for w in range(12)])
    grid = [dict(A.DEFAULT, config=str(f), far=f) for f in (0.05, 0.1, 0.15)]
    plan = lambda g: A.align_windows(ref, hyp, label_map, g)._jdf.queryExecution().executedPlan().toString()
    one, three = plan(grid[:1]), plan(grid)
    below = three[three.index("ArrowEvalPython"):]
    assert one.count("Exchange hashpartitioning") == three.count("Exchange hashpartitioning") <= 4
    assert "0.15" in below and "0.05" not in below and "SortMergeJoin" not in below     # one cut by the widest limit


def test_files_without_units_on_a_side_are_left_out(spark, label_map):
    cols = "file_id string, ipu_id string, unit_id string, t_start double, t_end double, {} string, phone_class string"
    ref = spark.createDataFrame([("f", "w", "r1", 0.0, 1.0, "a", "x"), ("g", "w", "r2", 0.0, 1.0, "a", "x"), (None, "w", "r3", 0.0, 1.0, "a", "x"), ("k", None, "r4", 0.0, 1.0, "a", "x"), ("n", "w", "r5", 0.0, 1.0, "b", "x")], cols.format("label_source"))
    hyp = spark.createDataFrame([("f", "w", "h1", 0.0, 1.0, "a", "x"), ("q", "w", "h2", 0.0, 1.0, "a", "x"), (None, "w", "h3", 0.0, 1.0, "a", "x"), ("k", "w", "h4", 5.0, 6.0, "a", "x"), ("n", "w", "h5", None, None, "a", "x")], cols.format("label")).drop("ipu_id")
    got = sorted((x.file_id, x.ipu_id, x.ref_unit_id, tuple(x.hyp_unit_ids), x.error_type) for x in A.align_windows(ref, hyp, label_map).collect())
    assert got == [("f", "w", "r1", ("h1",), "displacement"), ("k", "_nofile", "r4", (), "omission"), ("n", "w", "r5", (), "omission")]


def edit(a, b, cost):
    @lru_cache(None)
    def d(i, j):
        if i == j == 0:
            return 0.0
        c = []
        if i and j:
            c.append(d(i - 1, j - 1) + cost(a[i - 1], b[j - 1]))
        if i:
            c.append(d(i - 1, j) + 1)
        if j:
            c.append(d(i, j - 1) + 1)
        return min(c)

    return d(len(a), len(b))


def test_edit_alignments(spark):
    rng = random.Random(1)
    syms = ["i", "i̥", "ɯ", "ɯ̥", "k", "s", "a"]
    rows = [([rng.choice(syms) for _ in range(rng.randint(0, 6))], [rng.choice(syms) for _ in range(rng.randint(0, 6))]) for _ in range(150)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a array<string>, b array<string>")

    def sound(x, y):
        if x == y:
            return 0.0
        if (x in A.ALL_VOWELS) != (y in A.ALL_VOWELS):
            return 9.0
        return 0.4 if A.HIGH_BASE.get(x, 0) == A.HIGH_BASE.get(y, 1) else 1.0

    for r in A.align_prons(d, "a", "b").collect():
        assert r.cost == pytest.approx(edit(tuple(r.a), tuple(r.b), sound))
        paid = sum(sound(x, r.b[j]) if j >= 0 else 1.0 for x, j in zip(r.a, r.left)) + sum(g >= 0 for g in r.gap_of)
        assert paid == pytest.approx(r.cost)
    for r in A.align_classes(d, "a", "b").collect():
        assert r.cost == edit(tuple(r.a), tuple(r.b), lambda x, y: float(x != y))
        assert all(r.a[p.i] == r.b[p.j] for p in r.pairs)


def test_values_at(spark):
    lex = spark.createDataFrame([("w", ["k", "i", "t"]), ("w", ["k", "i̥", "t"]), ("w", ["k", "t"]), ("v", ["k", "i"])], "word string, pron array<string>")
    p = spark.createDataFrame([("w", ["k", "i", "t"], 1, None), ("w", ["k", "t"], None, 1), ("v", ["k", "i"], 1, None), ("v", ["k"], 0, None)], "word string, pron array<string>, pos int, gap int")
    got = {(r.word, tuple(r.pron), r.pos, r.gap): r.vals for r in A.values_at(p, lex).collect()}
    assert got == {("w", ("k", "i", "t"), 1, None): "ADV", ("w", ("k", "t"), None, 1): "ADV", ("v", ("k", "i"), 1, None): "V"}


def test_values_of_blocks_as_pair_by_pair():
    rng = random.Random(8)
    sounds = [*"ksat", "i", "i̥", "ɯ", "ɯ̥", "aː", None]
    prons = [[rng.choice(sounds) for _ in range(rng.choice([0, 1, 2, 3, 4, 6]))] for _ in range(60)]
    left, right = prons[:25], prons[10:]
    got = A._joint_masks(left, right)
    for p, masks in zip(left, got):
        want = [0] * (2 * len(p) + 1)
        for v in right:
            cost = A._sound_cost(p, v)
            partner, gap = A._back(A._edit_table(cost), cost)
            for i, j in enumerate(partner):
                want[i] |= A._value_mask(v[j]) if j >= 0 else 1
            for g in range(len(p) + 1):
                put = [A._value_mask(x) for x, at in zip(v, gap) if at == g]
                want[len(p) + g] |= 4 if 4 in put else 2 if 2 in put else 1
        assert masks.tolist() == want


def test_values_at_of_a_word_with_several_blocks(spark):
    prons = [[a, b, c, d] for a in ("i", "i̥", "ɯ", "ɯ̥") for b in ("k", "s", "t") for c in ("i", "i̥", "ɯ", "ɯ̥") for d in ("i", "i̥", "ɯ", "ɯ̥")]
    lex = spark.createDataFrame([("w", p) for p in prons], "word string, pron array<string>")
    some = [("w", prons[0], 0, None), ("w", prons[0], 1, None), ("w", prons[0], 9, None), ("w", prons[0], None, 2), ("w", ["k"], 0, None), ("w", prons[5], None, 7)]
    got = {(len(r.pron), r.pos, r.gap): r.vals for r in A.values_at(spark.createDataFrame(some, "word string, pron array<string>, pos int, gap int"), lex).collect()}
    assert got == {(4, 0, None): "DV", (4, 1, None): "", (4, 9, None): "A", (4, None, 2): "A", (4, None, 7): "A"}
