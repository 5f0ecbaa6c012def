"""Components and the whole pipeline on small tables that hold every awkward case."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanaccord.llm import linededup
from spanaccord.llm.common import components


def classes(pairs):
    p = {x: x for e in pairs for x in e}

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[root(a)] = root(b)
    out = {}
    for x in p:
        out.setdefault(root(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_brute_force(spark, kind):
    rng = np.random.default_rng(21)
    pairs = [(i, i + 1) for i in range(40)] + [(500, 600 + i) for i in range(120)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (130, 2))] + [(7, 7), (3, 2), (3, 2)]
    pairs = [(int(a), int(b)) for a, b in pairs]
    make = str if kind == "string" else int
    d = spark.createDataFrame([(make(a), make(b)) for a, b in pairs], f"a {kind}, b {kind}")
    got = {}
    for r in components(d).collect():
        got.setdefault(r.root, []).append(r.node)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {frozenset(v) for v in got.values()} == {frozenset(map(make, c)) for c in classes([p for p in pairs if p[0] != p[1]])}
    assert components(d.limit(0)).count() == 0


def test_line_stage_with_clashing_names(spark):
    line = "a line of the corpus that is long enough to be compared"
    rows = [(1, line + "\n" + line, 5), (2, "x " + line, 6), (None, "own text of some length\nshort", 7), (4, None, 8), (5, line, 9)]
    names = ["t", "d", "gone", "_d", "_left", "pos", "near", "key", "line", "_row", "a b"]
    d = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    got = {r.doc_id: r for r in linededup.without_repeated_lines(d).collect()}
    assert list(got[1].asDict()) == d.columns and all(got[1][n] == i for i, n in enumerate(names))
    assert set(got) == {1, None, 4} and got[1].text == line and got[1].n_chars == len(line) and got[4].n_chars == 8


WORDS = {"en": "the of and with that this from what have been", "de": "der und das mit nicht eine von wird haben sein", "fr": "le les des avec une pour dans qui est pas", "es": "el los que para una con por las del como"}


def test_whole_pipeline(spark, tmp_path):
    """Every stage on the rows its predecessor kept: nulls, empties, repeated ids, copies, leaks, noise and clashing names."""
    import corpus_pipeline

    rng = np.random.default_rng(22)
    text = lambda lang, n: " ".join("".join(rng.permutation(list(w)))[:2] + w for w in rng.choice(WORDS[lang].split(), n))
    clean = [(i, "\n".join(text(k, 12) for _ in range(4)), k) for i, k in enumerate(sorted(WORDS) * 20)]
    item = text("en", 25)
    rows = [*clean, (200, clean[0][1], "de"), (201, clean[1][1] + " more", "en"), (202, text("en", 20) + " " + item + " " + text("en", 5), "en"), (203, None, None), (204, "", "en"), (205, "123 !!", "en")]
    rows += [(206, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(60)), "en"), (5, clean[5][1], clean[5][2]), (None, text("fr", 30), "fr"), (207, "\n".join([clean[9][1].split("\n")[0], text("es", 30)]), None)]
    d = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, "g") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, t int, gone string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    plain = sorted([i for i, *_ in clean] + [-1, 207])
    assert left["language"] == sorted([*plain, 5, 200, 201, 202])
    assert left["line_dedup"] == sorted([*plain, 201, 202]) or left["line_dedup"] == sorted([*plain, 5, 201, 202])
    assert set(left["near_dedup"]) >= set(plain) - {201} and 200 not in left["near_dedup"] and len(left["near_dedup"]) == len(set(left["near_dedup"]))
    assert 202 in left["near_dedup"] and set(left["decontaminate"]) == set(left["near_dedup"]) - {202}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id if p.doc_id is not None else -1 for p in pieces} == set(left["decontaminate"])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    spots = {}
    for p in pieces:
        spots.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in spots.values():
        ends = list(itertools.accumulate(n for _, n in sorted(s)))
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
    for empty in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{empty}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{empty}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
