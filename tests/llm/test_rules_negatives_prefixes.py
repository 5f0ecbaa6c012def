"""Quality rules, hard negatives and the prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from spanaccord.llm import negatives, prefixes, queries, rules

SMALL = "/root/testdata/sf0.001"
WORDS = "the cat and a dog of one house in which it is for the day"


def brute_rules(text):
    words = [w for w in re.split("[ \\t-\\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \\t-\\r]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t ", "a b c a b c", "x\nx\n \n\ny\nx", WORDS, "ÄÖ 😀 #|& \x1f\x0b z", "a a a a", "w " * 30000, " ".join(f"word{i}" for i in range(50)), (WORDS + ".\n") * 9]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(60)]
    texts += [" ".join(f"{w}{i % 7}" if i % 3 else w for i, w in enumerate(rng.choice(WORDS.split(), 80))) for _ in range(10)]
    d = spark.createDataFrame([(i if i != 3 else None, t, "x", 1, "m") for i, t in enumerate(texts)] + [(2, texts[2], "x", 1, "m")], "doc_id long, text string, w string, n_words int, m string")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.verdicts(d).collect())
    assert got == Counter([(i if i != 3 else None, *brute_rules(t)) for i, t in enumerate(texts)] + [(2, *brute_rules(texts[2]))])
    kept = {r.doc_id: (r.kept, r.failed) for r in rules.verdicts(d).collect()}
    assert not any(k for k, _ in list(kept.values())[:9]) and kept[9] == (False, "stop_words_least") and kept[10][1] == "repeated_words_most,duplicate_lines_most"
    assert rules.verdicts(d.limit(0)).count() == 0
    own = rules.verdicts(d, (rules.Rule("short", "n_words", most=3),), base=()).where("kept").count()
    assert own == sum(brute_rules(t)[0] <= 3 for t in [*texts, texts[2]])


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(SMALL + "/labels.parquet")
    met = rules.verdicts(spark.read.parquet(SMALL + "/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert met.where("quality = 0 and kept").count() == 0 and met.where("quality = 1 and not kept").count() <= 1


def test_products_exact():
    rng = np.random.default_rng(1)
    for big in (3, 300, 10**6, 2**40, 2**62):
        for d in (0, 1, 64, 1500):
            a, b = rng.integers(-big, big + 1, (5, d)), rng.integers(-big, big + 1, (7, d))
            want = np.clip(a.astype(object) @ b.T.astype(object) if d else np.zeros((5, 7), object), -(2**63) + 1, 2**63 - 1)
            assert (negatives.products(a, b) == want).all()


@pytest.mark.parametrize("block,tile", [(4, 8), (16384, 1024)])
def test_hard_negatives_brute_force(spark, block, tile):
    rng = np.random.default_rng(2)
    big = 2**53
    rows = [(big + i, [float(x) for x in rng.integers(-1, 5, 3) / 64], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(i * 50, [0.25, 0.5, 0.25], i % 2) for i in range(40)] + [(7, [1.0, 2.0], 1), (100, [0.25, 0.5, 0.25], 0)]
    rows += [(None, [1.0] * 3, 1), (700, None, 1), (800, [1.0, None, 1.0], 1), (900, [float("inf")] * 3, 1), (1000, [1.0] * 3, None), (3000, [], 1), (3001, [], 1), (3002, [], 2), (4000, [400000.0] * 3, 1), (4001, [300000.0] * 3, 1), (4002, [200000.0] * 3, 2)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, ids string, rank int")
    ok = {(i, lab, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i in {i for i, _, _ in ok if i % 10 == 0}:
        lab, q = min((b, v) for a, b, v in ok if a == i)
        near = sorted((-sum(x * y for x, y in zip(q, v)), a, b == lab) for a, b, v in ok if a != i and len(v) == len(q))
        for s, p, _ in [x for x in near if x[2]][:5]:
            inside = [(t, n) for t, n, same in near if not same and 30 * -s <= 100 * -t <= 90 * -s]
            want |= {(i, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside[:10])}
    got = [tuple(r) for r in negatives.mine(d, F.col("vec_id") % 10 == 0, anchor_block=block, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert negatives.mine(d.limit(0), F.lit(True)).count() == 0


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seqs[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, s in seqs.items():
        for n in range(len(s) + 1):
            nodes.setdefault(s[:n], []).append(c)
    out = set()
    for s, members in nodes.items():
        inside = [w for w in nodes if w[: len(s)] == s]
        childless = [w for w in inside if not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(s))
        out.add((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), sum(len(w) == len(s) + 1 for w in inside), len(childless),
                 sum((len(nodes[w]) - 1) * len(w[-1][1].encode()) for w in inside if w), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [2, 8])
def test_prefix_trie_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(prefixes, "SLICE", 4)
    rng = np.random.default_rng(4)
    rows = [(int(c), int(t), str(rng.choice(["u", "v"])) if t else "u", str(rng.choice(["", "é", "hello"]))) for c in rng.integers(-20, 60, 60) for t in range(rng.integers(1, 13))]
    rows += [(1000 + i, t, "u", "same") for i in range(40) for t in range(6)] + [(2000, t, "u", f"long {t % 3}") for t in range(90)]
    rows += [(2005, 3, None, None), (2005, None, "u", "first"), (2005, 3, None, None), (2006, None, None, ""), (None, 1, "u", "x"), (2010, 1, "u", "x" * 50000)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k int, slice string")
    got = [tuple(r) for r in prefixes.prefix_trie(d, size=size).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)
    assert prefixes.prefix_trie(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_va_top_k", "op11_quality_rules", "op12_hard_negatives", "op13_prefix_trie"])
def test_sql(spark, name):
    msg, ok = compare(spark, duck(SMALL), queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert ok, msg
