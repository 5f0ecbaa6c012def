"""Operator 5: personal data by candidate spans and boosted trees, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
#: the base patterns.  Runs are possessive and are entered at their start or where the last match ended, which
#: leaves the matches as they are and keeps long runs linear
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: the wide generators: high recall, spans may overlap
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[{]at[)\]}]\x20?|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20dot\x20|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.,_:]\x20?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)\x20?)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){8,14}(?![0-9])",
}
#: characters before a candidate whose last words are its context; kept on both sides of a rewritten span
AROUND = 64
#: words before a candidate that are looked up, and the most words learnt for each kind
NEAREST = 3
WORDS = 100
#: other forms of the base spans: words for @ and dot; separators of addresses and of card numbers
AT_DOT = [(" (at) ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."), ("[at]", "[dot]"), (" (at) ", ".")]
IP_MARKS = [",", ", ", "_", ":", ". ", ": "]
CARD_MARKS = [".", "_", "/", "  ", "--", " /"]
#: number of other forms of a span; all together count as one span, so counts are in parts
FORMS = 6
SPAN = "array<struct<k:int,s:int,e:int>>"
FEATURES = ["length", "digits", "runs", "longest", "blanks", "hyphens", "dots", "brackets", "letters", "ends", "octets", "check", "glued"]
#: answers of a candidate: personal data, not personal data, unknown
TRUE, FALSE, UNKNOWN = 1, 0, -1


def _may(kind: str, text: Column) -> Column:
    """A cheap condition without which no candidate of the kind exists."""
    if kind == "email":
        return text.contains("@") | text.contains("at)") | text.contains("at]") | text.contains("at}")
    if kind == "phone":
        return text.rlike("[0-9]")
    return text.rlike("[0-9]")


def _starts(parts: Column, hits: Column) -> Column:
    """Offsets of the matches: code points of everything before each."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    lens = F.transform(hits, lambda m, i: F.struct(F.length(F.get(parts, i)).alias("p"), F.length(m).alias("m")))
    return F.aggregate(lens, zero, lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["p"])).alias("out")), lambda a: a["out"])


def _beside(parts: str, hits: str):
    def add(x: Column, i: Column) -> Column:
        before = F.concat(*[F.coalesce(F.right(t, F.lit(AROUND)), F.lit("")) for t in (F.get(F.col(parts), i - 1), F.get(F.col(hits), i - 1), F.get(F.col(parts), i))])
        return F.struct(x["s"].alias("s"), x["m"].alias("m"), F.right(before, F.lit(AROUND)).alias("b"), F.substring(F.get(F.col(parts), i + 1), 1, 1).alias("a"))

    return add


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    n = F.length(digits)
    def term(i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, i: a + F.coalesce(term(i), F.lit(0))) % 10 == 0)


def octets(m: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _find(df: DataFrame, text: str, patterns: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``_kind columns: array<struct<s, m, b, a>> of the leftmost non-overlapping matches.

    b and a are the AROUND characters before, across the neighbouring match, and the one after.
    """
    none = F.array().cast("array<string>")
    names = list(df.columns)
    df = df.select("*", *[F.when(_may(k, F.col(text)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_h_{k}") for k, p in patterns.items()])
    df = df.select("*", *[F.when(F.size(f"_h_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"_p_{k}") for k, p in patterns.items()])
    cols = []
    for k in patterns:
        at = _starts(F.col(f"_p_{k}"), F.col(f"_h_{k}"))
        cols.append(F.when(F.size(f"_h_{k}") > 0, F.transform(F.arrays_zip(at.alias("s"), F.col(f"_h_{k}").alias("m")), _beside(f"_p_{k}", f"_h_{k}"))).otherwise(F.array()).cast("array<struct<s:int,m:string,b:string,a:string>>").alias(f"{out}_{k}"))
    return df.select(*names, *cols)


def with_base(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the base spans (kind number, start, end), by kind as listed, then start."""
    names = list(df.columns)
    df = _find(df, text, BASE, "_b")

    def of(n: int, k: str) -> Column:
        good = F.filter(f"_b_{k}", lambda x: _valid(k, x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(n).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e")))

    per = [of(n, k) for n, k in enumerate(KINDS)]
    return df.select(*names, F.concat(*per).cast(SPAN).alias(out))


def _features(kind: int, x: Column) -> Column:
    m, before, after = x["m"], x["b"], x["a"]
    d = _digits(m)
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    runs = F.filter(F.split(m, "[^0-9]+"), lambda r: r != "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    values = {
        "length": F.length(m), "digits": F.length(d), "runs": F.size(runs), "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)),
        "blanks": count(" "), "hyphens": count("-"), "dots": count(r"\."), "brackets": count(r"[()\[\]{}]"), "letters": count("[^A-Za-z]").cast("int") * -1 + F.length(m),
        "ends": flag(m.rlike("[A-Za-z]{2,}$")), "octets": flag(octets(F.regexp_replace(m, "[^0-9]+", "."))), "check": flag(luhn(d)),
        "glued": flag(before.rlike("[A-Za-z0-9]$") | after.rlike("[A-Za-z0-9]")),
    }
    return F.array(*[values[n].cast("double") for n in FEATURES], F.lit(float(kind)))


def _words(before: Column) -> Column:
    """The last words of a text in lower case, the nearest first; every number is the word 0."""
    return F.slice(F.reverse(F.regexp_extract_all(F.regexp_replace(F.lower(before), "[0-9]+", "0"), F.lit(r"\p{L}+|0"), F.lit(0))), 1, NEAREST)


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<k, s, e, f, w>> of what the wide generators propose, with features and words before."""
    names = list(df.columns)
    df = _find(df, text, WIDE, "_w")

    def of(n: int, k: str) -> Column:
        return F.transform(f"_w_{k}", lambda x: F.struct(F.lit(n).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), _features(n, x).alias("f"), _words(x["b"]).alias("w")))

    per = [of(n, k) for n, k in enumerate(KINDS)]
    return df.select(*names, F.concat(*per).alias(out))


def _meets(spans: Column, c: Column, same_kind: bool) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]) & ((b["k"] == c["k"]) if same_kind else F.lit(True)))


def _written(x: Column, v: int, good: bool) -> Column:
    """A base span (k, m) in one of its FORMS other forms; not ``good`` with a check that fails, null where the kind has none."""
    m, d = x["m"], _digits(x["m"])
    pick = lambda options: F.lit(options[v])
    host = F.substring_index(m, "@", -1)
    host = host if good else F.concat(host, F.lit(".7"))
    email = F.concat(F.substring_index(m, "@", 1), pick([a for a, _ in AT_DOT]), F.replace(host, F.lit("."), pick([d for _, d in AT_DOT])))
    ip = F.replace(m if good else F.regexp_replace(m, "[0-9]+$", "999"), F.lit("."), pick(IP_MARKS))
    number = d if good else F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    card = F.regexp_replace(number, F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), pick(CARD_MARKS)))
    body = F.substr(m, F.lit(2))
    phone = [body, F.concat(F.lit("00"), body), F.replace(body, F.lit("-"), F.lit(".")), F.replace(body, F.lit(" "), F.lit("/")), d, F.concat(F.lit("00"), d)][v]
    return F.when(x["k"] == 0, email).when(x["k"] == 1, ip).when(x["k"] == 2, card).otherwise(phone if good else F.lit(None))


def _other_digits(m: Column, seed: Column) -> Column:
    """The text with every digit drawn anew by a hash."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.pmod(F.xxhash64(seed, i), F.lit(10)).cast("string")).otherwise(c)), "")


def _around(a: Column) -> Column:
    """A base span, and a word drawn by a hash from the same text, each with the characters on both sides; the kinds of spans that meet it."""
    x = F.col("_x")
    lo = F.greatest(a["s"] - AROUND, F.lit(0))
    at = F.pmod(F.xxhash64("_i", a["s"], F.lit(9)), F.length(x)).cast("int")
    left, right = F.substr(x, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))), F.substr(x, at + 1, F.lit(AROUND))
    head, tail = F.regexp_replace(left, r"\S*$", ""), F.regexp_replace(right, r"^\S*", "")
    word = F.struct((at - F.length(left) + F.length(head)).alias("s"), (at + F.length(right) - F.length(tail)).alias("e"))
    own = F.struct(F.substr(x, lo + 1, a["s"] - lo).alias("b"), F.substr(x, a["e"] + 1, F.lit(AROUND)).alias("a"))
    other = F.when(~F.exists("_base", lambda b: (b["s"] < word["e"]) & (word["s"] < b["e"])), F.struct(head.alias("b"), tail.alias("a")))
    met = F.transform(F.filter("_base", lambda b: (b != a) & (b["s"] < a["e"]) & (a["s"] < b["e"])), lambda b: b["k"])
    return F.struct(a["k"].alias("k"), a["s"].alias("at"), F.substr(x, a["s"] + 1, a["e"] - a["s"]).alias("m"), own.alias("own"), other.alias("other"), met.alias("met"))


def _rewritten(parts: DataFrame) -> DataFrame:
    """(o, k, f, w, answer): candidates over base spans that are written in each of their other forms.

    A base span in another form in its own place is personal data.  It is not with a check that was spoilt,
    and not with other digits in the place of some word of the text: so the words before tell how far the
    form alone decides.  Nor is a candidate of another kind or other bounds, but the answer is unknown where
    a base span of that kind meets the place.  All candidates over one base span share ``o``.
    """
    form = lambda answer, m, place, met: F.struct(F.lit(answer).alias("answer"), m.alias("m"), place["b"].alias("b"), place["a"].alias("a"), met.alias("met"))
    p = F.col("p")
    forms = []
    for v in range(FORMS):
        good = _written(p, v, True)
        decoy = F.when((p["k"] > 0) & p["other"].isNotNull(), _other_digits(good, F.xxhash64("_i", "p.at", F.lit(6))))
        forms += [form(TRUE, good, p["own"], p["met"]), form(FALSE, _written(p, v, False), p["own"], p["met"]), form(FALSE, decoy, p["other"], F.array().cast("array<int>"))]
    rows = parts.select(F.xxhash64("_i", "p.at", "p.k").alias("o"), F.col("p.k").alias("kind"), F.explode(F.array(*forms)).alias("w")).where("w.m is not null")
    rows = rows.select("o", "kind", "w.answer", "w.met", F.concat("w.b", "w.m", "w.a").alias("_y"), F.length("w.b").alias("lo"), (F.length("w.b") + F.length("w.m")).alias("hi"))
    met = with_candidates(rows, "_y", "_cand").select("o", "kind", "answer", "met", "lo", "hi", F.explode("_cand").alias("c")).where("c.s < hi and lo < c.e")
    right = (F.col("c.k") == F.col("kind")) & (F.col("c.s") == F.col("lo")) & (F.col("c.e") == F.col("hi"))
    answer = F.when(right, F.col("answer")).when(F.array_contains("met", F.col("c.k")), UNKNOWN).otherwise(FALSE)
    return met.select("o", "c.k", "c.f", "c.w", answer.alias("answer"))


def _tree(node, f: Column) -> Column:
    """A fitted tree as an expression over the feature array."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(f, F.lit(int(split.featureIndex()))) <= float(split.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Model:
    """Boosted trees as expressions, log odds of words before, and for each kind the least probability at which a span is taken."""

    def __init__(self, fitted, words: dict[str, float], thresholds: dict[int, float]):
        self.thresholds, self.words = thresholds, words
        self._roots = [t._call_java("rootNode") for t in fitted.trees] if fitted is not None else []
        self._weights = list(fitted.treeWeights) if fitted is not None else []

    def features(self, c: Column) -> Column:
        """The features of a candidate (k, f, w), then the log odds of the nearest word before and their sum over NEAREST words."""
        if not self.words:
            return F.concat(c["f"], F.array(F.lit(0.0), F.lit(0.0)))
        table = F.create_map(*[F.lit(x) for pair in sorted(self.words.items()) for x in pair])
        odds = F.transform(c["w"], lambda w: F.coalesce(F.try_element_at(table, F.concat_ws(" ", c["k"].cast("string"), w)), F.lit(0.0)))
        return F.concat(c["f"], F.array(F.coalesce(F.get(odds, F.lit(0)), F.lit(0.0)), F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)))

    def probability(self, c: Column) -> Column:
        def of(f: Column) -> Column:
            margin = reduce(lambda a, b: a + b, [_tree(r, f) * float(w) for r, w in zip(self._roots, self._weights)], F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2))

        return F.get(F.transform(F.array(self.features(c)), of), F.lit(0))


def _odds(drawn: DataFrame, least: int = 5, parts: int = 1) -> dict[str, float]:
    """Log odds of the nearest word before personal data against before all else, by kind; words seen ``least`` times, counted in ``parts``."""
    from pyspark.sql import Window

    yes = F.when(F.col("answer") == TRUE, F.col("n")).otherwise(F.lit(0))
    near = drawn.select("k", F.get("w", F.lit(0)).alias("w"), yes.alias("yes"), (F.col("n") - yes).alias("no")).where("w is not null")
    n = near.groupBy("k", "w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    all_yes, all_no = (F.sum(c).over(Window.partitionBy("k")) / parts for c in ("yes", "no"))
    odds = F.log((F.col("yes") / parts + 0.5) / (all_yes + 1)) - F.log((F.col("no") / parts + 0.5) / (all_no + 1))
    seen = n.withColumn("odds", odds).where(F.col("yes") + F.col("no") >= least * parts)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.abs("odds") * F.col("yes")), "w"))
    return {f"{r['k']} {r['w']}": r["odds"] for r in seen.withColumn("r", rank).where(F.col("r") <= WORDS).collect()}


def _thresholds(bins: list, precision: float, least: int, steps: int) -> dict[int, float]:
    """For each kind the least step whose held-out precision suffices (see ``fit``)."""
    out = {}
    for k in range(len(KINDS)):
        at = [dict.fromkeys((TRUE, FALSE, UNKNOWN), 0) for _ in range(steps + 1)]
        for r in bins:
            if r["k"] == k:
                at[r["bin"]][r["answer"]] += r["n"]
        above = {a: [sum(b[a] for b in at[i:]) for i in range(steps + 1)] for a in (TRUE, FALSE, UNKNOWN)}
        true, false, free = above[TRUE], above[FALSE], above[UNKNOWN]
        enough = [i for i in range(steps + 1) if true[i] >= least]
        prior = min([free[i] * true[0] / true[i] for i in enough], default=0)
        for i in enough:
            right = true[i] + prior * true[i] / true[0]
            if right >= precision * (true[i] + false[i] + free[i]):
                out[k] = i / steps
                break
    return out


def fit(docs: DataFrame, trees: int = 10, depth: int = 3, precision: float = 0.99, least: int = 30, few: int = 5) -> Model:
    """Boosted trees over candidate spans, calibrated on spans held out.

    Every base span, in each of its other forms, gives candidates of known answer (``_rewritten``):
    the span in another form in its own place is personal data; with a spoilt check, or with other digits in
    the place of another word of the text, it is not.  All candidates of the texts that meet no base span have
    no known answer; they are trained on as not personal at half weight.  No answer follows from a feature.
    The forms of a span count as one span together, so all counts are in parts of 1 / FORMS.
    The context is learnt too: log odds of the word before personal data against the word before all else.

    A kind's threshold is the least probability from which on the held-out precision is at least ``precision``
    over ``least`` true spans or more.  Candidates without an answer take part: as many count as right as their
    class prior says, which is the least ratio, over all thresholds, of their share to the share of the
    true ones; the rest count as wrong.  A kind without a threshold adds nothing.  All candidates of all texts
    count: equal ones are folded to one row with their number, and the trees are fitted on rows of equal
    features weighted by it; no leaf weighs less than ``few`` spans, so that one odd candidate does not decide a form.  Half of the candidates, by a hash, are held out, all over one base span together.
    Without examples of both answers no trees are fitted.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = docs.select(F.col("doc_id").cast("long").alias("_i"), text_of().alias("_x"))
    both = with_candidates(with_base(rows, "_x", "_base"), "_x", "_cand")
    free = F.filter("_cand", lambda c: ~_meets(F.col("_base"), c, False))
    # no filter on the arrays here: it would be pushed below them and compute all of them twice
    both = cut(both.select("_i", F.transform("_base", _around).alias("parts"), free.alias("free")))
    found = both.select("_i", F.explode("free").alias("c")).select(F.xxhash64("_i", "c.s", "c.k").alias("o"), "c.k", "c.f", "c.w", F.lit(UNKNOWN).alias("answer"), F.lit(FORMS).alias("n"))
    found = found.unionByName(_rewritten(both.select("_i", F.explode("parts").alias("p"))).withColumn("n", F.lit(1)))
    drawn = cut(found.groupBy("k", "answer", "f", "w", (F.pmod(F.xxhash64("o"), F.lit(2)) == 1).alias("held")).agg(F.sum("n").alias("n")))
    answers = {r["answer"] for r in drawn.select("answer").distinct().collect()}
    if TRUE not in answers or answers == {TRUE}:
        return Model(None, {}, {})
    held = F.col("held")
    m = Model(None, _odds(drawn.where(~held), parts=FORMS), {})
    c = F.struct("k", "f", "w")
    label = F.when(F.col("answer") == TRUE, 1.0).otherwise(0.0).alias("label")
    halves = F.when(F.col("answer") == UNKNOWN, 1).otherwise(2) * F.col("n")
    folded = drawn.where(~held).groupBy(label, m.features(c).alias("x")).agg(F.sum(halves).alias("halves"))
    train = cut(folded.select("label", "halves", (F.col("halves") / (2 * FORMS)).alias("weight"), array_to_vector("x").alias("features")))
    of = train.agg(F.count_distinct("label").alias("labels"), (F.sum("halves") / (2 * FORMS)).alias("weight")).first()
    if of.labels < 2:
        return Model(None, {}, {})
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, featuresCol="features", labelCol="label", weightCol="weight", minWeightFractionPerNode=min(0.49, few / of.weight)).fit(train)
    m = Model(fitted, m.words, {})
    steps = 50
    bins = drawn.where(held).groupBy("k", "answer", F.floor(m.probability(c) * steps).cast("int").alias("bin")).agg(F.sum("n").alias("n")).collect()
    m.thresholds = _thresholds(bins, precision, least * FORMS, steps)
    return m


def _join(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind number, start, end), x (the text).

    Offsets are code points, end exclusive.  ``base`` holds the matches of the base patterns that pass their
    checks; ``spans`` adds candidates that reach their kind's threshold and meet no other span, the most
    probable first, ties to the earlier start.  A null text is empty and has none; repeated rows are
    answered alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("x"))
    df = with_base(rows, "x", "base")
    if not model.thresholds:
        return df.select("doc_id", "x", "base", F.col("base").alias("spans"))
    df = with_candidates(df, "x", "cand")
    limit = F.array(*[F.lit(float(model.thresholds.get(k, 2.0))) for k in range(len(KINDS))])
    scored = F.transform("cand", lambda c: F.struct((-model.probability(c)).alias("p"), c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k")))
    df = df.withColumn("more", F.array_sort(F.filter(scored, lambda c: (-c["p"] >= F.get(limit, c["k"])) & ~_meets(F.col("base"), c, False))))
    taken = F.aggregate(
        F.transform("more", lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))), F.col("base"),
        lambda a, c: F.when(_meets(a, c, False), a).otherwise(F.concat(a, F.array(c)).cast(SPAN)),
    )
    return df.select("doc_id", "x", "base", F.when(F.size("more") > 0, F.array_sort(taken)).otherwise(F.col("base")).alias("spans"))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets; of overlapping spans the first start rules."""
    by_start = F.array_sort(F.transform("spans", lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e"), a["k"].alias("k"))))
    name = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def put(a: Column, c: Column) -> Column:
        return F.when(c["s"] < a["at"], F.struct(F.greatest(a["at"], c["e"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(c["e"].alias("at"), F.concat(a["out"], F.substr(F.col("x"), a["at"] + 1, c["s"] - a["at"]), F.get(name, c["k"])).alias("out")))
    text = F.aggregate(by_start, zero, put, lambda a: F.concat(a["out"], F.substr(F.col("x"), a["at"] + 1, F.length("x"))))
    return spans(docs, model).select("doc_id", text.alias("text"))


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """Counts of the base spans, their hash, and all spans as text."""
    df = spans(docs, model)

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == n)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.col("spans")).alias("spans"))
