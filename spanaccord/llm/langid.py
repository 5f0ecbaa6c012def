"""Operator 8: language identification, family first, then one-versus-one linear machines."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import bounded_sample, text_of

#: families of closely related languages (fixed values); a language not listed is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
}
BUCKETS = 1 << 13
#: characters read at once; whole texts are read in such steps
STEP = 1 << 20


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def sized_grams(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(size, bucket numbers) of all character grams of one to four letters, a step of text at a time.

    Case is folded, and everything but letters reads as one blank, so that markup,
    digits and noise carry no evidence.
    """
    for lo in range(0, len(text), STEP):
        c = np.frombuffer(text[lo : lo + STEP].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        letter = ((c >= 97) & (c <= 122)) | ((c >= 0xAA) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0xAB) & (c <= 0xBF) & (c != 0xB5) & (c != 0xBA)) & ~((c >= 0x2000) & (c <= 0x2BFF)) & ~((c >= 0x3000) & (c <= 0x303F)))
        c = np.where(letter, c, np.uint64(32))
        keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]
        c = c[keep]
        h = np.zeros(len(c), dtype=np.uint64)
        for size in range(1, 5):
            if len(c) < size:
                break
            n = len(c) - size + 1
            h = h[:n] * np.uint64(0x100000001B3) + c[size - 1 :] + np.uint64(1)
            x = h * np.uint64(0x9E3779B97F4A7C15)
            yield size, (x >> np.uint64(51)).astype(np.int64)


def _features(text: str) -> np.ndarray:
    v = np.zeros(BUCKETS, dtype=np.int64)
    for _, g in sized_grams(text):
        v += np.bincount(g, minlength=BUCKETS)
    v = np.sqrt(v).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


def _machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Linear support vector machine by averaged sub-gradient steps over some rows of x.

    y is +1 or -1; the last weight is the bias.  Only one part of the rows is copied at a time.
    """
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, mean, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    for r in range(rounds):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 64)):
            t += 1
            wrong = part[(x[rows[part]] @ w[:-1] + w[-1]) * y[part] < 1]
            w = w * (1 - 1 / (t + 10))
            if len(wrong):
                push = y[wrong] * weight[wrong] / (len(part) * c * (t + 10))
                w += np.r_[x[rows[wrong]].T @ push, push.sum()]
            norm = np.linalg.norm(w)
            if norm > 1 / np.sqrt(c):
                w /= norm * np.sqrt(c)
        if r >= rounds // 2:
            mean += w
    return mean / max(1, rounds - rounds // 2)


def _scale(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that fits the margins best, found by bisection of the likelihood's slope."""
    lo, hi = 1e-3, 50.0
    z = margin * y
    for _ in range(50):
        mid = (lo + hi) / 2
        if np.sum(z / (1 + np.exp(np.clip(mid * z, -500, 500)))) > 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


class Model:
    """Families by one machine each against the rest, languages inside a family by one machine for every two."""

    def __init__(self, langs: list[str], texts: list[str], fit: bool = True):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        x = np.array([_features(t) for t in texts]) if texts else np.zeros((0, BUCKETS))
        lang, fam = np.array(langs), np.array([family(v) for v in langs])
        every = np.arange(len(x))
        self.tasks: list[tuple] = []
        rows: list[np.ndarray] = []
        scales: list[float] = []

        def learn(task: tuple, on: np.ndarray, y: np.ndarray) -> None:
            w = _machine(x, on, y)
            self.tasks.append(task)
            rows.append(w)
            scales.append(_scale(np.array([x[i] @ w[:-1] for i in on]) + w[-1], y))

        if len(self.families) == 2:
            learn(("family", self.families[0]), every, np.where(fam == self.families[0], 1.0, -1.0))
        elif len(self.families) > 2:
            for f in self.families:
                learn(("family", f), every, np.where(fam == f, 1.0, -1.0))
        for f in self.families:
            for a, b in itertools.combinations(self.members[f], 2):
                on = np.flatnonzero((lang == a) | (lang == b))
                learn((f, a, b), on, np.where(lang[on] == a, 1.0, -1.0))
        self.weights = np.array(rows) if rows else np.zeros((0, BUCKETS + 1))
        self.scales = np.array(scales)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its probability, ``und`` and 0 for a text without letters or a model without languages."""
        if not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        p = 1 / (1 + np.exp(-np.clip(self.scales * (self.weights[:, :-1] @ _features(text) + self.weights[:, -1]), -500, 500)))
        by = dict(zip(self.tasks, p.tolist()))
        if len(self.families) == 1:
            share = {self.families[0]: 1.0}
        elif len(self.families) == 2:
            a = by["family", self.families[0]]
            share = {self.families[0]: a, self.families[1]: 1 - a}
        else:
            total = sum(by["family", f] for f in self.families) or 1.0
            share = {f: by["family", f] / total for f in self.families}
        f = max(self.families, key=lambda k: (share[k], k))
        votes = dict.fromkeys(self.members[f], 0.0)
        for task, q in by.items():
            if task[0] == f and len(task) == 3:
                votes[task[1]] += q
                votes[task[2]] += 1 - q
        best = max(votes, key=lambda k: (votes[k], k))
        pairs = len(votes) - 1
        return best, float(min(1.0, max(0.0, share[f] * (votes[best] / pairs if pairs else 1.0))))


def _shuffled(text: str, rng: np.random.Generator) -> str:
    return rng.permutation(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")).tobytes().decode("utf-32-le", "surrogatepass")


class Typical:
    """Whether a text reads like its language: the mean log probability of its three-letter grams, whatever the other languages.

    One half of each language's texts gives the probabilities, the other half the usual mean (the median) and
    its spread (from the median deviation).  A text is typical if its mean lies within ``width`` spreads below the
    usual one, or nearer to it than to the same texts with their letters shuffled; the spread of short texts
    is larger by that of single grams, which overlap in threes.  Of a language with few texts each half is
    held against the other; one with fewer than ``least`` texts in all rejects nothing, and neither does a text without a gram.
    """

    def __init__(self, langs: list[str], texts: list[str], width: float = 6.0, least: int = 20):
        self.width = width
        self.known: dict[str, tuple] = {}
        for lang in sorted(set(langs)):
            mine = sorted(t for k, t in zip(langs, texts) if k == lang)
            logs, held, mixed = self._halves(mine[::2], mine[1::2])
            if len(held) < least:
                # few texts: each half is also held against the other
                _, more, turned = self._halves(mine[1::2], mine[::2])
                held, mixed = held + more, mixed + turned
            if len(held) < least:
                continue
            mean, square, n = map(np.array, zip(*held))
            usual, single = float(np.median(mean)), float(np.median(square - mean**2)) * 3
            between = float(np.median((mean - usual) ** 2)) * 1.4826**2
            self.known[lang] = (logs, usual, between, single, max(0.0, usual - float(np.median(mixed))) / 2)

    def _halves(self, learn: list[str], hold: list[str]) -> tuple[np.ndarray, list[tuple], list[float]]:
        """Log probabilities of one half's grams, (mean, mean square, number) of each text of the other half, and the means of those shuffled."""
        counts = np.ones(BUCKETS)
        for t in learn:
            counts += self._grams(t)
        logs = np.log(counts / counts.sum())
        held = [(float(logs @ g) / n, float(logs**2 @ g) / n, n) for g in map(self._grams, hold) if (n := g.sum())]
        rng = np.random.default_rng(3)
        mixed = [float(logs @ g) / n for g in (self._grams(_shuffled(t, rng)) for t in hold if t) if (n := g.sum())]
        return logs, held, mixed

    @staticmethod
    def _grams(text: str) -> np.ndarray:
        v = np.zeros(BUCKETS, dtype=np.int64)
        for k, g in sized_grams(text):
            if k == 3:
                v += np.bincount(g, minlength=BUCKETS)
        return v

    def holds(self, text: str, lang: str) -> bool:
        if lang not in self.known:
            return True
        logs, usual, between, single, half = self.known[lang]
        g = self._grams(text)
        n = g.sum()
        return not n or bool(float(logs @ g) / n >= usual - max(half, self.width * np.sqrt(between + single / n)))


def sample(docs: DataFrame, training: Column, per_language: int = 500, max_chars: int = 3_000_000, languages: int = 64) -> DataFrame:
    """(lang, text): languages and texts to learn from, bounded as ``fit`` says."""
    rows = docs.where(training & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"), F.xxhash64(F.col("doc_id"), F.lit(8)).alias("_o")).where(F.length("text") > 0)
    return bounded_sample(rows, "lang", per_language, F.col("_o"), max_chars, classes=languages).select("lang", "text")


def _learnt(rows: DataFrame, kinds: tuple[type, ...]) -> list:
    """Objects of the given classes made from a bounded sample in one task: the driver holds their fields and no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        made = [k([r[0] for r in got], [r[1] for r in got]).__dict__ for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["fields"])

    made = rows.repartition(1).mapInArrow(run, "fields binary").first()
    out = []
    for k, fields in zip(kinds, [k([], []).__dict__ for k in kinds] if made is None else pickle.loads(bytes(made[0]))):
        out.append(k.__new__(k))
        out[-1].__dict__.update(fields)
    return out


def fit(docs: DataFrame, training: Column, per_language: int = 500, max_chars: int = 3_000_000, languages: int = 64) -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``training`` holds and lang is not null.

    The sample is bounded: at most ``per_language`` different texts and ``max_chars`` characters, in hash order, for each
    of the ``languages`` most frequent values of lang.  Nothing but text and lang is an input.
    """
    return _learnt(sample(docs, training, per_language, max_chars, languages), (Model,))[0]


def fit_typical(docs: DataFrame, training: Column, **bounds) -> tuple[Model, Typical]:
    """The model of ``fit`` and what its languages usually read like, from the same sample."""
    return tuple(_learnt(sample(docs, training, **bounds), (Model, Typical)))


def predict(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """``keep`` and (lang_pred, score) for each row of ``docs``; reads only ``text``.

    Whole texts are read.  A null text, or one without a letter, gives ``und`` with score 0; ties go to
    the language that sorts last.  Repeated rows are scored alike.
    """
    from pyspark.sql.pandas.functions import arrow_udf
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @arrow_udf(kind)
    def guess(texts: pa.Array) -> pa.Array:
        got = [model.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    return docs.select(*keep, guess(text_of()).alias("_guess")).select("*", "_guess.lang_pred", "_guess.score").drop("_guess")


def typical(docs: DataFrame, model: Model, known: Typical) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and reads like the language the model gives it.

    Without languages in the model every text with a letter stays.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        return pa.array([any(c.isalpha() for c in t) and (not model.langs or known.holds(t, model.predict(t)[0])) for t in texts.to_pylist()], pa.bool_())

    return docs.where(stays(text_of()))
