"""Operator 6: a quality score from compressed sizes under good and bad dictionaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import bounded_sample, text_of

#: bytes of a dictionary, and of the text it is built from
DICT_BYTES, LEVEL = 112_640, 9
#: a text is compressed in steps of so many bytes; every step counts
STEP = 1 << 17
#: bytes at which the curve has moved half of the way from the share of good texts to its own neutral difference
SHORT = 256


def build_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary trained on the texts, or their joined bytes where they are too few to train on."""
    import zstandard

    samples = [x for t in texts for b in [t.encode("utf-8", "surrogatepass")] for x in (b[i : i + 2048] for i in range(0, len(b), 2048)) if len(x) >= 8]
    if sum(map(len, samples)) >= 20 * size:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-size:]


@dataclass
class Model:
    """Two dictionaries and the logistic curve over the difference of the compressed sizes.

    The difference enters normalised by the sizes, with a slope that may follow the length, and by the root of the length.
    Length enters the calibration only: which difference is neutral moves with it.  ``share`` is that of good texts in
    the sample, the score of a text without a byte and the limit for ever shorter ones.
    """

    good: bytes
    bad: bytes
    slope: list[float]
    bias: float
    share: float = 0.5

    def scorer(self):
        """A function from texts to scores; compressors are made once."""
        import zstandard

        tools = []
        for d in (self.good, self.bad):
            z = zstandard.ZstdCompressionDict(d) if d else None
            if z is not None:
                z.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False))
        # what an empty text takes is no evidence
        empty = [len(t.compress(b"")) for t in tools]

        def features(text: str) -> tuple[float, ...]:
            b = text.encode("utf-8", "surrogatepass")
            good = bad = 0
            for i in range(0, len(b), STEP):
                x = b[i : i + STEP]
                good += len(tools[0].compress(x)) - empty[0]
                bad += len(tools[1].compress(x)) - empty[1]
            if not b:
                return 0.0, 0.0, 0.0, 0.0
            share = (bad - good) / (bad + good + 1)
            return share, share * math.log2(len(b)), (bad - good) / math.sqrt(len(b)), len(b) / (len(b) + SHORT)

        return features

    def score(self, f: np.ndarray, empty: np.ndarray | bool = False) -> np.ndarray:
        return np.where(empty, self.share, 1 / (1 + np.exp(-np.clip(f @ np.array(self.slope) + self.bias, -500, 500))))


def _logistic(x: np.ndarray, y: np.ndarray, start: float, rounds: int = 50, ridge: float = 1e-2) -> list[float]:
    """Slopes of a logistic curve that passes through ``start`` where all features are 0, by Newton steps with a small ridge."""
    sd = x.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, w = x / sd, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + start, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (w / sd).tolist()


def learn(good: list[str], bad: list[str]) -> Model:
    """Dictionaries from half of each list, the curve from the other half, which the dictionaries have not seen."""
    if not good or not bad:
        return Model(b"", b"", [0.0, 0.0, 0.0, 0.0], 4.0 if good or not bad else -4.0, float(bool(good) or not bad))
    cut = lambda v: (v[::2], v[1::2] or v)
    (gd, gc), (bd, bc) = cut(good), cut(bad)
    m = Model(build_dictionary(gd), build_dictionary(bd), [0.0, 0.0, 0.0, 0.0], 0.0, len(good) / (len(good) + len(bad)))
    f = m.scorer()
    x = np.array([f(t) for t in gc + bc])
    # no text is no evidence: the curve starts at the share of good texts
    m.bias = math.log(len(good) / len(bad))
    m.slope = _logistic(x, np.r_[np.ones(len(gc)), np.zeros(len(bc))], m.bias)
    return m


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = 2000, max_chars: int = 12_000_000) -> Model:
    """Learn from the texts of labelled rows where ``training`` holds.

    Bounded: ``per_class`` different texts and ``max_chars`` characters for each label, in hash order.
    Only text and the label are used.  Null labels and texts, and labels other than 0 and 1, take no part.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"), F.min("quality").alias("_p")).where("_q = _p")
    # thin the labels first, to about six times what is wanted of each of the two classes, so that no other text moves
    order, span = F.xxhash64(F.col("doc_id"), F.lit(6)), 1 << 30
    sizes = marks.groupBy("_q").agg(F.count("*").alias("_size"))
    marks = marks.join(F.broadcast(sizes), "_q").where(F.pmod(F.xxhash64(order, F.lit(1)), F.lit(span)).cast("double") * F.col("_size") <= float(6 * per_class * span)).select("doc_id", "_q")
    rows = docs.where(training & F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), rows["_id"] == marks["doc_id"]).select("_q", "text", F.xxhash64(F.col("_id"), F.lit(6)).alias("_o"))
    got = bounded_sample(rows, "_q", per_class, F.col("_o"), max_chars).orderBy("_q", "_o", "text").select("_q", "text").collect()
    return learn([r["text"] for r in got if r["_q"] == 1], [r["text"] for r in got if r["_q"] == 0])


def score(docs: DataFrame, model: Model, keep: list[Column], threshold: float = 0.3) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` for each row; reads only the whole ``text``.

    Null and empty texts have no compressed size and get the share of good texts in the sample; ties at the threshold count as 1.
    Repeated rows are scored alike.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        global _kept
        if _kept is None or _kept[0] is not model:
            _kept = (model, model.scorer())
        f = _kept[1]
        got = texts.to_pylist()
        return pa.array(model.score(np.array([f(t) for t in got]).reshape(len(got), 4), np.array([not t for t in got], dtype=bool)), pa.float64())

    return docs.select(*keep, run(text_of()).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_kept = None
