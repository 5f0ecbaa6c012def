"""Scans and quantiles on skewed keys equal the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from spanaccord.operators import scan as S
from spanaccord.operators.quantile import quantiles, weighted_median


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 900
    k = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    pdf = pd.DataFrame({"k": k, "t": rng.integers(0, 500, n).astype(float), "i": np.arange(n), "v": rng.integers(-5, 9, n)})
    pdf["w"] = pd.array([None if x % 3 else int(x) for x in pdf["v"]], dtype="object")
    rows = [(str(r.k), float(r.t), int(r.i), int(r.v), r.w) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "k string, t double, i long, v long, w long")


def specs():
    return {
        "a": S.lag("v"), "b": S.lead("v"), "c": S.last_before("w"), "d": S.first_after("w"), "e": S.running_sum("v"),
        "f": S.max_before("v"), "g": S.number(), "h": S.total("v"), "m": S.min_from("v"), "an": S.lag("w"), "x": S.running_xor("w"),
    }


@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_equals_windows(spark, skewed, keys):
    pieces = S.with_pieces(skewed, keys, "t")
    assert pieces.agg(F.max("_piece")).first()[0] > 2
    got = S.scan(skewed, keys, ["t", "i"], specs())
    d = skewed.withColumn("one", F.lit(1))
    by = keys or ["one"]
    w = Window.partitionBy(*by).orderBy("t", "i")
    pre, post = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = d.select(
        "i", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"), F.last("w", True).over(pre).alias("c"), F.first("w", True).over(post).alias("d"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("e"), F.max("v").over(pre).alias("f"), F.row_number().over(w).cast("long").alias("g"),
        F.sum("v").over(Window.partitionBy(*by)).alias("h"), F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("m"), F.lag("w").over(w).alias("an"),
        F.bit_xor(F.coalesce("w", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
    )
    cols = want.columns
    a = got.select(cols).toPandas().sort_values("i").reset_index(drop=True).astype("float64")
    b = want.toPandas().sort_values("i").reset_index(drop=True).astype("float64")
    pd.testing.assert_frame_equal(a, b)


def test_plain_path_is_the_same(spark, skewed, whole_keys):
    assert not S.is_split(S.with_pieces(skewed, ["k"], "t"))
    got = S.scan(skewed, ["k"], ["t", "i"], specs()).toPandas().sort_values("i")
    spark.conf.set("spark.spanaccord.hotRows", "20")
    hot = S.scan(skewed, ["k"], ["t", "i"], specs()).toPandas().sort_values("i")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), hot[got.columns].reset_index(drop=True))


def test_quantiles_exact(skewed):
    pdf = skewed.toPandas()
    q = quantiles(skewed, ["k"], "t", {"a": 0.1, "b": 0.5, "c": 0.975}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(q.loc[k, ["a", "b", "c"]].astype(float), np.percentile(g.t, [10, 50, 97.5]))
    j = quantiles(skewed, ["k"], "t", {"a": 0.025, "b": 0.975}, "index").toPandas().set_index("k")
    z = quantiles(skewed, ["k"], "t", {"a": 0.025, "b": 0.975}, "index1").toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        s = sorted(g.t)
        assert list(j.loc[k]) == [s[int(0.025 * len(s))], s[int(0.975 * len(s))]]
        assert list(z.loc[k]) == [s[int(0.025 * (len(s) - 1))], s[int(0.975 * (len(s) - 1))]]


def test_weighted_median_conventions(spark):
    d = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 1), ("x", 3.0, 2), ("y", 5.0, 0), ("y", 6.0, 3), ("y", 9.0, 1)], "k string, v double, w int")
    low = {r.k: r.wmedian for r in weighted_median(d, ["k"], "v", "w").collect()}
    avg = {r.k: r.wmedian for r in weighted_median(d, ["k"], "v", "w", "average").collect()}
    assert low == {"x": 2.0, "y": 6.0}
    assert avg == {"x": 2.5, "y": 6.0}


def test_scans_by_one_key_deal_rows_out_once(spark, whole_keys):
    df = spark.createDataFrame([(f"k{i % 3}", float(i)) for i in range(30)], "k string, t double")
    s = S.scan(df, ["k"], ["t"], {"a": S.lag("t")})
    s = S.scan(s, ["k"], ["t"], {"b": S.running_sum("t"), "lo": S.lowest("t"), "hi": S.highest("t")})
    assert s._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert s.schema["k"].metadata["cool"] == ["k"]
    assert {(r.k, r.lo, r.hi) for r in s.collect()} == {(f"k{i}", float(i), float(27 + i)) for i in range(3)}


def test_lowest_and_highest_of_cut_keys(spark):
    rows = [("hot", float(i), float(i * 7 % 200) if i % 5 else None) for i in range(200)] + [("few", 1.0, None), ("few", 2.0, 4.0)]
    s = S.scan(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], ["t"], {"lo": S.lowest("v"), "hi": S.highest("v")}, keep_piece=True)
    assert s.select("_piece").distinct().count() > 2
    want = {k: [v for x, _, v in rows if x == k and v is not None] for k in ("hot", "few")}
    assert {(r.k, r.lo, r.hi) for r in s.collect()} == {(k, min(v), max(v)) for k, v in want.items()}
