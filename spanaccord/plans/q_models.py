"""Queries for regression, cross-validation, set operations and audit."""

from pyspark.sql import functions as F

from spanaccord import settings
from spanaccord.operators import aggregate as G, audit as Q, models as L, sampling as D, scoring as M, sets as U
from spanaccord.operators.resample import cross_products
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, HYP, PAIRED, PHONES, UNITS
from spanaccord.plans.q_joins import runs
from spanaccord.plans.q_scoring import CELL
from spanaccord.plans.q_resample import FULL, boot_sql, weights_sql
from spanaccord.plans.registry import query

ONE = F.lit


def xcols():
    return [F.lit(1.0), (F.col("length_class") == "O").cast("double"), F.col("is_accent_nucleus").cast("double")]


NAMES = ["intercept", "length_O", "nucleus"]
P2 = """p2 AS (SELECT *, ln(dur_hand_ms) AS yh, ln(dur_mfa_ms) AS ym, ln(dur_mfa_ms) - ln(dur_hand_ms) AS yd, (length_class = 'O')::INT::DOUBLE AS x1, is_accent_nucleus::INT::DOUBLE AS x2 FROM paired)"""
# two regressors in closed form from variances and covariances
B2 = "(covar_samp({y}, x1) * var_samp(x2) - covar_samp({y}, x2) * covar_samp(x1, x2)) / (var_samp(x1) * var_samp(x2) - pow(covar_samp(x1, x2), 2))"
B3 = "(covar_samp({y}, x2) * var_samp(x1) - covar_samp({y}, x1) * covar_samp(x1, x2)) / (var_samp(x1) * var_samp(x2) - pow(covar_samp(x1, x2), 2))"


def two(y, by="", grp=""):
    return f"""c AS (SELECT {by} count(*) AS n, {B2.format(y=y)} AS b1, {B3.format(y=y)} AS b2, avg({y}) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM p2 {grp}),
  t AS (SELECT {by} n, 'intercept' AS term, my - b1 * m1 - b2 * m2 AS estimate FROM c UNION ALL SELECT {by} n, 'length_O', b1 FROM c UNION ALL SELECT {by} n, 'nucleus', b2 FROM c)"""


@query("l01_ols", "WITH " + two("yh", "vowel,", "GROUP BY vowel") + " SELECT vowel, term, n, estimate FROM t", "estimate", [PAIRED, P2])
def l01(spark, sf):
    return L.ols(B.paired(spark, sf), xcols(), F.log("dur_hand_ms"), NAMES, ["vowel"]).drop("se")


@query("l01_ols_se", """SELECT 'length_O' AS term, count(*) AS n, regr_slope(yd, x1) AS estimate, sqrt((regr_syy(yd, x1) - regr_slope(yd, x1) * regr_sxy(yd, x1)) / (count(*) - 2) / regr_sxx(yd, x1)) AS se FROM p2""", "estimate se", [PAIRED, P2], digits=8)
def l01b(spark, sf):
    d = L.ols(B.paired(spark, sf), xcols()[:2], F.log("dur_mfa_ms") - F.log("dur_hand_ms"), NAMES[:2])
    return d.where("term = 'length_O'")


@query("l01_absorbed", """WITH p3 AS (SELECT yd - avg(yd) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM p2 WINDOW w AS (PARTITION BY file_id)), s AS (SELECT count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(x1 * y) AS e, sum(x2 * y) AS f FROM p3)
  SELECT 'length_O' AS term, n, (e * d - f * b) / (a * d - b * b) AS estimate FROM s UNION ALL SELECT 'nucleus', n, (f * a - e * b) / (a * d - b * b) FROM s""", "estimate", [PAIRED, P2], digits=8)
def l01c(spark, sf):
    y = F.log("dur_mfa_ms") - F.log("dur_hand_ms")
    return L.ols_absorbed(B.paired(spark, sf), xcols()[1:], y, NAMES[1:], "file_id").drop("se")


@query("l02_paired_effect", "WITH " + two("yd") + " SELECT term, n, estimate FROM t", "estimate", [PAIRED, P2], digits=8)
def l02(spark, sf):
    return L.paired_effect(B.paired(spark, sf), "dur_hand_ms", "dur_mfa_ms", xcols(), NAMES).drop("se")


def cv_data(spark, sf, k=3, keep=()):
    """Decisions with a log deviation, a process and a speaker-grouped fold."""
    d = B.decisions(spark, sf).where("dev_site_ms is not null")
    d = d.select("cand_id", "process", "speaker", "word_type", "correct", F.log(F.col("dev_site_ms") + 1.0).alias("zl"))
    d = d.withColumn("correct", F.when((F.col("zl") > 3.2) & (F.length("cand_id") % 3 == 0), 1 - F.col("correct")).otherwise(F.col("correct")))
    d = d.select("process", "speaker", *keep, "correct", "zl")
    return settings.kept(d.join(D.grouped_folds(d, "speaker", k), "speaker"), "cv")


#: the rows of ``cv_data``
CV = """cv0 AS (SELECT cand_id, process, speaker, word_type, correct, ln(dev_site_ms + 1.0::DOUBLE) AS zl FROM dcs WHERE dev_site_ms IS NOT NULL),
  cv AS (SELECT * REPLACE (CASE WHEN zl > 3.2::DOUBLE AND length(cand_id) % 3 = 0 THEN 1 - correct ELSE correct END AS correct), idx % 3 AS fold FROM cv0 JOIN (SELECT speaker, row_number() OVER (ORDER BY md5(speaker), speaker) - 1 AS idx FROM (SELECT DISTINCT speaker FROM cv0)) USING (speaker))"""
STEPS = 9


def newton_sql(m: str, level: str, slope: str, z: str = "zl", src: str = "cv") -> str:
    """Newton steps written out: an intercept for each value of ``level`` and a slope for each of ``slope`` ('' for none).

    The intercepts are solved for first, which leaves one equation for each slope.
    """
    ctes = [f"{m}0 AS (SELECT t, {level} AS lv, {slope or "''"} AS sl, 0::DOUBLE AS a, 0::DOUBLE AS b FROM {src}, (SELECT unnest([0, 1, 2]) AS t) GROUP BY ALL)"]
    for i in range(STEPS):
        ctes.append(f"""{m}s{i} AS (SELECT t, lv, sl, a, b, sum(correct - p) AS ga, sum((correct - p) * z) AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * z) AS hab, sum(p * (1 - p) * z * z) AS hbb
    FROM (SELECT t, lv, sl, a, b, correct, {z} AS z, 1 / (1 + exp(-(a + b * {z}))) AS p FROM {src} JOIN {m}{i} ON t <> fold AND lv = {level} AND sl = {slope or "''"}) GROUP BY 1, 2, 3, 4, 5),
  {m}d{i} AS (SELECT *, {"sum(gb - hab * ga / haa) OVER w / sum(hbb - hab * hab / haa) OVER w" if slope else "0::DOUBLE"} AS db FROM {m}s{i} WINDOW w AS (PARTITION BY t, sl)),
  {m}{i + 1} AS (SELECT t, lv, sl, a + (ga - hab * db) / haa AS a, b + db AS b FROM {m}d{i})""")
    return ",\n  ".join(ctes) + f""",
  {m}p AS (SELECT process, speaker, correct, 1 / (1 + exp(-(a + b * {z}))) AS p FROM {src} JOIN {m}{STEPS} ON t = fold AND lv = {level} AND sl = {slope or "''"})"""


def newton_two_sql(m: str, z: tuple[str, str], src: str) -> str:
    """Newton steps written out: one intercept and two slopes."""
    x = ["1", *z]
    p = f"1 / (1 + exp(-(b0 + b1 * {z[0]} + b2 * {z[1]})))"
    sums = [f"sum((correct - p) * {x[i]}) AS g{i}" for i in range(3)] + [f"sum(p * (1 - p) * {x[i]} * {x[k]}) AS h{i}{k}" for i in range(3) for k in range(i, 3)]
    ctes = [f"{m}0 AS (SELECT unnest([0, 1, 2]) AS t, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2)"]
    for i in range(STEPS):
        ctes.append(f"""{m}s{i} AS (SELECT t, b0, b1, b2, {", ".join(sums)} FROM (SELECT *, {p} AS p FROM {src} JOIN {m}{i} ON t <> fold) GROUP BY 1, 2, 3, 4),
  {m}r{i} AS (SELECT *, g1 - h01 * g0 / h00 AS e, g2 - h02 * g0 / h00 AS f, h11 - h01 * h01 / h00 AS a, h12 - h01 * h02 / h00 AS c, h22 - h02 * h02 / h00 AS d FROM {m}s{i}),
  {m}d{i} AS (SELECT *, (e * d - f * c) / (a * d - c * c) AS d1, (f * a - e * c) / (a * d - c * c) AS d2 FROM {m}r{i}),
  {m}{i + 1} AS (SELECT t, b0 + (g0 - h01 * d1 - h02 * d2) / h00 AS b0, b1 + d1 AS b1, b2 + d2 AS b2 FROM {m}d{i})""")
    return ",\n  ".join(ctes) + f""",
  {m}p AS (SELECT process, speaker, correct, {p} AS p FROM {src} JOIN {m}{STEPS} ON t = fold)"""


def _auc_sql(rows: str, by: str = "") -> str:
    """Pairs won by positives (ties half) and all pairs of a table with p and correct."""
    part, group = (f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "")
    return f"(SELECT {by + ',' if by else ''} sum(pos * (below - neg + neg / 2)) AS u, sum(pos) * sum(neg) AS pairs FROM (SELECT *, sum(neg) OVER ({part}ORDER BY p) AS below FROM (SELECT {by + ',' if by else ''} p, sum(correct)::DOUBLE AS pos, sum(1 - correct)::DOUBLE AS neg FROM (SELECT * REPLACE (round(p, 12) AS p) FROM {rows}) GROUP BY {by + ',' if by else ''} p)) {group})"


MODELS = {"process": ("process", ""), "boundary": ("''", "'x'"), "process+boundary": ("process", "'x'"), "process*boundary": ("process", "process")}


@query("l03_cv_logit", f"WITH {DEC}, {CV}, " + ", ".join(newton_sql(f"m{i}", *m) for i, m in enumerate(MODELS.values())) + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS model, (SELECT u / pairs FROM {_auc_sql(f'm{i}p')}) AS pooled_auc, (SELECT sum(u) / sum(pairs) FROM {_auc_sql(f'm{i}p', 'process')}) AS stratified_auc, avg(u / pairs) AS mean_auc, count(*) AS n_used FROM {_auc_sql(f'm{i}p', 'speaker')} WHERE pairs > 0" for i, name in enumerate(MODELS)),
    "pooled_auc stratified_auc mean_auc")
def l03(spark, sf):
    d, designs = L.design_columns(cv_data(spark, sf), "process", ["A", "N", "R"], F.col("zl"))
    # equal up to the twelfth digit counts as equal; ``round`` would write every number out in decimals
    p = L.grouped_cv_logits(d, "correct", "fold", [0, 1, 2], designs).withColumns({f"p_{m}": F.rint(F.col(f"`p_{m}`") * 1e12) / 1e12 for m in designs})
    return L.cv_reports(p, list(designs), "speaker", "correct", ["process"])


TE = """dc AS (SELECT cand_id, speaker, word_type, correct, idx % 3 AS fold FROM dcs JOIN (SELECT speaker, row_number() OVER (ORDER BY md5(speaker), speaker) - 1 AS idx FROM (SELECT DISTINCT speaker FROM dcs)) USING (speaker))"""


@query("l04_target_encode", """WITH c AS (SELECT *, sum(correct) OVER (PARTITION BY word_type) - sum(correct) OVER (PARTITION BY word_type, fold) AS k, count(*) OVER (PARTITION BY word_type) - count(*) OVER (PARTITION BY word_type, fold) AS n,
  (sum(correct) OVER () - sum(correct) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)) AS g FROM dc) SELECT cand_id, (k + 5 * g) / (n + 5) AS p_word FROM c""", "p_word", [DEC, TE])
def l04(spark, sf):
    d = B.decisions(spark, sf).select("cand_id", "speaker", "word_type", "correct")
    d = d.join(D.grouped_folds(d, "speaker", 3), "speaker")
    return L.target_encode(d, "word_type", "correct", "fold").select("cand_id", "p_word")


@query("l04_target_encode_train", """WITH g AS (SELECT avg(correct) AS g FROM dc WHERE fold <> 1), s AS (SELECT word_type, sum(correct) AS k, count(*) AS n FROM dc WHERE fold <> 1 GROUP BY 1)
  SELECT cand_id, (coalesce(k, 0) - CASE WHEN fold <> 1 THEN correct ELSE 0 END + 5 * g) / (coalesce(n, 0) - CASE WHEN fold <> 1 THEN 1 ELSE 0 END + 5) AS p_word FROM dc LEFT JOIN s USING (word_type), g""", "p_word", [DEC, TE])
def l04b(spark, sf):
    d = B.decisions(spark, sf).select("cand_id", "speaker", "word_type", "correct")
    d = d.join(D.grouped_folds(d, "speaker", 3), "speaker")
    return L.target_encode(d, "word_type", "correct", "fold", test_fold=1).select("cand_id", "p_word")


#: ``cv`` with the log odds of the word outside the fold
CV_WORD = """cl AS (SELECT *, ln(q / (1 - q)) AS lo FROM (SELECT *, least(greatest((k + 5 * g) / (n + 5), 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS q FROM (SELECT *, sum(correct) OVER (PARTITION BY word_type) - sum(correct) OVER (PARTITION BY word_type, fold) AS k,
    count(*) OVER (PARTITION BY word_type) - count(*) OVER (PARTITION BY word_type, fold) AS n, (sum(correct) OVER () - sum(correct) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)) AS g FROM cv)))"""


@query("l05_cv_gain", f"""WITH {DEC}, {CV}, {CV_WORD}, {newton_sql("m0", "''", "'x'", "lo", "cl")}, {newton_two_sql("m1", ("lo", "zl"), "cl")},
  a0 AS (SELECT speaker, u / nullif(pairs, 0) AS auc0 FROM {_auc_sql("m0p", "speaker")}), a1 AS (SELECT speaker, u / nullif(pairs, 0) AS auc1 FROM {_auc_sql("m1p", "speaker")}),
  v AS (SELECT *, auc1 - auc0 AS v FROM a0 JOIN a1 USING (speaker)), {weights_sql("cw", "(SELECT * FROM v WHERE v IS NOT NULL)", "speaker", reps=FULL)}, r AS (SELECT b, sum(v * w) / sum(w) AS value FROM v JOIN cw USING (speaker) GROUP BY 1)
  SELECT * FROM (SELECT avg(auc0) AS auc0, avg(auc1) AS auc1, avg(v) AS gain, count(v) AS n_clusters, avg(v) < 0.02 AS small_increment FROM v), ({boot_sql("")})""", "auc0 auc1 gain se low high")
def l05(spark, sf):
    d = L.target_encode(cv_data(spark, sf, keep=["word_type"]), "word_type", "correct", "fold").withColumn("lo", L.logit(F.col("p_word")))
    return L.cv_gain(settings.kept(d, "cv"), "correct", "speaker", "fold", [0, 1, 2], ["lo"], ["zl"], FULL)


@query("l06_wald", """WITH s AS (SELECT count(*) AS n, regr_slope(yd, x1) AS b, regr_intercept(yd, x1) AS a, regr_sxx(yd, x1) AS sxx, avg(x1) AS mx, (regr_syy(yd, x1) - regr_slope(yd, x1) * regr_sxy(yd, x1)) / (count(*) - 2) AS s2 FROM p2),
  c AS (SELECT 'slope' AS combo, b AS estimate, sqrt(s2 / sxx) AS se FROM s UNION ALL SELECT 'sum', a + b, sqrt(s2 * (1.0 / n + pow(1 - mx, 2) / sxx)) FROM s) SELECT *, estimate - 1.96::DOUBLE * se AS low, estimate + 1.96::DOUBLE * se AS high, pow(estimate / se, 2) AS chi2 FROM c""", "estimate se low high chi2", [PAIRED, P2])
def l06(spark, sf):
    d = B.paired(spark, sf).withColumn("y", F.log("dur_mfa_ms") - F.log("dur_hand_ms"))
    f = L.fit_products(cross_products(d, [], xcols()[:2], F.col("y")), 2, [])
    return L.wald(f, {"slope": [0.0, 1.0], "sum": [1.0, 1.0]})


@query("l07_relative_shift", "WITH " + two("yh") + ", " + two("ym").replace("c AS", "c2 AS").replace("FROM c ", "FROM c2 ").replace("FROM c)", "FROM c2)").replace("t AS", "t2 AS") + " SELECT t.term, t.estimate AS hand_est, t2.estimate AS machine_est, t2.estimate - t.estimate AS est_diff, 100 * (t2.estimate - t.estimate) / abs(t.estimate) AS rel_shift_pct FROM t JOIN t2 USING (term)", "hand_est machine_est est_diff rel_shift_pct", [PAIRED, P2], digits=5)
def l07(spark, sf):
    d = B.paired(spark, sf)
    return L.relative_shift(L.ols(d, xcols(), F.log("dur_hand_ms"), NAMES), L.ols(d, xcols(), F.log("dur_mfa_ms"), NAMES))


@query("l08_welch", """WITH r AS (SELECT process, speaker, CASE WHEN identity_safe = 1 THEN 'safe' ELSE 'not' END AS g, avg(correct) AS v FROM dcs GROUP BY 1, 2, 3), s AS (SELECT process, count(*) FILTER (g = 'safe') AS n_a, count(*) FILTER (g = 'not') AS n_b, avg(v) FILTER (g = 'safe') - avg(v) FILTER (g = 'not') AS diff, var_samp(v) FILTER (g = 'safe') / count(*) FILTER (g = 'safe') AS a, var_samp(v) FILTER (g = 'not') / count(*) FILTER (g = 'not') AS b FROM r GROUP BY 1)
  SELECT process, n_a, n_b, diff, sqrt(a + b) AS se, pow(a + b, 2) / (a * a / (n_a - 1) + b * b / (n_b - 1)) AS df FROM s""", "diff se df", [DEC], digits=5)
def l08(spark, sf):
    d = B.decisions(spark, sf).withColumn("g", F.when(F.col("identity_safe") == 1, "safe").otherwise("not"))
    r = d.groupBy("process", "speaker", "g").agg(F.avg("correct").alias("v"))
    return L.welch(r, "g", "v", "safe", "not", ["process"]).select("process", "n_a", "n_b", "diff", "se", "df")


@query("l08_welch_interval")
def l08b(spark, sf):
    d = B.decisions(spark, sf).withColumn("g", F.when(F.col("identity_safe") == 1, "safe").otherwise("not"))
    r = d.groupBy("process", "speaker", "g").agg(F.avg("correct").alias("v"))
    return L.welch(r, "g", "v", "safe", "not", ["process"])


@query("l09_variance_components", """WITH d AS (SELECT speaker_id AS o, speaker_id || '_' || (dur_hand_ms::INT % 4) AS i, dur_mfa_ms - dur_hand_ms AS v FROM paired), c AS (SELECT o, i, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM d GROUP BY 1, 2), g AS (SELECT o, sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS ss, sum(n * n) AS nn FROM c GROUP BY 1),
  t AS (SELECT sum(n) AS N, sum(s) AS S_, sum(q) AS Q, sum(k) AS b, count(*) AS a, sum(ss) AS T1, sum(s * s / n) AS T0, sum(nn / n) AS c1, sum(nn) AS c2, sum(n * n) AS c3 FROM g), u AS (SELECT *, (Q - T1) / (N - b) AS w FROM t), x AS (SELECT *, ((T1 - T0) / (b - a) - w) / ((N - c1) / (b - a)) AS vi FROM u)
  SELECT N::BIGINT AS n, ((T0 - S_ * S_ / N) / (a - 1) - w - (c1 - c2 / N) / (a - 1) * vi) / ((N - c3 / N) / (a - 1)) AS var_outer, vi AS var_inner, w AS var_within FROM x""", "var_outer var_inner var_within", [PAIRED])
def l09(spark, sf):
    d = B.paired(spark, sf).withColumn("i", F.concat_ws("_", "speaker_id", (F.col("dur_hand_ms").cast("int") % 4).cast("string")))
    return L.variance_components(d, "speaker_id", "i", F.col("dur_mfa_ms") - F.col("dur_hand_ms"))


@query("u01_union_parts", "SELECT source, count(*) AS n, count(quality) AS with_quality FROM (SELECT lang AS source, NULL AS quality FROM documents UNION ALL SELECT 'label', quality FROM labels UNION ALL SELECT role, NULL FROM conversations) GROUP BY 1")
def u01(spark, sf):
    a = B.table(spark, sf, "documents").select(F.col("lang").alias("source"))
    b = B.table(spark, sf, "labels").select(F.lit("label").alias("source"), "quality")
    c = B.table(spark, sf, "conversations").select(F.col("role").alias("source"))
    return U.union_parts([a, b, c]).groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("with_quality"))


@query("u02_first_per_key", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o_orderkey, first(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def u02(spark, sf):
    o = B.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return U.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("u03_ids_in_all", "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u03(spark, sf):
    li = B.table(spark, sf, "lineitem")
    o = B.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return U.ids_in_all([li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("id")), li.select(F.col("l_partkey").alias("id")), o], "id")


@query("u04_ids_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def u04(spark, sf):
    o = B.table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("id"))
    return U.ids_missing(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), o, "id")


@query("u05_seed_spread", """SELECT vowel, count(*) AS runs, max(e) - min(e) AS spread, count(DISTINCT sign(e)) = 1 AS same_sign, bool_or(e - 2 * s <= 0 AND 0 <= e + 2 * s) AS zero_inside FROM (SELECT vowel, length_class, is_accent_nucleus, avg(dur_mfa_ms - dur_hand_ms) AS e, stddev_samp(dur_mfa_ms - dur_hand_ms) AS s FROM paired GROUP BY 1, 2, 3) GROUP BY 1""", "spread", [PAIRED])
def u05(spark, sf):
    d = F.col("dur_mfa_ms") - F.col("dur_hand_ms")
    r = B.paired(spark, sf).groupBy("vowel", "length_class", "is_accent_nucleus").agg(F.avg(d).alias("estimate"), F.stddev_samp(d).alias("s"))
    r = r.withColumn("low", F.col("estimate") - 2 * F.col("s")).withColumn("high", F.col("estimate") + 2 * F.col("s"))
    return U.seed_spread(r, ["vowel"])


@query("k03_metric_report", f"""WITH c AS (SELECT process, {CELL} FROM dcs GROUP BY 1) SELECT 'P1' AS analysis, process AS subset, q AS quantity, v AS estimate, '' AS note FROM (SELECT process, unnest(['agreement','sensitivity']) AS q, unnest([(tp + tn) / (tp + fn + fp + tn), tp / (tp + fn)]) AS v FROM c)
  UNION ALL SELECT 'P2', process, 'mean_dev', avg(dev_word_ms), 'ms' FROM dcs GROUP BY 2""", "estimate", [DEC])
def k03(spark, sf):
    d = B.decisions(spark, sf)
    m = M.class_metrics(M.confusion(d, ["process"])).select("process", F.col("agree").alias("agreement"), F.col("sens").alias("sensitivity"))
    a = m.unpivot("process", ["agreement", "sensitivity"], "quantity", "estimate").withColumn("analysis", F.lit("P1"))
    b = d.groupBy("process").agg(F.avg("dev_word_ms").alias("estimate")).select("process", "estimate", F.lit("mean_dev").alias("quantity"), F.lit("P2").alias("analysis"), F.lit("ms").alias("note"))
    r = U.union_parts([a, b])
    return r.select("analysis", F.col("process").alias("subset"), "quantity", "estimate", F.coalesce("note", F.lit("")).alias("note"))


@query("q01_reconcile", """WITH e AS (SELECT l_returnflag AS name, count(*)::DOUBLE AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), a AS (SELECT l_returnflag AS name, (sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::DOUBLE AS v FROM lineitem GROUP BY 1)
  SELECT name, e.v AS expected, a.v AS actual, e.v = a.v AS equal FROM e FULL JOIN a USING (name)""", "expected actual")
def q01(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), "l_linestatus")
    e = li.where("l_linestatus = 'F'").groupBy("name").agg(F.count("*").cast("double").alias("v"))
    a = li.groupBy("name").agg((F.count_if(F.col("l_linestatus") == "F") + F.when(F.col("name") == "N", 1).otherwise(0)).cast("double").alias("v"))
    return Q.reconcile(e, a, ["name"], "v")


@query("q02_row_mismatches", """SELECT count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS compared, count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND (a.s <> b.s OR a.p <> b.p)) AS mismatches, count(*) FILTER (b.o_orderkey IS NULL) AS only_a, count(*) FILTER (a.o_orderkey IS NULL) AS only_b
  FROM (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 13 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def q02(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    b = o.where("o_orderkey % 13 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("s")))
    return Q.row_mismatches(o.where("o_orderkey % 11 <> 0"), b, ["o_orderkey"], ["s", "p"])


@query("q03_max_abs_diff", "SELECT max(abs(l_extendedprice - round(l_extendedprice, 1))) AS max_v, count(*) AS n FROM (SELECT avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_partkey)", "max_v", digits=4)
def q03(spark, sf):
    a = B.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("v"))
    return Q.max_abs_diff(a, a.select("l_partkey", F.round("v", 1).alias("v")), ["l_partkey"], ["v"])


@query("q04_tier_consistency", """WITH t AS (SELECT r.event_id, r.label AS a, h.label AS b FROM ref r JOIN hyp h USING (event_id)), g AS (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN ['all', 'sample'] ELSE ['all'] END) AS "group" FROM t)
  SELECT "group", count(*) AS n, avg((a = b)::INT) AS equal, avg((a = replace(b, 'look', 'view'))::INT) AS equal_normalised, avg((length(a) = length(b))::INT) AS same_length FROM g GROUP BY 1""", "equal equal_normalised same_length", [UNITS, HYP])
def q04(spark, sf):
    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r).select("event_id", F.col("label").alias("b"))
    t = r.select("event_id", F.col("label").alias("a")).join(h, "event_id")
    a, b = F.col("a"), F.col("b")
    return Q.tier_consistency(
        t, {"all": F.lit(True), "sample": F.col("event_id") % 3 == 0},
        {"equal": a == b, "equal_normalised": a == F.replace(b, F.lit("look"), F.lit("view")), "same_length": F.length(a) == F.length(b)},
    )


@query("q05_flag_detector", """SELECT sym, tp, fn, fp, tn, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM (SELECT sym, count(*) FILTER (t AND f) AS tp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (NOT t AND NOT f) AS tn FROM (SELECT sym, event_id % 6 = 0 AS t, start_uncertain OR end_uncertain AS f FROM ph) GROUP BY 1)""", "sens spec", [UNITS, PHONES])
def q05(spark, sf):
    return Q.flag_detector(B.phones(spark, sf), F.col("event_id") % 6 == 0, F.col("start_uncertain") | F.col("end_uncertain"), ["sym"])
