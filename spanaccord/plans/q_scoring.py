"""Queries for decision scoring and rank statistics."""

from pyspark.sql import functions as F

from spanaccord.operators import neighbours as W, quantile as Q, rank as R, scoring as M
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, UNITS, words
from spanaccord.plans.q_joins import runs
from spanaccord.plans.registry import query

CELL = """count(*) FILTER (human = 1 AND aligner = 1) AS tp, count(*) FILTER (human = 1 AND aligner = 0) AS fn, count(*) FILTER (human = 0 AND aligner = 1) AS fp, count(*) FILTER (human = 0 AND aligner = 0) AS tn"""
MET = """(tp + fn + fp + tn)::DOUBLE AS n, (tp + tn) / (tp + fn + fp + tn) AS agree, (tp + fn) / (tp + fn + fp + tn) AS hand, (tp + fp) / (tp + fn + fp + tn) AS machine,
  greatest((tp + fn) / (tp + fn + fp + tn), 1 - (tp + fn) / (tp + fn + fp + tn)) AS base, (tp + tn) / (tp + fn + fp + tn) - greatest((tp + fn) / (tp + fn + fp + tn), 1 - (tp + fn) / (tp + fn + fp + tn)) AS over_base,
  tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS ba,
  (tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0) AS mcc"""
METC = "n agree hand machine base over_base sens spec ba mcc"


@query("m01_decide_variant", """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN o IS NULL THEN 'missing' WHEN a = c THEN 'undecidable' WHEN o = a THEN 'applied' WHEN o = c THEN 'citation' ELSE 'neither' END AS decision
  FROM (SELECT p_name AS a, lag(p_name, 7) OVER (ORDER BY p_partkey) AS o, lead(p_name, 11) OVER (ORDER BY p_partkey) AS c FROM part)) GROUP BY 1""".replace("lag(p_name, 7) OVER (ORDER BY p_partkey)", "(SELECT q.p_name FROM part q WHERE q.p_partkey = part.p_partkey - 7)").replace("lead(p_name, 11) OVER (ORDER BY p_partkey)", "(SELECT q.p_name FROM part q WHERE q.p_partkey = part.p_partkey // 3)"))
def m01(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    o = p.select((F.col("p_partkey") + 7).alias("p_partkey"), F.col("a").alias("o"))
    c = p.select(F.explode(F.array(*[F.col("p_partkey") * 3 + i for i in range(3)])).alias("p_partkey"), F.col("a").alias("c"))
    d = p.join(o, "p_partkey", "left").join(c, "p_partkey")
    return M.decide_variant(d, "o", "a", "c").groupBy("decision").agg(F.count("*").alias("n"))


@query("m02_confusion", f"SELECT process, {CELL} FROM dcs GROUP BY 1", ctes=[DEC])
def m02(spark, sf):
    return M.confusion(B.decisions(spark, sf), ["process"])


@query("m02_confusion_weighted", "SELECT process, sum(CASE WHEN human = 1 AND aligner = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN human = 1 AND aligner = 0 THEN w ELSE 0 END) AS fn, sum(CASE WHEN human = 0 AND aligner = 1 THEN w ELSE 0 END) AS fp, sum(CASE WHEN human = 0 AND aligner = 0 THEN w ELSE 0 END) AS tn FROM (SELECT *, dev_word_ms / 100 AS w FROM dcs) GROUP BY 1", "tp fn fp tn", [DEC], digits=3)
def m02b(spark, sf):
    return M.confusion(B.decisions(spark, sf), ["process"], weight=F.col("dev_word_ms") / 100)


@query("m03_class_metrics", f"SELECT *, {MET} FROM (SELECT process, {CELL} FROM dcs GROUP BY 1)", METC, [DEC])
def m03(spark, sf):
    return M.class_metrics(M.confusion(B.decisions(spark, sf), ["process"]))


@query("m03_metrics_by_label_source", f"SELECT *, {MET} FROM (SELECT source, {CELL} FROM (SELECT source, quality AS human, CASE WHEN doc_id % 4 = 0 THEN toxic ELSE 1 - toxic END AS aligner FROM labels JOIN documents USING (doc_id)) GROUP BY 1)", METC)
def m03b(spark, sf):
    d = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    d = d.select("source", F.col("quality").alias("human"), F.when(F.col("doc_id") % 4 == 0, F.col("toxic")).otherwise(1 - F.col("toxic")).alias("aligner"))
    return M.class_metrics(M.confusion(d, ["source"]))


LAB = """lab AS (SELECT *, (['i̥','ɯ','k i̥','s','i','t ɯ̥','a','ɕ'])[(event_id * 5 + event_id // 4) % 8 + 1] AS lab, (['i','ɯ̥','a k','t','s','ɨ̥ x','eː'])[(event_id * 3 + event_id // 3) % 7 + 1] AS hlab FROM aln)"""


def labelled(spark, sf):
    e = F.col("event_id")
    pick = lambda vals, i: F.element_at(F.array(*[F.lit(v) for v in vals]), (i + 1).cast("int"))
    return B.alignment(spark, sf).select(
        "*", pick(["i̥", "ɯ", "k i̥", "s", "i", "t ɯ̥", "a", "ɕ"], (e * 5 + F.floor(e / 4)) % 8).alias("lab"),
        pick(["i", "ɯ̥", "a k", "t", "s", "ɨ̥ x", "eː"], (e * 3 + F.floor(e / 3)) % 7).alias("hlab"),
    )


REFCAT = "CASE WHEN list_has_any(string_split(lab, ' '), ['i̥','ɯ̥']) THEN 'devoiced' WHEN phone_class = 'vowel_short' AND lab IN ('i','ɯ') THEN 'voiced' END"
HYPCAT = "CASE WHEN error_type = 'omission' THEN 'devoiced' WHEN list_has_any(string_split(hlab, ' '), ['a','aː','e','eː','i','iː','o','oː','ɯ','ɯː','ɨ','ɨː']) THEN 'voiced' WHEN list_has_any(string_split(hlab, ' '), ['i̥','ɯ̥','ɨ̥']) THEN 'devoiced' WHEN len(string_split(lab, ' ')) > 1 THEN 'devoiced' END"


@query("m04_ref_category", f"SELECT {REFCAT} AS cat, count(*) AS n FROM lab GROUP BY 1", ctes=[UNITS, ALN, LAB])
def m04(spark, sf):
    return labelled(spark, sf).groupBy(M.ref_category(F.col("lab"), F.col("phone_class")).alias("cat")).agg(F.count("*").alias("n"))


@query("m05_hyp_category", f"SELECT coalesce({HYPCAT}, 'undecidable') AS cat, error_type, count(*) AS n FROM lab GROUP BY 1, 2", ctes=[UNITS, ALN, LAB])
def m05(spark, sf):
    c = M.hyp_category(F.col("error_type"), F.col("hlab"), F.col("lab"))
    return labelled(spark, sf).groupBy(F.coalesce(c, F.lit("undecidable")).alias("cat"), "error_type").agg(F.count("*").alias("n"))


@query("m07_competition", """WITH v AS (SELECT word_type, speaker, CASE WHEN mix < 5 THEN 'V' WHEN mix < 7 THEN 'D' WHEN mix < 9 THEN 'A' END AS v FROM dcs),
  g AS (SELECT word_type, speaker, array_to_string(list_sort(list_distinct(list(v))), '') AS vals FROM v GROUP BY 1, 2)
  SELECT *, CASE WHEN contains(vals, 'V') AND (contains(vals, 'D') OR contains(vals, 'A')) THEN 'competing' ELSE 'lexical' END AS status,
  CASE WHEN NOT (contains(vals, 'V') AND (contains(vals, 'D') OR contains(vals, 'A'))) THEN '' WHEN contains(vals, 'D') AND contains(vals, 'A') THEN 'mixed' WHEN contains(vals, 'D') THEN 'symbol' ELSE 'presence' END AS ctype FROM g""", ctes=[DEC])
def m07(spark, sf):
    d, mix = runs(spark, sf)
    v = F.when(mix < 5, "V").when(mix < 7, "D").when(mix < 9, "A")
    return M.competition(d.select("word_type", "speaker", v.alias("v")), ["word_type", "speaker"], "v")


VL = "(CASE WHEN {c} IN ('stop','fricative','affricate','geminate_stop','geminate_affricate') THEN NOT regexp_matches({l}, '^[bdɡgzʑvɟ]') ELSE false END)"


@query("m08_voiceless_env", f"""WITH n AS (SELECT *, lag(phone_class) OVER w AS pc, lag(label) OVER w AS pl, first_value(CASE WHEN phone_class <> 'nasal' THEN {{'c': phone_class, 'l': label}} END IGNORE NULLS) OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM ref WINDOW w AS (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id))
  SELECT unit_id, CASE WHEN coalesce({VL.format(c='pc', l='pl')}, false) AND coalesce({VL.format(c='nx.c', l='nx.l')}, false) THEN 'voiceless_both' ELSE 'other' END AS env FROM n""", ctes=[UNITS])
def m08(spark, sf):
    from spanaccord.operators.scan import lag, scan

    u = W.next_skipping(B.windowed_units(spark, sf), ["nasal"])
    u = scan(u, W.IPU, W.TIME, {"prev_class": lag("phone_class"), "prev_label": lag("label")})
    return M.voiceless_env(u, ("prev_class", "prev_label"), ("next_class", "next_label")).select("unit_id", "env")


@query("m08_voiceless_prev_in_file", f"""SELECT unit_id, coalesce({VL.format(c='pc', l='pl')}, false) AS prev_voiceless FROM (SELECT unit_id, lag(phone_class) OVER w AS pc, lag(label) OVER w AS pl FROM ref WINDOW w AS (PARTITION BY file_id ORDER BY t_start, unit_id))""", ctes=[UNITS])
def m08b(spark, sf):
    u = W.prev_in_file(B.ref_units(spark, sf))
    return u.select("unit_id", M.voiceless(F.col("prev_class"), F.col("prev_label")).alias("prev_voiceless"))


@query("m09_kappa", f"""SELECT process, tp, fn, fp, tn, (tp + tn) / n AS observed, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS expected, ((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)) / (1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)) AS kappa
  FROM (SELECT *, (tp + fn + fp + tn)::DOUBLE AS n FROM (SELECT process, {CELL} FROM dcs GROUP BY 1))""", "observed expected kappa", [DEC])
def m09(spark, sf):
    return M.kappa(M.confusion(B.decisions(spark, sf), ["process"]))


@query("m10_mcnemar", f"SELECT process, fn, fp, pow(abs(fn - fp) - 1, 2) / (fn + fp) AS chi2 FROM (SELECT process, {CELL} FROM dcs GROUP BY 1)", "chi2", [DEC])
def m10(spark, sf):
    return M.mcnemar(M.confusion(B.decisions(spark, sf), ["process"])).select("process", "fn", "fp", "chi2")


@query("m10_mcnemar_exact", f"""WITH c AS (SELECT speaker, {CELL} FROM dcs GROUP BY 1), t AS (SELECT speaker, fn, fp, unnest(range(0, least(fn, fp) + 1)) AS i FROM c)
  SELECT speaker, fn, fp, least(1.0, 2 * sum(exp(lgamma(fn + fp + 1) - lgamma(i + 1) - lgamma(fn + fp - i + 1) - (fn + fp) * ln(2.0)))) AS p_exact FROM t GROUP BY 1, 2, 3""", "p_exact", [DEC], digits=8)
def m10b(spark, sf):
    return M.mcnemar_exact(M.confusion(B.decisions(spark, sf), ["speaker"])).select("speaker", "fn", "fp", "p_exact")


@query("m11_direction_by_cluster", f"""WITH c AS (SELECT process, speaker, fn - fp AS d FROM (SELECT process, speaker, {CELL} FROM dcs GROUP BY 1, 2))
  SELECT process, count(*) AS n_clusters, count(*) FILTER (d > 0) AS more_misses, count(*) FILTER (d < 0) AS more_false_hits, count(*) FILTER (d = 0) AS equal, median(d) AS median_diff FROM c GROUP BY 1""", "median_diff", [DEC])
def m11(spark, sf):
    return M.direction_by_cluster(B.decisions(spark, sf), "speaker", ["process"])


@query("m13_system_deltas", f"""WITH s AS (SELECT 'base' AS system, process, human, aligner FROM dcs UNION ALL SELECT 'prior', process, human, CASE WHEN mix % 4 = 0 THEN human ELSE aligner END FROM dcs), m AS (SELECT *, {MET} FROM (SELECT system, process, {CELL} FROM s GROUP BY 1, 2))
  SELECT a.process, a.system, a.agree - b.agree AS delta_agree, a.ba - b.ba AS delta_ba, a.sens - b.sens AS delta_sens, a.spec - b.spec AS delta_spec, a.mcc - b.mcc AS delta_mcc, (a.agree - b.agree) - (a.ba - b.ba) AS delta_agree_minus_ba FROM m a JOIN m b ON a.process = b.process AND a.system = 'prior' AND b.system = 'base'""",
       "delta_agree delta_ba delta_sens delta_spec delta_mcc delta_agree_minus_ba", [DEC])
def m13(spark, sf):
    return M.system_deltas(M.class_metrics(M.confusion(systems(spark, sf), ["system", "process"])), "system", "base", ["process"])


def systems(spark, sf):
    """The decisions of two systems below each other."""
    d, mix = runs(spark, sf)
    a = d.withColumn("system", F.lit("base"))
    b = d.withColumn("aligner", F.when(mix % 4 == 0, F.col("human")).otherwise(F.col("aligner"))).withColumn("system", F.lit("prior"))
    return a.unionByName(b)


@query("m14_did", """WITH r AS (SELECT phone_class, tag_vlong::VARCHAR AS c, avg((abs(onset_error_ms) <= 20)::INT) AS r FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1, 2), p AS (SELECT max(r) FILTER (c = 'false' AND phone_class = 'stop') AS r_false_stop, max(r) FILTER (c = 'false' AND phone_class = 'nasal') AS r_false_nasal, max(r) FILTER (c = 'true' AND phone_class = 'stop') AS r_true_stop, max(r) FILTER (c = 'true' AND phone_class = 'nasal') AS r_true_nasal FROM r)
  SELECT *, (r_true_nasal - r_false_nasal) - (r_true_stop - r_false_stop) AS did FROM p""", "r_false_stop r_false_nasal r_true_stop r_true_nasal did", [UNITS, ALN])
def m14(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null").withColumn("c", F.col("tag_vlong").cast("string"))
    st = a.groupBy("c", "phone_class").agg(F.count("*").alias("n"), F.count_if(F.abs("onset_error_ms") <= 20).alias("hit"))
    return M.did(st, "c", "phone_class", ("false", "true"), ("stop", "nasal"))


@query("m15_decision_changes", """WITH j AS (SELECT process, aligner AS a, CASE WHEN mix % 4 = 0 THEN human ELSE aligner END AS b FROM dcs)
  SELECT coalesce(process, 'ALL') AS type, count(*) AS n_both, count(*) FILTER (a <> b) AS flips, count(*) FILTER (a = 0 AND b = 1) AS to_one, count(*) FILTER (a = 1 AND b = 0) AS to_zero, count(*) FILTER (a <> b)::DOUBLE / count(*) AS share FROM j GROUP BY ROLLUP (process)""", "share", [DEC])
def m15(spark, sf):
    d, mix = runs(spark, sf)
    b = d.withColumn("aligner", F.when(mix % 4 == 0, F.col("human")).otherwise(F.col("aligner")))
    return M.decision_changes(d, b, ["cand_id"], "aligner", "process")


AUC = """WITH r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {by} dev_word_ms) - 1) / 2.0::DOUBLE AS rk FROM dcs WINDOW w AS ({p} ORDER BY dev_word_ms)),
  g AS (SELECT {by} count(*) FILTER (correct = 1) AS n_pos, count(*) FILTER (correct = 0) AS n_neg, sum(rk) FILTER (correct = 1) AS rs FROM r {grp})"""


@query("r01_auc", AUC.format(by="", p="", grp="") + " SELECT n_pos, n_neg, (rs - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg) AS auc FROM g", "auc", [DEC])
def r01(spark, sf):
    return R.auc(B.decisions(spark, sf), [], "dev_word_ms", "correct")


WAUC = """WITH s AS (SELECT process, dev_word_ms AS v, sum(CASE WHEN correct = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN correct = 0 THEN w ELSE 0 END) AS q FROM (SELECT *, mix % 4 AS w FROM dcs) WHERE w > 0 GROUP BY 1, 2), c AS (SELECT *, sum(q) OVER (PARTITION BY process ORDER BY v) - q AS below FROM s)
  SELECT process, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, sum(p * (below + 0.5::DOUBLE * q)) / (sum(p)::DOUBLE * sum(q)) AS auc FROM c GROUP BY 1"""


@query("r02_weighted_auc", WAUC, "auc", [DEC])
def r02(spark, sf):
    d, mix = runs(spark, sf)
    return R.auc(d.withColumn("w", mix % 4), ["process"], "dev_word_ms", "correct", F.col("w"))


@query("r03_stratified_auc", AUC.format(by="process,", p="PARTITION BY process", grp="GROUP BY 1") + " SELECT sum(rs - n_pos * (n_pos + 1) / 2) / sum(n_pos::DOUBLE * n_neg) AS auc, sum(n_pos::DOUBLE * n_neg) AS pairs FROM g", "auc pairs", [DEC], digits=5)
def r03(spark, sf):
    return R.stratified_auc(B.decisions(spark, sf), ["process"], "dev_word_ms", "correct")


@query("r04_mean_cluster_auc", AUC.format(by="speaker,", p="PARTITION BY speaker", grp="GROUP BY 1") + ", a AS (SELECT (rs - n_pos * (n_pos + 1) / 2) / nullif(n_pos::DOUBLE * n_neg, 0) AS auc FROM g) SELECT count(*) AS n_clusters, count(auc) AS n_used, avg(auc) AS mean_auc FROM a", "mean_auc", [DEC])
def r04(spark, sf):
    return R.mean_cluster_auc(B.decisions(spark, sf), "speaker", "dev_word_ms", "correct")


WMED = """WITH s AS (SELECT process, dev_site_ms AS v, sum(mix) AS w FROM dcs WHERE dev_site_ms IS NOT NULL AND mix > 0 GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY process ORDER BY v) AS hi, sum(w) OVER (PARTITION BY process) AS n FROM s)"""


@query("r05_weighted_median", WMED + " SELECT process, min(v) FILTER (hi >= n / 2) AS lower, (min(v) FILTER (hi >= n / 2) + min(v) FILTER (hi > n / 2)) / 2 AS average FROM c GROUP BY 1", "lower average", [DEC])
def r05(spark, sf):
    d, mix = runs(spark, sf)
    d = d.withColumn("w", mix)
    a = Q.weighted_median(d, ["process"], "dev_site_ms", "w", "lower", "lower")
    return a.join(Q.weighted_median(d, ["process"], "dev_site_ms", "w", "average", "average"), "process")


@query("r06_mann_whitney", AUC.format(by="process,", p="PARTITION BY process", grp="GROUP BY 1") + """, t AS (SELECT process, sum(n * n * n - n) AS ties FROM (SELECT process, count(*)::DOUBLE AS n FROM dcs GROUP BY process, dev_word_ms) GROUP BY 1), u AS (SELECT *, rs - n_pos * (n_pos + 1) / 2 AS u, (n_pos + n_neg)::DOUBLE AS n, n_pos::DOUBLE * n_neg AS ab FROM g JOIN t USING (process))
  SELECT process, n_pos, n_neg, u, greatest(abs(u - ab / 2) - 0.5, 0) / sqrt(ab / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u""", "u z", [DEC], digits=5)
def r06(spark, sf):
    return R.mann_whitney(B.decisions(spark, sf), ["process"], "dev_word_ms", "correct").select("process", "n_pos", "n_neg", "u", "z")


@query("r07_median_diff", "SELECT process, median(dev_site_ms) FILTER (correct = 0) AS median_wrong, median(dev_site_ms) FILTER (correct = 1) AS median_correct, median(dev_site_ms) FILTER (correct = 0) - median(dev_site_ms) FILTER (correct = 1) AS diff FROM dcs GROUP BY 1", "median_wrong median_correct diff", [DEC])
def r07(spark, sf):
    return R.median_diff(B.decisions(spark, sf), ["process"], "dev_site_ms", "correct")


@query("r08_quantile_modes", """WITH s AS (SELECT speaker, list_sort(list(dev_site_ms)) AS v, count(*) AS n, quantile_cont(dev_site_ms, 0.025) AS low, quantile_cont(dev_site_ms, 0.975) AS high FROM dcs WHERE dev_site_ms IS NOT NULL GROUP BY 1)
  SELECT speaker, low, high, v[least(floor(0.025::DOUBLE * n)::INT, n - 1) + 1] AS low_i, v[least(floor(0.975::DOUBLE * n)::INT, n - 1) + 1] AS high_i, v[floor(0.025::DOUBLE * (n - 1))::INT + 1] AS low_j, v[floor(0.975::DOUBLE * (n - 1))::INT + 1] AS high_j FROM s""", "low high low_i high_i low_j high_j", [DEC])
def r08(spark, sf):
    d = B.decisions(spark, sf)
    out = None
    for tag, mode in (("", "linear"), ("_i", "index"), ("_j", "index1")):
        q = Q.quantiles(d, ["speaker"], "dev_site_ms", {f"low{tag}": 0.025, f"high{tag}": 0.975}, mode)
        out = q if out is None else out.join(q, "speaker")
    return out
