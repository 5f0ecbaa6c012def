"""Queries for projection, filter, reshape and validation."""

from pyspark.sql import functions as F

from spanaccord.functions import columns as C
from spanaccord.operators import reshape as P, validate as V
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, HYP, MAP, PAIRED, UNITS, words
from spanaccord.plans.registry import query

EVAL = "excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured'"
LONG = """bl AS (SELECT * FROM (
  SELECT file_id, ipu_id, speaker_id, event_id, phone_class, error_type, n_hyp_units, 'onset' AS boundary_type, onset_error_ms AS error_ms, abs(onset_error_ms) AS abs_error_ms FROM aln WHERE error_type IN ('displacement','substitution')
  UNION ALL SELECT file_id, ipu_id, speaker_id, event_id, phone_class, error_type, n_hyp_units, 'offset', offset_error_ms, abs(offset_error_ms) FROM aln WHERE error_type IN ('displacement','substitution')
  UNION ALL SELECT file_id, ipu_id, speaker_id, event_id, phone_class, error_type, n_hyp_units, CASE error_type WHEN 'insertion' THEN 'insertion_marker' ELSE 'none' END, NULL, NULL FROM aln WHERE error_type NOT IN ('displacement','substitution')))"""


@query("p01_evaluable", f"SELECT file_id, unit_id, t_start, t_end, phone_class FROM ref WHERE {EVAL}", "t_start t_end", [UNITS])
def p01(spark, sf):
    return P.evaluable(B.ref_units(spark, sf)).select("file_id", "unit_id", "t_start", "t_end", "phone_class")


@query("p02_style_of", """SELECT CASE WHEN file_id LIKE 'A%' THEN 'aps' WHEN file_id LIKE 'R%' THEN 'read' ELSE 'sps' END AS style,
  count(*) AS n FROM ref GROUP BY 1""", ctes=[UNITS])
def p02(spark, sf):
    return B.ref_units(spark, sf).groupBy(P.style_of(F.col("file_id")).alias("style")).agg(F.count("*").alias("n"))


@query("p03_exclusion_reason", """SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'fd_fused_geminate' WHEN label = 'error' AND devoiced THEN 'devoiced_no_duration'
  WHEN t_end - t_start < 600 THEN 'zero_duration' WHEN excluded_reason IS NOT NULL THEN excluded_reason END AS reason FROM ref""", ctes=[UNITS])
def p03(spark, sf):
    rules = [
        (F.col("event_id") % 53 == 0, "fd_fused_geminate"),
        ((F.col("label") == "error") & F.col("devoiced"), "devoiced_no_duration"),
        (F.col("t_end") - F.col("t_start") < 600, "zero_duration"),
    ]
    return B.ref_units(spark, sf).select("event_id", F.coalesce(P.first_reason(rules), "excluded_reason").alias("reason"))


@query("p04_restrict", """SELECT file_id, count(*) AS n FROM ref WHERE speaker_id IN (SELECT 'p' || (c_custkey % 40) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0 AND c_acctbal > 8000)
  GROUP BY 1""", ctes=[UNITS])
def p04(spark, sf):
    ids = B.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 and c_acctbal > 8000")
    ids = ids.select(F.concat(F.lit("p"), (F.col("c_custkey") % 40).cast("string")).alias("speaker_id"))
    return P.restrict(B.ref_units(spark, sf), ids, "speaker_id").groupBy("file_id").agg(F.count("*").alias("n"))


@query("p05_in_sets", """SELECT phone_class, error_type, count(*) AS n FROM aln WHERE phone_class IN ('vowel_short','vowel_long') AND error_type IN ('displacement','substitution')
  GROUP BY 1, 2""", ctes=[UNITS, ALN])
def p05(spark, sf):
    df = P.in_sets(B.alignment(spark, sf), phone_class=["vowel_short", "vowel_long"], error_type=list(P.MATCHED))
    return df.groupBy("phone_class", "error_type").agg(F.count("*").alias("n"))


@query("p06_collapse_rare", """SELECT CASE WHEN k < 21 THEN 'other_rare' ELSE p_brand END AS brand, count(*) AS n, avg(p_size) AS mean_size
  FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS k, p_brand || p_type AS b FROM part) GROUP BY 1""".replace("p_brand ELSE", "x").replace("ELSE p_brand END", "ELSE b END"), "mean_size")
def p06(spark, sf):
    df = B.table(spark, sf, "part").withColumn("brand", F.concat("p_brand", "p_type"))
    return P.collapse_rare(df, "brand", 21).groupBy("brand").agg(F.count("*").alias("n"), F.avg("p_size").alias("mean_size"))


@query("p07_keep_frequent", """SELECT brand, count(*) AS n FROM (SELECT p_brand || p_type AS brand, count(*) OVER (PARTITION BY p_brand, p_type) AS k FROM part) WHERE k >= 20 GROUP BY 1""")
def p07(spark, sf):
    df = B.table(spark, sf, "part").select(F.concat("p_brand", "p_type").alias("brand"))
    return P.keep_frequent(df, ["brand"], 20).groupBy("brand").agg(F.count("*").alias("n"))


@query("p07_keep_two_sided", """SELECT speaker, word_type, count(*) AS n, sum(correct)::BIGINT AS k FROM dcs GROUP BY 1, 2 HAVING sum(correct) >= 5 AND count(*) - sum(correct) >= 5""", ctes=[DEC])
def p07b(spark, sf):
    df = P.keep_two_sided(B.decisions(spark, sf), ["speaker", "word_type"], "correct", 5)
    return df.groupBy("speaker", "word_type").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))


@query("p08_errors", """SELECT r.event_id, (h.t_start - r.t_start) * 1000 AS onset_error_ms, (h.t_end - r.t_end) * 1000 AS offset_error_ms,
  abs((h.t_start - r.t_start) * 1000) AS abs_onset_ms, abs((h.t_end - r.t_end) * 1000) AS abs_offset_ms FROM ref r JOIN hyp h ON h.event_id = r.event_id AND h.unit_id LIKE 'h%'""",
       "onset_error_ms offset_error_ms abs_onset_ms abs_offset_ms", [UNITS, HYP], digits=4)
def p08(spark, sf):
    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r).where("unit_id like 'h%'").select("event_id", F.col("t_start").alias("hyp_start"), F.col("t_end").alias("hyp_end"))
    df = r.select("event_id", "t_start", "t_end").join(h, "event_id")
    return P.with_errors(df).select("event_id", "onset_error_ms", "offset_error_ms", "abs_onset_ms", "abs_offset_ms")


@query("p09_logs", """SELECT vowel, length_class, avg(ln(e + 5)) AS log_err5, avg(ln(e + 1)) AS log_err1, avg(ln(dur_mfa_ms) - ln(dur_hand_ms)) AS dlog
  FROM (SELECT *, abs(dur_mfa_ms - dur_hand_ms) AS e FROM paired) GROUP BY 1, 2""", "log_err5 log_err1 dlog", [PAIRED])
def p09(spark, sf):
    df = B.paired(spark, sf).withColumn("e", F.abs(F.col("dur_mfa_ms") - F.col("dur_hand_ms")))
    df = P.with_logs(df, "e", "dur_hand_ms", "dur_mfa_ms")
    return df.groupBy("vowel", "length_class").agg(*[F.avg(c).alias(c) for c in ("log_err5", "log_err1", "dlog")])


@query("p10_boundary_long", "SELECT file_id, event_id, phone_class, error_type, n_hyp_units::BIGINT AS n_hyp_units, boundary_type, error_ms, abs_error_ms FROM bl", "error_ms abs_error_ms", [UNITS, ALN, LONG])
def p10(spark, sf):
    cols = ["file_id", "event_id", "phone_class", "error_type", "n_hyp_units", "boundary_type", "error_ms", "abs_error_ms"]
    return P.to_boundary_long(B.alignment(spark, sf)).select(cols)


@query("p11_source_long", """SELECT source, vowel, count(*) AS n, sum(dur_ms) AS total_ms FROM (SELECT vowel, 'hand' AS source, dur_hand_ms AS dur_ms FROM paired
  UNION ALL SELECT vowel, 'mfa', dur_mfa_ms FROM paired) GROUP BY 1, 2""", "total_ms", [PAIRED], digits=3)
def p11(spark, sf):
    return P.to_source_long(B.paired(spark, sf)).groupBy("source", "vowel").agg(F.count("*").alias("n"), F.sum("dur_ms").alias("total_ms"))


@query("p12_within", """SELECT phone_class, sum((abs(onset_error_ms) <= 10)::INT)::BIGINT AS within10, sum((abs(onset_error_ms) <= 20)::INT)::BIGINT AS within20,
  sum((abs(onset_error_ms) <= 25)::INT)::BIGINT AS within25, sum((abs(onset_error_ms) <= 50)::INT)::BIGINT AS within50 FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1""", ctes=[UNITS, ALN])
def p12(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null")
    return a.groupBy("phone_class").agg(*[F.sum(c).alias(n) for n, c in P.within(F.col("onset_error_ms")).items()])


@query("p13_zscore", """SELECT cand_id, (dev_word_ms - avg(dev_word_ms) OVER w) / stddev_samp(dev_word_ms) OVER w AS z,
  (dev_word_ms - avg(CASE WHEN speaker <> 's1' THEN dev_word_ms END) OVER w) / stddev_samp(CASE WHEN speaker <> 's1' THEN dev_word_ms END) OVER w AS z_train
  FROM dcs WINDOW w AS (PARTITION BY process)""", "z z_train", [DEC])
def p13(spark, sf):
    d = P.zscore(B.decisions(spark, sf), "dev_word_ms", ["process"])
    d = P.zscore(d, "dev_word_ms", ["process"], F.col("speaker") != "s1", "z_train")
    return d.select("cand_id", "z", "z_train")


@query("p14_most_frequent", """SELECT speaker, first(word_type ORDER BY n DESC, word_type) AS ref_word_type FROM (SELECT speaker, word_type, count(*) AS n FROM dcs GROUP BY 1, 2) GROUP BY 1""", ctes=[DEC])
def p14(spark, sf):
    return P.most_frequent(B.decisions(spark, sf), ["speaker"], "word_type")


@query("p15_canon_label", """SELECT CASE WHEN devoiced AND phone_class LIKE 'vowel%' THEN upper(label) ELSE label END AS canon, count(*) AS n FROM ref GROUP BY 1""", ctes=[UNITS])
def p15(spark, sf):
    u = B.ref_units(spark, sf)
    c = C.canon_label(F.col("label"), F.col("devoiced") & F.col("phone_class").startswith("vowel"))
    return u.groupBy(c.alias("canon")).agg(F.count("*").alias("n"))


@query("p15_norm_word", """SELECT w AS word, count(*) AS n FROM (SELECT lower(nfc_normalize(word)) AS w FROM words) GROUP BY 1""", ctes=[words("benchmark", "item_id")])
def p15b(spark, sf):
    return B.words(spark, sf, "benchmark", "item_id").groupBy(C.norm_word(F.col("word")).alias("word")).agg(F.count("*").alias("n"))


@query("p16_top_bottom", """SELECT process, cand_id, side, rank FROM (SELECT process, cand_id, 'bottom' AS side, row_number() OVER (PARTITION BY process ORDER BY dev_word_ms, cand_id) AS rank FROM dcs
  UNION ALL SELECT process, cand_id, 'top', row_number() OVER (PARTITION BY process ORDER BY dev_word_ms DESC, cand_id DESC) FROM dcs) WHERE rank <= 5""", ctes=[DEC])
def p16(spark, sf):
    return P.top_bottom(B.decisions(spark, sf), ["process"], [F.col("dev_word_ms"), F.col("cand_id")], 5).select("process", "cand_id", "side", "rank")


@query("p17_drop_masked", """SELECT file_id, ipu_id, count(*) AS n FROM ref GROUP BY 1, 2 HAVING NOT bool_or(event_id % 59 = 0 OR event_id % 61 = 0)""", ctes=[UNITS])
def p17(spark, sf):
    u = B.windowed_units(spark, sf).select("file_id", "ipu_id", "event_id")
    out = P.drop_masked(u, ["file_id", "ipu_id"], (F.col("event_id") % 59 == 0) | (F.col("event_id") % 61 == 0))
    return out.groupBy("file_id", "ipu_id").agg(F.count("*").alias("n"))


@query("v01_violations", """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN t2 < t_start THEN 'end_before_start' END, CASE WHEN abs(t2 - t_start) < 1e-9 AND NOT zv AND excluded_reason IS NULL THEN 'zero_length' END,
  CASE WHEN burst_t < t_start OR burst_t > t2 THEN 'burst_outside' END, CASE WHEN corpus = 'jsut' AND metric_type = 'accuracy' THEN 'concordance_only' END, CASE WHEN corpus = 'csj' AND style = 'na' THEN 'style_missing' END, CASE WHEN m2 < 1 THEN 'merged_from' END]) AS rule FROM (SELECT *, CASE WHEN event_id % 71 = 0 THEN t_start - 1 WHEN event_id % 73 = 0 THEN t_start ELSE t_end END AS t2, CASE WHEN event_id % 79 = 0 THEN 0 ELSE merged_from END AS m2,
  event_id % 146 = 0 AS zv, CASE WHEN event_id % 5 = 0 THEN t_start - 0.5 WHEN event_id % 5 = 1 THEN t_start END AS burst_t, CASE WHEN event_id % 2 = 0 THEN 'jsut' ELSE 'csj' END AS corpus,
  CASE WHEN event_id % 11 = 0 THEN 'accuracy' ELSE 'concordance' END AS metric_type, CASE WHEN event_id % 13 = 0 THEN 'na' ELSE 'aps' END AS style FROM ref))
  WHERE rule IS NOT NULL GROUP BY 1""", ctes=[UNITS])
def v01(spark, sf):
    e = F.col("event_id")
    u = B.ref_units(spark, sf)
    u = u.withColumn("t_end", F.when(e % 71 == 0, F.col("t_start") - 1).when(e % 73 == 0, F.col("t_start")).otherwise(F.col("t_end")))
    u = u.withColumn("merged_from", F.when(e % 79 == 0, 0).otherwise(F.col("merged_from")))
    u = u.withColumns({
        "zero_vot": e % 146 == 0, "burst_t": F.when(e % 5 == 0, F.col("t_start") - 0.5).when(e % 5 == 1, F.col("t_start")), "corpus": F.when(e % 2 == 0, "jsut").otherwise("csj"),
        "metric_type": F.when(e % 11 == 0, "accuracy").otherwise("concordance"), "style": F.when(e % 13 == 0, "na").otherwise("aps"),
    })
    return V.violations(u, V.row_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query("v02_duplicates", "SELECT event_id, count(*) AS count FROM hyp GROUP BY 1 HAVING count(*) > 1", ctes=[UNITS, HYP])
def v02(spark, sf):
    return V.duplicates(B.hyp_units(spark, sf), ["event_id"])


@query("v03_concordance_corpora", "SELECT source AS corpus, count(*) AS count FROM documents WHERE lang <> 'en' GROUP BY 1")
def v03(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.when(F.col("lang") == "en", "accuracy").otherwise("concordance").alias("metric_type"))
    return V.concordance_corpora(d)


@query("v03_require_accuracy", "SELECT source AS corpus, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def v03b(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.when(F.col("lang") == "en", "accuracy").otherwise("concordance").alias("metric_type"))
    return V.require_accuracy(d.where("metric_type = 'accuracy'")).groupBy("corpus").agg(F.count("metric_type").alias("n"))


@query("v04_unmapped", "SELECT label, count(*) AS n FROM hyp WHERE label NOT IN (SELECT source_label FROM lm) GROUP BY 1", ctes=[UNITS, HYP, MAP])
def v04(spark, sf):
    return V.unmapped_labels(B.hyp_units(spark, sf), B.label_map(spark), "label")


@query("v05_coverage", """SELECT (SELECT count(DISTINCT file_id) FROM ref) AS n_inputs, (SELECT count(DISTINCT file_id) FROM hyp) AS n_outputs,
  (SELECT count(*) FROM hyp WHERE label NOT IN (SELECT machine_label FROM lm WHERE category <> 'nasal'))::DOUBLE / (SELECT count(*) FROM hyp) AS share_unknown,
  (SELECT count(DISTINCT label) FROM hyp WHERE label IN (SELECT machine_label FROM lm WHERE category <> 'nasal'))::DOUBLE / (SELECT count(DISTINCT machine_label) FROM lm WHERE category <> 'nasal') AS share_used, false AS passed""",
       "share_unknown share_used", [UNITS, HYP, MAP])
def v05(spark, sf):
    r = B.ref_units(spark, sf)
    known = B.label_map(spark).where("category <> 'nasal'").select(F.col("machine_label").alias("label"))
    return V.coverage_check(r, B.hyp_units(spark, sf, r), "file_id", "label", known)
