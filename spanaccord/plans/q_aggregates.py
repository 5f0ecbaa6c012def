"""Queries for aggregations."""

from pyspark.sql import functions as F

from spanaccord.operators import aggregate as G, neighbours as W
from spanaccord.operators.reshape import to_boundary_long
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, HYP, PAIRED, PHONES, RUNS, UNITS, words
from spanaccord.plans.q_reshape import LONG
from spanaccord.plans.registry import query

TYPES = ["displacement", "substitution", "omission", "insertion"]
_PIV = ", ".join(f"count(*) FILTER (error_type = '{t}') AS {t}" for t in TYPES)


@query("g01_count_pivot", f"SELECT phone_class, {_PIV} FROM aln GROUP BY 1", ctes=[UNITS, ALN])
def g01(spark, sf):
    return G.count_pivot(B.alignment(spark, sf), ["phone_class"], "error_type", TYPES)


_W = ", ".join(f"100.0::DOUBLE * avg((abs_error_ms <= {t})::INT) AS within{t}" for t in (10, 20, 25, 50))
SUMMARY = f"""WITH e AS (SELECT *, median(abs_error_ms) OVER (PARTITION BY phone_class, boundary_type) AS med FROM bl WHERE abs_error_ms IS NOT NULL)
  SELECT phone_class, boundary_type, count(*) AS n, median(abs_error_ms) AS median, avg(abs_error_ms) AS mean, avg(error_ms) AS signed_mean, sqrt(avg(abs_error_ms * abs_error_ms)) AS rmse,
  median(abs(abs_error_ms - med)) AS mad, quantile_cont(abs_error_ms, 0.95) AS p95, {_W} FROM e GROUP BY 1, 2"""


@query("g02_error_summary", SUMMARY, "median mean signed_mean rmse mad p95 within10 within20 within25 within50", [UNITS, ALN, LONG])
def g02(spark, sf):
    return G.error_summary(to_boundary_long(B.alignment(spark, sf)), ["phone_class", "boundary_type"])


# every class whose name starts with a vowel or a stop is unknown here
_NULLED = "CASE WHEN phone_class LIKE 'vowel%' OR phone_class LIKE 'stop%' THEN NULL ELSE phone_class END"


@query("g02_error_summary_null_class", SUMMARY.replace("FROM bl WHERE", f"FROM (SELECT * REPLACE ({_NULLED} AS phone_class) FROM bl) WHERE"), "median mean signed_mean rmse mad p95 within10 within20 within25 within50", [UNITS, ALN, LONG])
def g02_null(spark, sf):
    d = to_boundary_long(B.alignment(spark, sf))
    return G.error_summary(d.withColumn("phone_class", F.expr(_NULLED)), ["phone_class", "boundary_type"])


@query("g03_with_totals", """WITH d AS (SELECT error_type AS item, CASE WHEN phone_class LIKE 'vowel%' THEN 'vowel' ELSE 'consonant' END AS grp, 1 AS n, n_hyp_units AS hyps FROM aln)
  SELECT CASE grouping(grp) + grouping(item) WHEN 0 THEN 'detail' WHEN 1 THEN 'subtotal' ELSE 'total' END AS level, coalesce(grp, 'TOTAL') AS grp, coalesce(item, 'TOTAL') AS item, sum(n)::BIGINT AS n, sum(hyps)::BIGINT AS hyps FROM d GROUP BY ROLLUP (grp, item)""", ctes=[UNITS, ALN])
def g03(spark, sf):
    a = B.alignment(spark, sf).withColumn("n", F.lit(1)).withColumnRenamed("n_hyp_units", "hyps")
    return G.with_totals(a, "error_type", ["n", "hyps"], F.when(F.col("phone_class").startswith("vowel"), "vowel").otherwise("consonant"))


@query("g04_rate_columns", f"""WITH r AS (SELECT phone_class, count(*) AS ref_all, count(*) FILTER (excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured') AS ref_evaluable FROM ref GROUP BY 1),
  t AS (SELECT phone_class, {_PIV} FROM aln GROUP BY 1)
  SELECT *, displacement + substitution AS matched, 100.0::DOUBLE * (displacement + substitution) / ref_evaluable AS pct_of_evaluable, 100.0::DOUBLE * (displacement + substitution) / ref_all AS pct_of_all,
  100.0::DOUBLE * omission / ref_evaluable AS pct_omitted, 100.0::DOUBLE * substitution / ref_evaluable AS pct_substituted FROM r JOIN t USING (phone_class)""", "pct_of_evaluable pct_of_all pct_omitted pct_substituted", [UNITS, ALN])
def g04(spark, sf):
    u = B.ref_units(spark, sf)
    return G.denominators(u, B.alignment(spark, sf, u))


@query("g05_local_rate", """SELECT file_id, ipu_id, count(*) FILTER (excluded_reason IS NULL) AS n_units, count(*) FILTER (excluded_reason IS NULL) / nullif(max(t_end) - min(t_start), 0) * 1e0 AS rate FROM ref GROUP BY 1, 2 HAVING count(*) FILTER (excluded_reason IS NULL) > 0""", "rate", [UNITS])
def g05(spark, sf):
    return G.local_rate(B.windowed_units(spark, sf))


@query("g06_span_hours", """WITH s AS (SELECT DISTINCT substr(file_id, 1, 1) AS style, file_id, ipu_id, w_start, w_end FROM (SELECT *, min(t_start) OVER w AS w_start, max(t_end) OVER w AS w_end FROM ref WINDOW w AS (PARTITION BY file_id, ipu_id)))
  SELECT style, count(*) AS n_spans, sum(w_end - w_start) / 3600 AS hours FROM s GROUP BY 1""", "hours", [UNITS], digits=4)
def g06(spark, sf):
    from spanaccord.operators.intervals import build_windows

    u = B.windowed_units(spark, sf)
    d = u.select("file_id", "ipu_id").join(build_windows(u), ["file_id", "ipu_id"])
    return G.span_hours(d.withColumn("style", F.substring("file_id", 1, 1)), ["style"], ["file_id", "ipu_id"])


@query("g07_funnel", """WITH f AS (SELECT *, CASE WHEN error_type = 'omission' THEN 'excluded_omission' WHEN error_type = 'insertion' THEN 'excluded_insertion' WHEN accent_type IS NULL THEN 'excluded_no_accent_type' WHEN devoiced THEN 'excluded_devoiced' ELSE 'included' END AS step FROM aln WHERE phone_class LIKE 'vowel%')
  SELECT step, '' AS factor, '' AS level, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT step, 'error_type', error_type, count(*) FROM f WHERE step = 'included' GROUP BY 1, 3 UNION ALL SELECT step, 'phone_class', phone_class, count(*) FROM f WHERE step = 'included' GROUP BY 1, 3
  UNION ALL SELECT step, 'is_accent_nucleus', is_accent_nucleus::VARCHAR, count(*) FROM f WHERE step = 'included' GROUP BY 1, 3""", ctes=[UNITS, ALN])
def g07(spark, sf):
    a = B.alignment(spark, sf).where(F.col("phone_class").startswith("vowel"))
    t = F.col("error_type")
    rules = [(t == "omission", "excluded_omission"), (t == "insertion", "excluded_insertion"), (F.col("accent_type").isNull(), "excluded_no_accent_type"), (F.col("devoiced"), "excluded_devoiced")]
    return G.funnel(a, rules, ["error_type", "phone_class", "is_accent_nucleus"])


@query("g08_crosstab", "SELECT sym, start_uncertain, end_uncertain, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM ph GROUP BY 1, 2, 3", "pct", [UNITS, PHONES])
def g08(spark, sf):
    return G.crosstab(B.phones(spark, sf), ["sym", "start_uncertain", "end_uncertain"])


@query("g09_by_conditions", """WITH c AS (SELECT 'nucleus=' || is_accent_nucleus AS condition, onset_error_ms, offset_error_ms FROM aln WHERE onset_error_ms IS NOT NULL UNION ALL SELECT 'long=' || tag_vlong, onset_error_ms, offset_error_ms FROM aln WHERE onset_error_ms IS NOT NULL)
  SELECT condition, count(*) AS n, round(avg(onset_error_ms), 2) AS onset_mean, round(avg(offset_error_ms), 2) AS offset_mean, round(median(onset_error_ms), 2) AS onset_median, round(median(offset_error_ms), 2) AS offset_median FROM c GROUP BY 1""", ctes=[UNITS, ALN])
def g09(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null")
    return G.by_conditions(a, {"nucleus": F.col("is_accent_nucleus"), "long": F.col("tag_vlong")}, {"onset": F.col("onset_error_ms"), "offset": F.col("offset_error_ms")})


@query("g10_duration_summary", """SELECT length_class, is_accent_nucleus, count(*) AS n, median(dur_hand_ms) AS hand_median, median(dur_mfa_ms) AS mfa_median, median(dur_hand_ms - dur_mfa_ms) AS diff_median, avg(dur_hand_ms - dur_mfa_ms) AS diff_mean, stddev_samp(dur_hand_ms - dur_mfa_ms) AS diff_sd FROM paired GROUP BY 1, 2""", "hand_median mfa_median diff_median diff_mean diff_sd", [PAIRED])
def g10(spark, sf):
    return G.duration_summary(B.paired(spark, sf), ["length_class", "is_accent_nucleus"])


@query("g10_duration_summary_null_class", """SELECT nullif(length_class, 'O') AS length_class, is_accent_nucleus, count(*) AS n, median(dur_hand_ms) AS hand_median, median(dur_mfa_ms) AS mfa_median, median(dur_hand_ms - dur_mfa_ms) AS diff_median, avg(dur_hand_ms - dur_mfa_ms) AS diff_mean, stddev_samp(dur_hand_ms - dur_mfa_ms) AS diff_sd FROM paired GROUP BY 1, 2""", "hand_median mfa_median diff_median diff_mean diff_sd", [PAIRED])
def g10_null(spark, sf):
    return G.duration_summary(B.paired(spark, sf).withColumn("length_class", F.nullif("length_class", F.lit("O"))), ["length_class", "is_accent_nucleus"])


@query("g11_pair_inventory", "SELECT word_type AS form, process AS category, count(*) AS n_tokens, count(DISTINCT speaker) AS n_speakers FROM dcs GROUP BY 1, 2", ctes=[DEC])
def g11(spark, sf):
    d = B.decisions(spark, sf).select(F.col("word_type").alias("form"), F.col("process").alias("category"), "speaker")
    return G.pair_inventory(d, ["form", "category"], "speaker")


@query("g12_single_partner", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def g12(spark, sf):
    d = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return G.single_partner(d, ["k"], "l_returnflag").groupBy("k").agg(F.count("*").alias("n"))


@query("g13_best_entry", """SELECT p_type AS word, first(p_retailprice ORDER BY p_retailprice DESC, p_partkey) AS prob, first(p_name ORDER BY p_retailprice DESC, p_partkey) AS symbols FROM part GROUP BY 1""", "prob")
def g13(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_type").alias("word"), F.col("p_retailprice").alias("prob"), F.col("p_name").alias("symbols"), "p_partkey")
    return G.best_entry(p, ["word"], "prob", ["p_partkey"], ["symbols"])


@query("g14_distinct_counts", "SELECT process, count(*) AS n, count(DISTINCT speaker) AS n_speaker, count(DISTINCT word_type) AS n_word_type, count(DISTINCT utterance_id) AS n_utterance_id FROM dcs GROUP BY 1", ctes=[DEC])
def g14(spark, sf):
    return G.distinct_counts(B.decisions(spark, sf), ["speaker", "word_type", "utterance_id"], ["process"])


@query("g15_top_k_packed", """WITH n AS (SELECT phone_class, r.label AS a, h.label AS b, count(*) AS n FROM ref r JOIN hyp h USING (event_id) GROUP BY 1, 2, 3), p AS (SELECT phone_class, a, b, n, row_number() OVER (PARTITION BY phone_class ORDER BY n DESC, a, b) AS r FROM n)
  SELECT phone_class, string_agg(a || '>' || b || ':' || n, ';' ORDER BY r) AS top FROM p WHERE r <= 3 GROUP BY 1""".replace("SELECT phone_class, r.label", "SELECT r.phone_class, r.label"), ctes=[UNITS, HYP])
def g15(spark, sf):
    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r).select("event_id", F.col("label").alias("b"))
    return G.top_k_packed(r.select("event_id", "phone_class", F.col("label").alias("a")).join(h, "event_id"), ["phone_class"], "a", "b", 3)


@query("g16_macro_mean", "SELECT avg(acc) AS acc, avg(dev) AS dev FROM (SELECT process, avg(correct) AS acc, avg(CASE WHEN process <> 'A' THEN dev_site_ms END) AS dev FROM dcs GROUP BY 1)", "acc dev", [DEC])
def g16(spark, sf):
    d = B.decisions(spark, sf).groupBy("process").agg(F.avg("correct").alias("acc"), F.avg(F.when(F.col("process") != "A", F.col("dev_site_ms"))).alias("dev"))
    return G.macro_mean(d, ["acc", "dev"])


@query("g17_pool_weighted", """WITH s AS (SELECT process, count(*)::DOUBLE / sum(count(*)) OVER () AS sh FROM dcs WHERE identity_safe = 1 AND dev_site_ms > 20 GROUP BY 1), p AS (SELECT process, count(*)::DOUBLE / sum(count(*)) OVER () AS sh FROM dcs GROUP BY 1)
  SELECT sum(p.sh / s.sh) AS n, sum(d.correct * p.sh / s.sh) / sum(p.sh / s.sh) AS agreement FROM dcs d JOIN s USING (process) JOIN p USING (process) WHERE d.identity_safe = 1 AND d.dev_site_ms > 20""", "n agreement", [DEC], digits=4)
def g17(spark, sf):
    pool = B.decisions(spark, sf)
    sample = pool.where("identity_safe = 1 and dev_site_ms > 20")
    j = sample.join(G.pool_weights(sample, pool, "process"), "process")
    return j.agg(F.sum("weight").alias("n"), G.div(F.sum(F.col("weight") * F.col("correct")), F.sum("weight")).alias("agreement"))


@query("g18_per_word_accuracy", """WITH w AS (SELECT word_type, speaker, count(*) AS n, avg(correct) AS acc, greatest(avg(human), 1 - avg(human)) AS majority FROM dcs GROUP BY 1, 2 HAVING count(*) >= 5)
  SELECT count(*) AS n_words, sum(n)::BIGINT AS n_tokens, sum(acc * n) / sum(n) AS weighted_acc, sum(majority * n) / sum(n) AS weighted_majority, avg((acc < majority)::INT) AS share_below,
  quantile_cont(acc, 0.1) AS q10, quantile_cont(acc, 0.25) AS q25, quantile_cont(acc, 0.5) AS q50, quantile_cont(acc, 0.75) AS q75, quantile_cont(acc, 0.9) AS q90 FROM w""", "weighted_acc weighted_majority share_below q10 q25 q50 q75 q90", [DEC])
def g18(spark, sf):
    d = B.decisions(spark, sf).withColumn("w", F.concat_ws("|", "word_type", "speaker"))
    return G.per_word_accuracy(d, "w", "correct", "human", 5)


@query("g19_word_rates", """WITH t AS (SELECT 'w' || (event_id % 3000) AS word, phone_class AS env, devoiced::INT AS ev FROM ref), w AS (SELECT DISTINCT word, env FROM t), e AS (SELECT env, avg(ev) AS p FROM t GROUP BY 1), r AS (SELECT word, count(*) AS n, avg(ev) AS p FROM t GROUP BY 1)
  SELECT word, env, n, CASE WHEN n >= 4 THEN 'word' ELSE 'environment' END AS basis, least(greatest(CASE WHEN n >= 4 THEN r.p ELSE e.p END, 0.01), 0.99) AS p FROM w JOIN e USING (env) JOIN r USING (word)""", "p", [UNITS])
def g19(spark, sf):
    u = B.ref_units(spark, sf)
    t = u.select(F.concat(F.lit("w"), (F.col("event_id") % 3000).cast("string")).alias("word"), F.col("phone_class").alias("env"), F.col("devoiced").cast("int").alias("ev"))
    return G.word_rates(t, t.select("word", "env").distinct(), "word", "env", "ev", 4)


@query("g20_variant_priors", """SELECT word_type, speaker, product(CASE WHEN v IN ('D', 'A') THEN p WHEN v = 'V' THEN 1 - p ELSE 1 END) AS prior, count(*) AS n_positions
  FROM (SELECT word_type, speaker, CASE WHEN mix < 4 THEN 'V' WHEN mix < 6 THEN 'D' WHEN mix < 9 THEN 'A' ELSE 'X' END AS v, dev_word_ms % 0.9::DOUBLE + 0.05::DOUBLE AS p FROM dcs) GROUP BY 1, 2""", "prior", [DEC])
def g20(spark, sf):
    from spanaccord.plans.q_joins import runs

    d, mix = runs(spark, sf)
    v = F.when(mix < 4, "V").when(mix < 6, "D").when(mix < 9, "A").otherwise("X")
    d = d.select("word_type", "speaker", v.alias("v"), (F.col("dev_word_ms") % 0.9 + 0.05).alias("p"))
    return G.variant_priors(d, ["word_type", "speaker"], "v", "p")


@query("g22_agreement_limits", """SELECT length_class, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS sd, avg(d) - 1.96::DOUBLE * stddev_samp(d) AS lower, avg(d) + 1.96::DOUBLE * stddev_samp(d) AS upper FROM (SELECT *, dur_hand_ms - dur_mfa_ms AS d FROM paired) GROUP BY 1""", "bias sd lower upper", [PAIRED])
def g22(spark, sf):
    return G.agreement_limits(B.paired(spark, sf), F.col("dur_hand_ms") - F.col("dur_mfa_ms"), ["length_class"])


@query("g23_coverage_by_outcome", "SELECT correct, count(dev_site_ms) AS n, avg(dev_site_ms / 51) AS coverage FROM dcs GROUP BY 1", "coverage", [DEC], big="correct")
def g23(spark, sf):
    return G.coverage_by_outcome(B.decisions(spark, sf), "correct", F.col("dev_site_ms") / 51)


@query("g24_run_mean_sd", """SELECT process, count(acc) AS runs, avg(acc) AS mean, stddev_samp(acc) AS sd FROM (SELECT process, mix // 2 AS run, avg(correct) AS acc FROM dcs GROUP BY 1, 2) GROUP BY 1""", "mean sd", [DEC])
def g24(spark, sf):
    from spanaccord.plans.q_joins import runs

    d, mix = runs(spark, sf)
    r = d.groupBy("process", F.floor(mix / 2).alias("run")).agg(F.avg("correct").alias("acc"))
    return G.run_mean_sd(r, ["process"], "acc")


@query("g25_box_stats", """WITH q AS (SELECT process, quantile_cont(dev_site_ms, 0.25) AS q1, quantile_cont(dev_site_ms, 0.5) AS q2, quantile_cont(dev_site_ms, 0.75) AS q3 FROM dcs GROUP BY 1)
  SELECT process, q1, q2, q3, min(dev_site_ms) FILTER (dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(dev_site_ms) FILTER (dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  count(*) FILTER (NOT dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_out FROM dcs JOIN q USING (process) WHERE dev_site_ms IS NOT NULL GROUP BY 1, 2, 3, 4""", "q1 q2 q3 low high", [DEC])
def g25(spark, sf):
    return G.box_stats(B.decisions(spark, sf), ["process"], F.col("dev_site_ms"))


@query("g25_box_stats_null_process", """WITH dn AS (SELECT * REPLACE (nullif(process, 'N') AS process) FROM dcs), q AS (SELECT process, quantile_cont(dev_site_ms, 0.25) AS q1, quantile_cont(dev_site_ms, 0.5) AS q2, quantile_cont(dev_site_ms, 0.75) AS q3 FROM dn GROUP BY 1)
  SELECT process, q1, q2, q3, min(dev_site_ms) FILTER (dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(dev_site_ms) FILTER (dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  count(*) FILTER (NOT dev_site_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_out FROM (SELECT dn.*, q1, q2, q3 FROM dn JOIN q ON dn.process IS NOT DISTINCT FROM q.process) WHERE dev_site_ms IS NOT NULL GROUP BY 1, 2, 3, 4""", "q1 q2 q3 low high", [DEC])
def g25_null(spark, sf):
    return G.box_stats(B.decisions(spark, sf).withColumn("process", F.nullif("process", F.lit("N"))), ["process"], F.col("dev_site_ms"))


CHARS = """cw AS (SELECT doc, pos, word, string_split(word, '') AS s FROM (SELECT DISTINCT 0 AS doc, 0 AS pos, lower(word) AS word FROM words WHERE word SIMILAR TO '[A-Za-z:]+'))"""


@query("g26_lexicon_audit", """WITH z AS (SELECT s, list_filter(list_zip(s[1:-2], s[2:]), lambda x: x[1] = x[2] AND x[1] IN ('a', 'e', 'o')) AS sp FROM cw),
  h AS (SELECT count(*) AS entries, count(*) FILTER (array_to_string(s, '') LIKE '%:%') AS with_length_mark, count(*) FILTER (len(sp) > 0) AS with_doubled_vowel, sum(len(list_filter(sp, lambda x: x[1] = 'a')))::BIGINT AS spots_a, sum(len(list_filter(sp, lambda x: x[1] = 'e')))::BIGINT AS spots_e, sum(len(list_filter(sp, lambda x: x[1] = 'o')))::BIGINT AS spots_o FROM z)
  SELECT quantity, n FROM h UNPIVOT (n FOR quantity IN (entries, with_length_mark, with_doubled_vowel, spots_a, spots_e, spots_o))""", ctes=[words(), CHARS])
def g26(spark, sf):
    w = B.words(spark, sf).where(F.col("word").rlike("^[A-Za-z:]+$")).select(F.lower("word").alias("word")).distinct()
    return G.lexicon_audit(w.select(F.split("word", "").alias("s")), "s", ["a", "e", "o"], ":")


@query("g27_cluster_stats", """SELECT file_id, phone_class, count(*) AS n, sum((abs(onset_error_ms) <= 20)::INT)::BIGINT AS hit20, sum((error_type = 'substitution')::INT)::BIGINT AS subs FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1, 2""", ctes=[UNITS, ALN])
def g27(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null")
    return G.cluster_stats(a, ["file_id", "phone_class"], {"hit20": F.abs("onset_error_ms") <= 20, "subs": F.col("error_type") == "substitution"})


@query("g28_detection_rate", """SELECT process, count(*) AS n, avg((mix < 6)::INT) AS detection_rate FROM dcs WHERE mix < 8 GROUP BY 1""", "detection_rate", [DEC])
def g28(spark, sf):
    from spanaccord.plans.q_joins import runs

    d, mix = runs(spark, sf)
    o = F.when(mix < 6, "followed_transcriber").when(mix < 8, "chose_citation").otherwise("neither")
    return G.detection_rate(d.withColumn("outcome", o), "process", "outcome", "followed_transcriber", ["followed_transcriber", "chose_citation"])


@query("g29_flag_share", "SELECT vowel, count(*) AS n, avg(is_accent_nucleus::INT) AS share, avg(dur_mfa_ms - dur_hand_ms) AS mean_value FROM paired GROUP BY 1", "share mean_value", [PAIRED])
def g29(spark, sf):
    return G.flag_share(B.paired(spark, sf), ["vowel"], "is_accent_nucleus", F.col("dur_mfa_ms") - F.col("dur_hand_ms"))


@query("g30_crossed_clusters", "SELECT count(*) AS n_clusters, count(*) FILTER (k >= 2) AS n_crossed FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)")
def g30(spark, sf):
    return G.crossed_clusters(B.table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("g31_cluster_condition_medians", """SELECT speaker_id, median(dur_hand_ms) FILTER (length_class = 'F') AS "F", median(dur_hand_ms) FILTER (length_class = 'O') AS "O" FROM paired GROUP BY 1""", '"F" "O"', [PAIRED])
def g31(spark, sf):
    return G.cluster_condition_medians(B.paired(spark, sf), ["speaker_id"], "length_class", ["F", "O"], "dur_hand_ms")


@query("g32_window_text", "SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def g32(spark, sf):
    return G.window_text(B.table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", " ")


@query("g33_merge_attributes", """SELECT file_id, ipu_id, run, coalesce(first(accent_type ORDER BY t_start, unit_id) FILTER (accent_type IS NOT NULL), -1) AS accent_type, bool_or(devoiced) AS devoiced, bool_or(tag_vlong) AS tag_vlong,
  coalesce(try_cast(last(CASE WHEN sym = 'H' THEN '2' ELSE sym END ORDER BY t_start, unit_id) AS BIGINT), -1) AS last_label, count(*) AS merged_from FROM runs GROUP BY 1, 2, 3""", ctes=[UNITS, PHONES, RUNS])
def g33(spark, sf):
    r = W.merge_runs(B.phones(spark, sf)).withColumn("label", F.when(F.col("sym") == "H", "2").otherwise(F.col("sym")))
    out = G.merge_attributes(r, ["file_id", "ipu_id", "run"], ["t_start", "unit_id"])
    return out.na.fill(-1, ["accent_type", "last_label"])
