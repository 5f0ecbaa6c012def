"""Queries for bootstraps and sampling designs."""

from pyspark.sql import functions as F

from spanaccord.operators import aggregate as G, resample as RS, sampling as D, scoring as M
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, PAIRED, UNITS
from spanaccord.plans.q_joins import runs
from spanaccord.plans.q_scoring import CELL, MET, systems
from spanaccord.plans.registry import query

REPS = 40
#: replicates of the published analyses
FULL = 2000
H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def weights_sql(name, src, key, seed="1", reps=REPS):
    h = H.format(f"'{seed}|' || b || '|' || idx")
    return f"""{name}_i AS (SELECT {key}, row_number() OVER (ORDER BY md5({key}), {key}) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {src})),
  {name} AS (SELECT i.{key}, b, w FROM (SELECT b, {h} % n AS idx, count(*) AS w FROM {name}_i, (SELECT unnest(range({reps})) AS b) GROUP BY 1, 2) d JOIN {name}_i i USING (idx))"""


def boot_sql(by, value="value"):
    return f"SELECT {by}count({value}) AS n_valid, stddev_samp({value}) AS se, quantile_cont({value}, 0.025) AS low, quantile_cont({value}, 0.975) AS high FROM r"


@query("b01_cluster_weights", "SELECT * FROM cw", ctes=[DEC, weights_sql("cw", "dcs", "speaker")])
def b01(spark, sf):
    return RS.cluster_weights(B.decisions(spark, sf), "speaker", REPS)


W2 = [weights_sql("w1", "dcs", "speaker", "1-speaker"), weights_sql("w2", "dcs", "word_type", "1-word_type")]
CELLS2 = f"""c2 AS (SELECT process, speaker, word_type, {CELL} FROM dcs GROUP BY 1, 2, 3), s2 AS (SELECT process, w1.b, sum(tp * w1.w * w2.w) AS tp, sum(fn * w1.w * w2.w) AS fn, sum(fp * w1.w * w2.w) AS fp, sum(tn * w1.w * w2.w) AS tn
  FROM c2 JOIN w1 USING (speaker) JOIN w2 ON w2.word_type = c2.word_type AND w2.b = w1.b GROUP BY 1, 2)"""


@query("b02_two_way_weights", "SELECT speaker, b, sum(w1.w * w2.w)::BIGINT AS w, count(*) AS n FROM (SELECT DISTINCT speaker, word_type FROM dcs) JOIN w1 USING (speaker) JOIN w2 USING (word_type, b) GROUP BY 1, 2", ctes=[DEC, *W2])
def b02(spark, sf):
    w = RS.two_way_weights(B.decisions(spark, sf), "speaker", "word_type", REPS)
    return w.groupBy("speaker", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


@query("b03_boot_ratio", "WITH s AS (SELECT file_id, phone_class, count(*) AS n, sum((abs(onset_error_ms) <= 20)::INT) AS hit FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1, 2), " + weights_sql("cw", "s", "file_id") + ", r AS (SELECT phone_class, b, sum(hit * w) / sum(n * w) AS value FROM s JOIN cw USING (file_id) GROUP BY 1, 2) " + boot_sql("phone_class, ") + " GROUP BY 1", "se low high", [UNITS, ALN])
def b03(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null")
    st = G.cluster_stats(a, ["file_id", "phone_class"], {"hit": F.abs("onset_error_ms") <= 20})
    return RS.boot_summary(RS.boot_ratio(st, "file_id", ["phone_class"], "hit", "n", REPS), ["phone_class"], "value")


@query("b03_boot_ratio_2000", "WITH s AS (SELECT file_id, phone_class, count(*) AS n, sum((abs(onset_error_ms) <= 20)::INT) AS hit FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1, 2), " + weights_sql("cw", "s", "file_id", reps=FULL) + ", r AS (SELECT phone_class, b, sum(hit * w) / sum(n * w) AS value FROM s JOIN cw USING (file_id) GROUP BY 1, 2) " + boot_sql("phone_class, ") + " GROUP BY 1", "se low high", [UNITS, ALN])
def b03_full(spark, sf):
    a = B.alignment(spark, sf).where("onset_error_ms is not null")
    st = G.cluster_stats(a, ["file_id", "phone_class"], {"hit": F.abs("onset_error_ms") <= 20})
    return RS.boot_summary(RS.boot_ratio(st, "file_id", ["phone_class"], "hit", "n", FULL), ["phone_class"], "value")


@query("b04_boot_metrics", f"WITH c AS (SELECT speaker, process, {CELL} FROM dcs GROUP BY 1, 2), " + weights_sql("cw", "c", "speaker") + f", r AS (SELECT *, {MET} FROM (SELECT process, b, sum(tp * w) AS tp, sum(fn * w) AS fn, sum(fp * w) AS fp, sum(tn * w) AS tn FROM c JOIN cw USING (speaker) GROUP BY 1, 2)) " + boot_sql("process, ", "mcc") + " GROUP BY 1", "se low high", [DEC])
def b04(spark, sf):
    c = M.confusion(B.decisions(spark, sf), ["speaker", "process"])
    return RS.boot_summary(RS.boot_metrics(c, "speaker", ["process"], REPS), ["process"], "mcc")


@query("b04_boot_metrics_2000", f"WITH c AS (SELECT speaker, process, {CELL} FROM dcs GROUP BY 1, 2), " + weights_sql("cw", "c", "speaker", reps=FULL) + f", r AS (SELECT *, {MET} FROM (SELECT process, b, sum(tp * w) AS tp, sum(fn * w) AS fn, sum(fp * w) AS fp, sum(tn * w) AS tn FROM c JOIN cw USING (speaker) GROUP BY 1, 2)) " + boot_sql("process, ", "mcc") + " GROUP BY 1", "se low high", [DEC])
def b04_full(spark, sf):
    c = M.confusion(B.decisions(spark, sf), ["speaker", "process"])
    return RS.boot_summary(RS.boot_metrics(c, "speaker", ["process"], FULL), ["process"], "mcc")


@query("b04_boot_metrics_two_way", "SELECT process, b, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba FROM s2", "ba", [DEC, *W2, CELLS2])
def b04b(spark, sf):
    c = M.confusion(B.decisions(spark, sf), ["speaker", "word_type", "process"])
    return RS.boot_metrics(c, "speaker", ["process"], REPS, key2="word_type").select("process", "b", "ba")


@query("b05_boot_rank", "WITH " + weights_sql("cw", "dcs", "speaker", reps=8) + """, x AS (SELECT b, dev_site_ms AS v, correct, sum(w) AS w FROM dcs JOIN cw USING (speaker) WHERE dev_site_ms IS NOT NULL GROUP BY 1, 2, 3),
  m AS (SELECT b, correct, min(v) FILTER (hi >= n / 2) AS m FROM (SELECT *, sum(w) OVER (PARTITION BY b, correct ORDER BY v) AS hi, sum(w) OVER (PARTITION BY b, correct) AS n FROM x) GROUP BY 1, 2),
  g AS (SELECT b, v, sum(CASE WHEN correct = 0 THEN w ELSE 0 END) AS p, sum(CASE WHEN correct = 1 THEN w ELSE 0 END) AS q FROM x GROUP BY 1, 2), a AS (SELECT b, sum(p * (below + 0.5 * q)) / (sum(p)::DOUBLE * sum(q)) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY b ORDER BY v) - q AS below FROM g) GROUP BY 1)
  SELECT a.b, a.auc, max(m) FILTER (correct = 0) - max(m) FILTER (correct = 1) AS diff FROM a JOIN m USING (b) GROUP BY 1, 2""", "auc diff", [DEC])
def b05(spark, sf):
    return RS.boot_rank(B.decisions(spark, sf), "speaker", "dev_site_ms", "correct", 8)


X6 = """x6 AS (SELECT speaker_id, ln(dur_mfa_ms) - ln(dur_hand_ms) AS y, (length_class = 'O')::INT::DOUBLE AS x FROM paired)"""


@query("b06_boot_ols", "WITH " + weights_sql("cw", "x6", "speaker_id") + """, s AS (SELECT b, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM (SELECT b, y, x, unnest(range(w)) FROM x6 JOIN cw USING (speaker_id)) GROUP BY 1)
  SELECT b, 0 AS term, b0 AS value FROM s UNION ALL SELECT b, 1, b1 FROM s""", "value", [PAIRED, X6], digits=8, big="term")
def b06(spark, sf):
    d = B.paired(spark, sf).withColumn("y", F.log("dur_mfa_ms") - F.log("dur_hand_ms"))
    return RS.boot_ols(d, "speaker_id", [F.lit(1.0), (F.col("length_class") == "O").cast("double")], F.col("y"), REPS)


@query("b07_boot_delta", f"WITH s AS (SELECT 'base' AS system, speaker, human, aligner FROM dcs UNION ALL SELECT 'prior', speaker, human, CASE WHEN mix % 4 = 0 THEN human ELSE aligner END FROM dcs), c AS (SELECT system, speaker, {CELL} FROM s GROUP BY 1, 2), " + weights_sql("cw", "c", "speaker")
       + f", m AS (SELECT *, {MET} FROM (SELECT system, b, sum(tp * w) AS tp, sum(fn * w) AS fn, sum(fp * w) AS fp, sum(tn * w) AS tn FROM c JOIN cw USING (speaker) GROUP BY 1, 2)) SELECT a.system, a.b, a.agree - z.agree AS delta_agree, a.ba - z.ba AS delta_ba, a.mcc - z.mcc AS delta_mcc FROM m a JOIN m z ON z.b = a.b AND z.system = 'base' AND a.system = 'prior'", "delta_agree delta_ba delta_mcc", [DEC])
def b07(spark, sf):
    c = M.confusion(systems(spark, sf), ["system", "speaker"])
    return RS.boot_delta(c, "speaker", "system", "base", REPS).select("system", "b", "delta_agree", "delta_ba", "delta_mcc")


@query("b08_boot_mean", "WITH v AS (SELECT speaker, avg(dev_word_ms) AS v FROM dcs GROUP BY 1), " + weights_sql("cw", "v", "speaker") + " SELECT b, sum(v * w) / sum(w) AS value FROM v JOIN cw USING (speaker) GROUP BY 1", "value", [DEC])
def b08(spark, sf):
    v = B.decisions(spark, sf).groupBy("speaker").agg(F.avg("dev_word_ms").alias("v"))
    return RS.boot_mean(v, "speaker", "v", REPS)


@query("b09_boot_summary", "WITH v AS (SELECT word_type, avg(correct) AS v FROM dcs GROUP BY 1), " + weights_sql("cw", "v", "word_type") + ", r AS (SELECT b, sum(v * w) / sum(w) AS value FROM v JOIN cw USING (word_type) GROUP BY 1) " + boot_sql(""), "se low high", [DEC])
def b09(spark, sf):
    v = B.decisions(spark, sf).groupBy("word_type").agg(F.avg("correct").alias("v"))
    return RS.boot_summary(RS.boot_mean(v, "word_type", "v", REPS), [], "value")


@query("b09_boot_summary_2000", "WITH v AS (SELECT word_type, avg(correct) AS v FROM dcs GROUP BY 1), " + weights_sql("cw", "v", "word_type", reps=FULL) + ", r AS (SELECT b, sum(v * w) / sum(w) AS value FROM v JOIN cw USING (word_type) GROUP BY 1) " + boot_sql(""), "se low high", [DEC])
def b09_full(spark, sf):
    v = B.decisions(spark, sf).groupBy("word_type").agg(F.avg("correct").alias("v"))
    return RS.boot_summary(RS.boot_mean(v, "word_type", "v", FULL), [], "value")


M12 = "WITH c AS (SELECT speaker, process, (human = aligner)::INT AS ok FROM dcs), s AS (SELECT speaker, process, sum(ok) AS k, count(*) AS n FROM c GROUP BY 1, 2), " + weights_sql("cw", "s", "speaker") + """, r AS (SELECT process, b, sum(k * w) / sum(n * w) - 0.7 AS value FROM s JOIN cw USING (speaker) GROUP BY 1, 2),
  q AS (SELECT process, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM r GROUP BY 1), e AS (SELECT process, sum(k) / sum(n) - 0.7 AS estimate FROM s GROUP BY 1)
  SELECT process, estimate, low, high, NOT 0.5 BETWEEN low AND high AS excludes_half, estimate < 0.02 AS small_increment, CASE WHEN estimate > 0 AND low > 0 THEN 'supported' WHEN estimate > 0 THEN 'direction_only' ELSE 'not_supported' END AS verdict FROM e JOIN q USING (process)"""


@query("m12_verdict", M12, "estimate low high", [DEC])
def m12(spark, sf):
    d = B.decisions(spark, sf)
    st = G.cluster_stats(d, ["speaker", "process"], {"k": F.col("correct")})
    r = RS.boot_ratio(st, "speaker", ["process"], "k", "n", REPS).withColumn("value", F.col("value") - 0.7)
    e = d.groupBy("process").agg((F.avg("correct") - 0.7).alias("estimate"))
    return M.verdict(e.join(RS.boot_summary(r, ["process"], "value").select("process", "low", "high"), "process"))


@query("d01_cap_sample", "SELECT process, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY process ORDER BY md5('1|' || cand_id), cand_id) AS r FROM dcs) WHERE r <= 500", ctes=[DEC])
def d01(spark, sf):
    return D.cap_sample(B.decisions(spark, sf), ["process"], 500, "cand_id").select("process", "cand_id")


@query("d01_cap_sample_40000", "SELECT process, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY process ORDER BY md5('1|' || cand_id), cand_id) AS r FROM dcs) WHERE r <= 40000", ctes=[DEC])
def d01_full(spark, sf):
    return D.cap_sample(B.decisions(spark, sf), ["process"], 40_000, "cand_id").select("process", "cand_id")


@query("d03_draw_2000_per_category", "SELECT l_returnflag, cand FROM (SELECT l_returnflag, concat_ws('-', l_orderkey, l_linenumber) AS cand, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('1|' || concat_ws('-', l_orderkey, l_linenumber)), concat_ws('-', l_orderkey, l_linenumber)) AS r FROM lineitem) WHERE r <= 2000")
def d03_full(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_returnflag", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cand"))
    return D.cap_sample(li, ["l_returnflag"], 2000, "cand")


@query("d02_speaker_split", """WITH s AS (SELECT c_custkey AS speaker, (SELECT string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS stratum FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('1|' || speaker), speaker) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s) SELECT speaker, stratum, CASE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def d02(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("speaker"), "o_orderstatus")
    return D.speaker_split(o, "speaker", "o_orderstatus")


@query("d03_draw_per_category", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('1|' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 50")
def d03(spark, sf):
    return D.cap_sample(B.table(spark, sf, "part"), ["p_type"], 50, "p_partkey").select("p_type", "p_partkey")


def case_control_sql(processes, cap) -> str:
    """One pass after another: the first row of every unit that no pass before has used."""
    made, ctes = [], ["h AS (SELECT *, md5('1|' || cand_id) AS h FROM dcs)"]
    for lab in (0, 1):
        for p in processes:
            used = " UNION ALL ".join(f"SELECT utterance_id FROM {m}" for m in made)
            free = f" AND utterance_id NOT IN ({used})" if made else ""
            most = cap if lab == 0 else f"(SELECT count(*) FROM pick_0_{p})"
            ctes.append(f"pick_{lab}_{p} AS MATERIALIZED (SELECT process, human, utterance_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY h, cand_id) AS q FROM h WHERE process = '{p}' AND human = {lab}{free}) WHERE q = 1 ORDER BY h, cand_id LIMIT {most})")
            made.append(f"pick_{lab}_{p}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM {m}" for m in made)


@query("d04_case_control", case_control_sql(["A", "N", "R"], 150), ctes=[DEC], big="human")
def d04(spark, sf):
    d = B.decisions(spark, sf)
    return D.case_control(d, ["A", "N", "R"], 150).select("process", "human", "utterance_id", "cand_id")


@query("d05_balanced_draws", f"""WITH n AS (SELECT word_type, least(sum(human), count(*) - sum(human)) AS k FROM dcs GROUP BY 1), d AS (SELECT dcs.*, k, draw, row_number() OVER (PARTITION BY draw, word_type, human ORDER BY {H.format("'1|' || draw || '|' || cand_id")}, cand_id) AS r FROM dcs JOIN n USING (word_type), (SELECT unnest(range(3)) AS draw)),
  c AS (SELECT draw, {CELL} FROM d WHERE r <= k GROUP BY 1) SELECT draw, tp, fn, fp, tn, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba FROM c""", "ba", [DEC])
def d05(spark, sf):
    s = D.balanced_draws(B.decisions(spark, sf), "word_type", "human", "cand_id", 3)
    return M.class_metrics(M.confusion(s, ["draw"])).select("draw", "tp", "fn", "fp", "tn", "ba")


@query("d06_spread_sample", """WITH o AS (SELECT process, word_type, speaker, cand_id, md5('1|' || cand_id) AS h, row_number() OVER (PARTITION BY process, word_type, speaker ORDER BY md5('1|' || cand_id), cand_id) AS q FROM dcs),
  u AS (SELECT *, row_number() OVER (PARTITION BY process, speaker ORDER BY h, cand_id) AS use FROM o WHERE q = 1), r AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY use, h, cand_id) AS rank FROM u) SELECT process, word_type, speaker, use, rank, cand_id FROM r WHERE rank <= 150""", ctes=[DEC])
def d06(spark, sf):
    d = B.decisions(spark, sf).select("process", "word_type", "speaker", "cand_id")
    return D.spread_sample(d, "process", ["word_type"], "speaker", "cand_id", 150)


@query("d07_cross_half_rates", """WITH i AS (SELECT speaker, ntile(2) OVER (ORDER BY md5('1' || speaker), '1' || speaker) AS h FROM (SELECT DISTINCT speaker FROM dcs)) SELECT CASE h WHEN 1 THEN 'B' ELSE 'A' END AS apply_to, process, count(*) AS n, avg(human) AS rate FROM dcs JOIN i USING (speaker) GROUP BY 1, 2""", "rate", [DEC])
def d07(spark, sf):
    return D.cross_half_rates(B.decisions(spark, sf), "speaker", "process", "human")


@query("d08_grouped_folds", "SELECT speaker, (row_number() OVER (ORDER BY md5(speaker), speaker) - 1) % 10 AS fold FROM (SELECT DISTINCT speaker FROM dcs)", ctes=[DEC])
def d08(spark, sf):
    return D.grouped_folds(B.decisions(spark, sf), "speaker", 10)
