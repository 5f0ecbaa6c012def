"""Queries for lookups, interval joins and run comparisons."""

from pyspark.sql import functions as F

from spanaccord.operators import intervals as I, joins as J, neighbours as W
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, HYP, MAP, UNITS, words
from spanaccord.plans.registry import query

WORDS_SQL = """wd AS (SELECT file_id, ipu_id, min(t_start) AS w_start, max(t_end) AS w_end FROM ref WHERE event_id % 7 <> 0 GROUP BY 1, 2)"""


def spans(spark, sf, units=None):
    """Word-like spans: the windows without some of their units."""
    u = B.windowed_units(spark, sf) if units is None else units
    return u.where("event_id % 7 <> 0").groupBy("file_id", "ipu_id").agg(F.min("t_start").alias("w_start"), F.max("t_end").alias("w_end"))


@query("j01_map_label", """SELECT unit_id, coalesce(m.machine_label, hyp.label) AS mapped, coalesce(m.category, 'unknown') AS category FROM hyp LEFT JOIN (SELECT source_label, first(machine_label ORDER BY ord) AS machine_label, first(category ORDER BY ord) AS category FROM lm GROUP BY 1) m ON m.source_label = hyp.label""", ctes=[UNITS, HYP, MAP])
def j01(spark, sf):
    return J.map_label(B.hyp_units(spark, sf), B.label_map(spark)).select("unit_id", "mapped", "category")


@query("j02_map_reverse", """SELECT unit_id, m.source_label, m.category FROM hyp LEFT JOIN (SELECT machine_label, last(source_label ORDER BY ord) AS source_label, last(category ORDER BY ord) AS category FROM lm GROUP BY 1) m ON m.machine_label = hyp.label""", ctes=[UNITS, HYP, MAP])
def j02(spark, sf):
    return J.map_reverse(B.hyp_units(spark, sf), B.label_map(spark)).select("unit_id", "source_label", "category")


@query("j03_compatible", """SELECT h.unit_id, EXISTS (SELECT 1 FROM lm WHERE lm.source_label = r.label AND lm.machine_label = h.label) AS compatible FROM hyp h JOIN ref r USING (event_id)""", ctes=[UNITS, HYP, MAP])
def j03(spark, sf):
    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r).select("event_id", "unit_id", F.col("label").alias("hyp_label"))
    df = r.select("event_id", F.col("label").alias("ref_label")).join(h, "event_id")
    return J.compatible(df, B.label_map(spark), "ref_label", "hyp_label").select("unit_id", "compatible")


@query("j04_join_units", """SELECT a.event_id, a.error_type, r.merged_from, r.boundary_source_end, r.unit_id IS NOT NULL AS unit_found FROM aln a LEFT JOIN (SELECT * FROM ref WHERE event_id % 97 <> 0) r ON r.unit_id = a.ref_unit_id""", ctes=[UNITS, ALN])
def j04(spark, sf):
    u = B.windowed_units(spark, sf)
    out = J.join_units(B.alignment(spark, sf, u), u.where("event_id % 97 <> 0"), ["merged_from", "boundary_source_end"])
    return out.select("event_id", "error_type", "merged_from", "boundary_source_end", "unit_found")


@query("j05_join_id_list", """SELECT event_id, min(h.t_start) AS h_min, max(h.t_end) AS h_max, first(h.t_start ORDER BY i) AS h_start, last(h.t_end ORDER BY i) AS h_end, count(*) AS n_found
  FROM (SELECT event_id, unnest(hyp_unit_ids) AS id, generate_subscripts(hyp_unit_ids, 1) AS i FROM aln WHERE ref_unit_id IS NOT NULL) a JOIN hyp h USING (event_id) WHERE h.unit_id = a.id GROUP BY 1""", "h_min h_max h_start h_end", [UNITS, HYP, ALN])
def j05(spark, sf):
    r = B.ref_units(spark, sf)
    return J.join_id_list(B.alignment(spark, sf, r).where("ref_unit_id is not null"), B.hyp_units(spark, sf, r), "event_id")


@query("j06_point_in_interval", """SELECT h.unit_id, w.ipu_id FROM hyp h JOIN wd w ON w.file_id = h.file_id AND (h.t_start + h.t_end) / 2 >= w.w_start AND (h.t_start + h.t_end) / 2 < w.w_end QUALIFY row_number() OVER (PARTITION BY h.file_id, h.unit_id ORDER BY w.w_start, w.w_end, w.ipu_id) = 1""", ctes=[UNITS, HYP, WORDS_SQL])
def j06(spark, sf):
    u = B.windowed_units(spark, sf)
    return I.point_in_interval(B.hyp_units(spark, sf, u), spans(spark, sf, u), ["file_id"]).select("unit_id", "ipu_id")


@query("j07_contained", """SELECT w.file_id, w.ipu_id, string_agg(h.label, ' ' ORDER BY h.t_start, h.label) AS labels FROM hyp h JOIN wd w ON w.file_id = h.file_id AND h.t_start >= w.w_start - 1e-6 AND h.t_end <= w.w_end + 1e-6 GROUP BY 1, 2""", ctes=[UNITS, HYP, WORDS_SQL])
def j07(spark, sf):
    u = B.windowed_units(spark, sf)
    j = I.contained(B.hyp_units(spark, sf, u), spans(spark, sf, u), ["file_id"], 1e-6, s_start="w_start", s_end="w_end")
    return I.ordered_labels(j, ["file_id", "ipu_id"], "t_start", "label")


@query("j08_centre_within", """SELECT h.unit_id, w.ipu_id FROM hyp h JOIN wd w ON w.file_id = h.file_id AND (h.t_start + h.t_end) / 2 >= w.w_start - 0.03 AND (h.t_start + h.t_end) / 2 <= w.w_end + 0.03""", ctes=[UNITS, HYP, WORDS_SQL])
def j08(spark, sf):
    u = B.windowed_units(spark, sf)
    return I.centre_within(B.hyp_units(spark, sf, u), spans(spark, sf, u), ["file_id"], s_start="w_start", s_end="w_end").select("unit_id", "ipu_id")


@query("j09_assign_windows", """SELECT h.unit_id, w.ipu_id FROM hyp h JOIN wd w ON w.file_id = h.file_id AND h.t_end > w.w_start AND h.t_start < w.w_end AND ((w.w_start <= (h.t_start + h.t_end) / 2 AND (h.t_start + h.t_end) / 2 < w.w_end) OR (h.t_start >= w.w_start AND h.t_end <= w.w_end))""", ctes=[UNITS, HYP, WORDS_SQL])
def j09(spark, sf):
    u = B.windowed_units(spark, sf)
    return I.assign_windows(B.hyp_units(spark, sf, u), spans(spark, sf, u), ["file_id"]).select("unit_id", "ipu_id")


@query("j10_build_windows", """SELECT file_id, CASE WHEN event_id % 3 = 0 THEN '_nofile' ELSE ipu_id END AS ipu_id, min(t_start) AS w_start, max(t_end) AS w_end FROM ref GROUP BY 1, 2""", "w_start w_end", [UNITS])
def j10(spark, sf):
    u = B.windowed_units(spark, sf).withColumn("ipu_id", F.when(F.col("event_id") % 3 != 0, F.col("ipu_id")))
    return I.build_windows(u)


@query("j11_nearest_boundary", """SELECT r.unit_id AS id, min(abs(r.t_start - h.t)) AS nearest FROM ref r LEFT JOIN (SELECT file_id, t_start AS t FROM hyp UNION ALL SELECT file_id, t_end FROM hyp) h ON h.file_id = r.file_id GROUP BY 1""", "nearest", [UNITS, HYP], digits=5)
def j11(spark, sf):
    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r)
    b = h.select("file_id", F.explode(F.array("t_start", "t_end")).alias("t"))
    return I.nearest_boundary(r.select("file_id", F.col("unit_id").alias("id"), F.col("t_start").alias("t")), b, ["file_id"]).select("id", "nearest")


@query("j12_containing_utterance", """WITH u AS (SELECT file_id, w_start AS u_start, w_end AS u_end, CASE WHEN ipu_id LIKE '%3' THEN '<SIL>' WHEN ipu_id LIKE '%5' THEN ' ' ELSE ipu_id END AS text FROM wd)
  SELECT h.unit_id, first(u.text ORDER BY u_start, u_end, u.text) AS text FROM hyp h JOIN u ON u.file_id = h.file_id AND u.u_start <= h.t_start AND h.t_end <= u.u_end WHERE trim(u.text) <> '' AND u.text NOT LIKE '<%' GROUP BY 1""", ctes=[UNITS, HYP, WORDS_SQL])
def j12(spark, sf):
    w = B.windowed_units(spark, sf)
    u = spans(spark, sf, w).select(
        "file_id", F.col("w_start").alias("u_start"), F.col("w_end").alias("u_end"),
        F.when(F.col("ipu_id").endswith("3"), "<SIL>").when(F.col("ipu_id").endswith("5"), " ").otherwise(F.col("ipu_id")).alias("text"),
    )
    h = B.hyp_units(spark, sf, w).select("file_id", "unit_id", F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    return I.containing_utterance(h, u, ["file_id"], "unit_id", "text").select("unit_id", "text")


@query("j13_match_by_length", """WITH a AS (SELECT l_partkey AS k, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS id, l_discount AS la FROM lineitem WHERE l_returnflag = 'A'),
  b AS (SELECT l_partkey AS k, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS id2, l_tax AS lb FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')
  SELECT a.id, coalesce(min(CASE WHEN abs(la - lb) < 0.005 THEN id2 END), CASE WHEN count(*) = 1 THEN min(id2) END) AS partner FROM a JOIN b USING (k) GROUP BY a.k, a.id, a.la""")
def j13(spark, sf):
    li = B.table(spark, sf, "lineitem")
    cid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")
    a = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"), cid.alias("id"), F.col("l_discount").alias("la"))
    b = li.where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_partkey").alias("k"), cid.alias("id2"), F.col("l_tax").alias("lb"))
    return J.match_by_length(a, b, ["k"], "id", "la", "lb", "id2", 0.005).select("id", "partner")


@query("j14_locate_word", """WITH it AS (SELECT doc, CASE WHEN pos % 2 = 0 THEN pos ELSE pos + 1 END AS idx, word AS form FROM words WHERE pos % 5 < 2)
  SELECT it.doc, it.idx, it.form, CASE WHEN w.word = it.form THEN it.idx ELSE f.first END AS found_pos FROM it LEFT JOIN words w ON w.doc = it.doc AND w.pos = it.idx
  LEFT JOIN (SELECT doc, word, min(pos) AS first FROM words GROUP BY 1, 2) f ON f.doc = it.doc AND f.word = it.form""", ctes=[words("benchmark", "item_id")])
def j14(spark, sf):
    w = B.words(spark, sf, "benchmark", "item_id").withColumn("pos", F.col("pos").cast("long"))
    it = w.where("pos % 5 < 2").select("doc", F.when(F.col("pos") % 2 == 0, F.col("pos")).otherwise(F.col("pos") + 1).alias("idx"), F.col("word").alias("form"))
    return J.locate_word(it, w, ["doc"], "idx", "form").select("doc", "idx", "form", "found_pos")


@query("j15_shared_boundaries", """WITH ev AS (SELECT unit_id, t_start, lag(unit_id) OVER w AS prev_uid, lag(t_end) OVER w AS prev_t_end FROM ref WHERE excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured'
    WINDOW w AS (PARTITION BY file_id, ipu_id ORDER BY t_start, t_end, unit_id)),
  m AS (SELECT a.phone_class, a.ref_unit_id, ev.*, ev.t_start + onset_error_ms / 1e3 AS h_start, a.t_end + offset_error_ms / 1e3 AS h_end FROM aln a JOIN ev ON ev.unit_id = a.ref_unit_id WHERE error_type IN ('displacement','substitution')),
  s AS (SELECT m.*, p.h_end AS ph FROM m LEFT JOIN m p ON p.ref_unit_id = m.prev_uid)
  SELECT phone_class, count(*) AS n, count(prev_uid) AS has_prev, count(ph) AS prev_matched, sum((coalesce(ph IS NOT NULL AND abs(t_start - prev_t_end) <= 0.0005, false))::INT)::BIGINT AS shared_ref,
    sum((coalesce(ph IS NOT NULL AND abs(t_start - prev_t_end) <= 0.0005 AND abs(h_start - ph) <= 0.0005, false))::INT)::BIGINT AS shared_both FROM s GROUP BY 1""", ctes=[UNITS.replace("ev AS", "evx AS").replace("FROM ev WINDOW", "FROM evx WINDOW"), ALN])
def j15(spark, sf):
    from spanaccord.operators.reshape import MATCHED, evaluable

    u = B.windowed_units(spark, sf)
    ev = W.prev_in_window(evaluable(u)).select(F.col("unit_id").alias("ref_unit_id"), "prev_uid", "prev_t_end")
    m = B.alignment(spark, sf, u).where(F.col("error_type").isin(*MATCHED)).join(ev, "ref_unit_id")
    m = m.withColumn("h_start", F.col("t_start") + F.col("onset_error_ms") / F.lit(1e3)).withColumn("h_end", F.col("t_end") + F.col("offset_error_ms") / F.lit(1e3))
    n = lambda c, name: F.sum(F.col(c).cast("int")).alias(name)
    return J.shared_boundaries(m).groupBy("phone_class").agg(
        F.count("*").alias("n"), F.count("prev_uid").alias("has_prev"), n("prev_matched", "prev_matched"), n("shared_ref", "shared_ref"), n("shared_both", "shared_both")
    )


@query("j16_vocab_intersect", """WITH a AS (SELECT DISTINCT lower(word) AS w FROM words), b AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '\\s+'))) AS w FROM benchmark)
  SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b WHERE w <> '') AS n_b, (SELECT count(*) FROM a JOIN b USING (w)) AS n_both, (SELECT count(*) FROM a JOIN b USING (w))::DOUBLE / (SELECT count(*) FROM a) AS share""", "share", [words()])
def j16(spark, sf):
    a = B.words(spark, sf).select(F.lower("word").alias("w"))
    b = B.words(spark, sf, "benchmark", "item_id").select(F.lower("word").alias("w"))
    return J.vocab_intersect(a, b, "w")


LEX = """lex AS (SELECT p_type AS word, p_name AS symbols, p_retailprice AS prob FROM part)"""


@query("j17_patch_lexicon", """WITH nw AS (SELECT n_name AS word, p_name AS symbols, 1.0::DOUBLE AS prob FROM nation JOIN part ON p_partkey = n_nationkey UNION ALL SELECT 'PROMO', 'new entry', 0.5)
  SELECT word, symbols, prob FROM lex WHERE word NOT IN (SELECT word FROM nw) UNION ALL SELECT word, symbols, prob FROM nw""", "prob", [LEX])
def j17(spark, sf):
    p = B.table(spark, sf, "part")
    base = p.select(F.col("p_type").alias("word"), F.col("p_name").alias("symbols"), F.col("p_retailprice").alias("prob"))
    n = B.table(spark, sf, "nation").join(p, F.col("p_partkey") == F.col("n_nationkey"))
    new = n.select(F.col("n_name").alias("word"), F.col("p_name").alias("symbols"), F.lit(1.0).alias("prob"))
    promo = n.limit(1).select(F.lit("PROMO").alias("word"), F.lit("new entry").alias("symbols"), F.lit(0.5).alias("prob"))
    return J.patch_lexicon(base, new.unionByName(promo))


@query("j18_exclude_used", """SELECT cand_id FROM dcs WHERE utterance_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""", ctes=[DEC])
def j18(spark, sf):
    used = B.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("utterance_id"))
    return J.exclude_used(B.decisions(spark, sf), used, ["utterance_id"]).select("cand_id")


@query("j19_compare_runs", """WITH a AS (SELECT cand_id, process, aligner FROM dcs WHERE identity_safe = 1 OR human = 1), b AS (SELECT cand_id, process, CASE WHEN mix % 4 = 0 THEN 1 - aligner ELSE aligner END AS aligner FROM dcs WHERE mix <> 9)
  SELECT process, count(*) FILTER (a.cand_id IS NOT NULL AND b.cand_id IS NOT NULL) AS n_both, count(*) FILTER (b.cand_id IS NULL) AS only_a, count(*) FILTER (a.cand_id IS NULL) AS only_b,
  count(*) FILTER (a.aligner = 0 AND b.aligner = 1) AS to_one, count(*) FILTER (a.aligner = 1 AND b.aligner = 0) AS to_zero, count(*) FILTER (a.aligner <> b.aligner) AS flips FROM a FULL JOIN b USING (cand_id, process) GROUP BY 1""", ctes=[DEC])
def j19(spark, sf):
    d, mix = runs(spark, sf)
    a = d.where("identity_safe = 1 or human = 1")
    b = d.where(mix != 9).withColumn("aligner", F.when(mix % 4 == 0, 1 - F.col("aligner")).otherwise(F.col("aligner")))
    return J.compare_runs(a, b, ["cand_id"], "aligner", ["process"])


def runs(spark, sf):
    """Decisions with a digit that tells the runs apart."""
    p = F.split("cand_id", "-")
    mix = (p[0].cast("long") * 7 + p[1].cast("long") * 3 + p[2].cast("long")) % 10
    return B.decisions(spark, sf), mix


@query("j20_common_keys", """WITH u AS (SELECT cand_id, aligner AS s, 0 AS r FROM dcs WHERE mix <> 1 UNION ALL SELECT cand_id, human, 1 FROM dcs WHERE mix <> 2 UNION ALL SELECT cand_id, identity_safe, 2 FROM dcs WHERE mix <> 3)
  SELECT differs, count(*) AS n FROM (SELECT cand_id, count(DISTINCT s) > 1 AS differs FROM u GROUP BY 1 HAVING count(DISTINCT r) = 3) GROUP BY 1""", ctes=[DEC])
def j20(spark, sf):
    d, mix = runs(spark, sf)
    three = [d.where(mix != i + 1).select("cand_id", F.col(c).alias("s")) for i, c in enumerate(("aligner", "human", "identity_safe"))]
    return J.common_keys(three, "cand_id", "s").groupBy("differs").agg(F.count("*").alias("n"))


@query("j21_first_by_priority", """WITH u AS (SELECT n_nationkey AS k, n_name AS v, 0 AS source_rank FROM nation WHERE n_regionkey > 2 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, 2 FROM customer)
  SELECT k, first(v ORDER BY source_rank, v) AS v, min(source_rank) AS source_rank FROM u GROUP BY 1""", big="source_rank")
def j21(spark, sf):
    n = B.table(spark, sf, "nation").where("n_regionkey > 2").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    s = B.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return J.first_by_priority([n, s, c], ["k"], ["v"])


@query("j22_system_pairs", "SELECT a.lang AS system_a, b.source AS system_b FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT source FROM documents) b")
def j22(spark, sf):
    return J.system_pairs(B.table(spark, sf, "documents"), "lang", "source")


@query("j23_parent_child", """WITH c AS (SELECT w.file_id, w.ipu_id, count(*) AS n FROM ref r JOIN wd w ON w.file_id = r.file_id AND r.t_start >= w.w_start - 1e-4 AND r.t_end <= w.w_end + 1e-4 GROUP BY 1, 2)
  SELECT least(n, 4) AS n_children, count(*) AS parents, sum(n - 1)::BIGINT AS "inner" FROM c GROUP BY 1""", ctes=[UNITS, WORDS_SQL])
def j23(spark, sf):
    u = B.windowed_units(spark, sf)
    p = spans(spark, sf, u).select("file_id", F.col("ipu_id").alias("span_id"), F.col("w_start").alias("s_start"), F.col("w_end").alias("s_end"))
    return I.parent_child_counts(u.select("file_id", "unit_id", "t_start", "t_end"), p, ["file_id"], "span_id")


@query("j24_attach_variants", """WITH v AS (SELECT p_partkey % 97 AS w, p_type AS process, max(p_size % 2) AS valid FROM part GROUP BY 1, 2)
  SELECT l_partkey AS k, l_linenumber AS i, coalesce(v.valid, 0) AS valid, count(*) AS n FROM lineitem l JOIN part p USING (p_partkey) LEFT JOIN v ON v.w = l.l_orderkey % 97 AND v.process = p.p_type GROUP BY 1, 2, 3""".replace("USING (p_partkey)", "ON p.p_partkey = l.l_partkey"), big="i valid")
def j24(spark, sf):
    p = B.table(spark, sf, "part")
    v = p.groupBy((F.col("p_partkey") % 97).alias("w"), F.col("p_type").alias("process")).agg(F.max(F.col("p_size") % 2).alias("valid"))
    d = B.table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_orderkey") % 97).alias("w"), F.col("p_type").alias("process")
    )
    return J.attach_variants(d, v, ["w", "process"], "valid").groupBy("k", "i", "valid").agg(F.count("*").alias("n"))


@query("j25_candidate_table", """WITH dev AS (SELECT l_orderkey AS k, l_quantity + l_discount AS dev, l_linenumber IN (2, 3) AS site FROM lineitem WHERE l_returnflag <> 'N')
  SELECT o_orderkey AS cand_id, median(dev) AS dev_word_ms, median(CASE WHEN site THEN dev END) AS dev_site_ms, count(dev) AS n_bound_word, count(CASE WHEN site THEN 1 END) AS n_bound_site,
  CASE WHEN count(dev) > 0 THEN 1 ELSE 0 END AS has_boundary, coalesce(max(p_size % 2), 0) AS identity_safe
  FROM orders LEFT JOIN dev ON k = o_orderkey LEFT JOIN part ON p_partkey = o_orderkey GROUP BY 1""", "dev_word_ms dev_site_ms", big="has_boundary identity_safe")
def j25(spark, sf):
    dec = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cand_id"))
    dev = B.table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("cand_id"), (F.col("l_quantity") + F.col("l_discount")).alias("dev_ms"), F.col("l_linenumber").isin(2, 3).alias("at_site")
    )
    var = B.table(spark, sf, "part").select(F.col("p_partkey").alias("cand_id"), (F.col("p_size") % 2).alias("identity_safe"))
    return J.candidate_table(dec, dev, var)
