"""Queries for neighbour and run operators."""

from pyspark.sql import functions as F

from spanaccord.operators import neighbours as W
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, DEC, PHONES, RUNS, UNITS, words
from spanaccord.plans.registry import query

WIN = "WINDOW w AS (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id)"


@query("w01_next_class", f"SELECT unit_id, coalesce(lead(phone_class) OVER w, 'final') AS following_context FROM ref {WIN}", ctes=[UNITS])
def w01(spark, sf):
    return W.next_class(B.windowed_units(spark, sf)).select("unit_id", "following_context")


@query("w01_turn_next_role", "SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'final') AS following_context FROM conversations")
def w01b(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return W.next_class(c, ["conv_id"], ["turn"], "role").select("conv_id", "turn", "following_context")


@query("w02_prev_in_file", "SELECT unit_id, lag(phone_class) OVER w AS prev_class, lag(label) OVER w AS prev_label FROM ref WINDOW w AS (PARTITION BY file_id ORDER BY t_start, unit_id)", ctes=[UNITS])
def w02(spark, sf):
    return W.prev_in_file(B.ref_units(spark, sf)).select("unit_id", "prev_class", "prev_label")


@query("w03_prev_in_window", f"SELECT unit_id, lag(unit_id) OVER w AS prev_uid, lag(t_end) OVER w AS prev_t_end FROM ref {WIN}", "prev_t_end", [UNITS])
def w03(spark, sf):
    return W.prev_in_window(B.windowed_units(spark, sf)).select("unit_id", "prev_uid", "prev_t_end")


@query("w04_next_skipping", """SELECT unit_id, n.phone_class AS next_class, n.label AS next_label FROM (SELECT unit_id,
  first_value(CASE WHEN phone_class NOT IN ('stop','nasal') THEN {'phone_class': phone_class, 'label': label} END IGNORE NULLS) OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM ref)""", ctes=[UNITS])
def w04(spark, sf):
    return W.next_skipping(B.windowed_units(spark, sf), ["stop", "nasal"]).select("unit_id", "next_class", "next_label")


@query("w05_absorb_marker", f"""WITH a AS (SELECT *, coalesce(sym = 'SclS' AND coalesce(lag(sym) OVER w, '') <> 'Q' AND lead(sym) OVER w IN ('t','k'), false) AS gone FROM ph {WIN}),
  b AS (SELECT *, CASE WHEN lag(gone) OVER w THEN lag(t_end) OVER w END AS burst_t, CASE WHEN lag(gone) OVER w THEN lag(t_start) OVER w ELSE t_start END AS s FROM a {WIN})
  SELECT unit_id, sym, s AS t_start, t_end, burst_t FROM b WHERE NOT gone""", "t_start t_end burst_t", [UNITS, PHONES])
def w05(spark, sf):
    return W.absorb_marker(B.phones(spark, sf)).select("unit_id", "sym", "t_start", "t_end", "burst_t")


@query("w06_merge_runs", "SELECT file_id, ipu_id, run, string_agg(sym, '+' ORDER BY t_start, unit_id) AS label_source, count(*) AS merged_from, min(t_start) AS t_start, max(t_end) AS t_end FROM runs GROUP BY 1, 2, 3", "t_start t_end", [UNITS, PHONES, RUNS])
def w06(spark, sf):
    r = W.merge_runs(B.phones(spark, sf))
    parts = F.array_sort(F.collect_list(F.struct("t_start", "unit_id", "sym")))
    return r.groupBy("file_id", "ipu_id", "run").agg(
        F.array_join(F.transform(parts, lambda x: x["sym"]), "+").alias("label_source"),
        F.count("*").alias("merged_from"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"),
    )


@query("w07_merge_pairs", """WITH a AS (SELECT *, coalesce((sym IN ('a','i','u','e','o') AND lead(sym) OVER w = sym) OR (sym = 'Q' AND lead(sym) OVER w IS NOT NULL) OR (sym = 'N' AND lead(sym) OVER w IN ('m','n','ny','my')), false) AS link,
  row_number() OVER w AS rn FROM ph WINDOW w AS (PARTITION BY file_id ORDER BY t_start, unit_id)),
  b AS (SELECT *, max(CASE WHEN NOT link THEN rn END) OVER (PARTITION BY file_id ORDER BY t_start, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM a),
  c AS (SELECT *, link AND (rn - coalesce(stop, 0)) % 2 = 1 AS st FROM b),
  d AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY file_id ORDER BY t_start, unit_id), false) AS second FROM c),
  e AS (SELECT *, sum(CASE WHEN second THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY t_start, unit_id)::BIGINT AS pair FROM d)
  SELECT file_id, pair, string_agg(sym, ' ' ORDER BY t_start, unit_id) AS label_source, count(*) AS merged_from FROM e GROUP BY 1, 2""", ctes=[UNITS, PHONES])
def w07(spark, sf):
    s, n = F.col("sym"), F.col("_next")
    link = (s.isin(*W.VOWELS) & (n == s)) | ((s == W.GEMINATE) & n.isNotNull()) | ((s == W.MORAIC_NASAL) & n.isin(*W.NASALS))
    r = W.merge_pairs(B.phones(spark, sf), ["file_id"], W.TIME, link, "sym")
    parts = F.array_sort(F.collect_list(F.struct("t_start", "unit_id", "sym")))
    return r.groupBy("file_id", "pair").agg(
        F.array_join(F.transform(parts, lambda x: x["sym"]), " ").alias("label_source"), F.count("*").alias("merged_from")
    )


@query("w08_inner_boundaries", """WITH a AS (SELECT *, lead(start_uncertain) OVER w AS nsu, lead(t_end - t_start) OVER w AS nd, lead(1) OVER w AS has, row_number() OVER w - 1 AS position,
  bool_or(devoiced) OVER (PARTITION BY file_id, ipu_id, run) AS dev FROM runs WINDOW w AS (PARTITION BY file_id, ipu_id, run ORDER BY t_start, unit_id))
  SELECT file_id, ipu_id, run, t_end AS t, position, CASE WHEN NOT (end_uncertain OR nsu OR abs(t_end - t_start) < 1e-9 OR abs(nd) < 1e-9) THEN 'measured' WHEN dev THEN 'undeterminable' ELSE 'derived' END AS source
  FROM a WHERE has = 1""", "t", [UNITS, PHONES, RUNS])
def w08(spark, sf):
    return W.inner_boundaries(W.merge_runs(B.phones(spark, sf)), ["file_id", "ipu_id"])


@query("w09_word_position", "SELECT unit_id, row_number() OVER (PARTITION BY file_id, label ORDER BY t_start, unit_id) - 1 AS word_phone_index FROM ref", ctes=[UNITS])
def w09(spark, sf):
    return W.word_position(B.ref_units(spark, sf), ("file_id", "label")).select("unit_id", "word_phone_index")


@query("w10_unit_ids", "SELECT unit_id, printf('%s_%04d', file_id, row_number() OVER (PARTITION BY file_id ORDER BY t_start, unit_id) - 1) AS new_id FROM ref", ctes=[UNITS])
def w10(spark, sf):
    return W.unit_ids(B.ref_units(spark, sf)).select("unit_id", "new_id")


SPEECH = """sp AS (SELECT l_orderkey AS k, (l_linenumber * 10 + l_suppkey % 7)::DOUBLE AS s, (l_linenumber * 10 + l_suppkey % 7)::DOUBLE + (l_partkey % 19 - 2)::DOUBLE AS e, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS text, 75.0::DOUBLE AS total FROM lineitem)"""


@query("w11_fill_gaps", """WITH d AS (SELECT k, greatest(s, 0) AS s, least(e, total) AS e, text FROM sp WHERE least(e, total) > greatest(s, 0)),
  c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM d),
  f AS (SELECT *, greatest(s, cur) AS s2 FROM c WHERE e > greatest(s, cur)),
  t AS (SELECT sp.k, max(total) AS total, coalesce(max(d.e), 0) AS last FROM (SELECT DISTINCT k, total FROM sp) sp LEFT JOIN d ON d.k = sp.k GROUP BY 1)
  SELECT k, cur AS "start", s2 AS "end", '' AS text FROM f WHERE s2 > cur UNION ALL SELECT k, s2, e, text FROM f UNION ALL SELECT k, last, total, '' FROM t WHERE total > last""", '"start" "end"', [SPEECH])
def w11(spark, sf):
    li = B.table(spark, sf, "lineitem")
    s = (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7).cast("double")
    d = li.select(
        F.col("l_orderkey").alias("k"), s.alias("start"), (s + (F.col("l_partkey") % 19 - 2)).alias("end"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("text"), F.lit(75.0).alias("total"),
    )
    return W.fill_gaps(d, ["k"], "total", "text")


@query("w12_nearest_nonempty", """SELECT event_id, error_type, last_value(CASE WHEN len(hyp_unit_ids) > 0 THEN hyp_unit_ids[-1] END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t_start, error_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id,
  first_value(CASE WHEN len(hyp_unit_ids) > 0 THEN hyp_unit_ids[1] END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY t_start, error_type ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM aln""", ctes=[UNITS, ALN])
def w12(spark, sf):
    return W.nearest_nonempty(B.alignment(spark, sf), ["file_id"], ["t_start", "error_type"], "hyp_unit_ids").select("event_id", "error_type", "prev_id", "next_id")


@query("w13_concentration", """WITH n AS (SELECT word, count(*) AS n FROM words GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, word) AS cum, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, word) AS rn FROM n)
  SELECT min(rn) FILTER (cum >= 0.5 * t) AS types_50, min(rn) FILTER (cum >= 0.8 * t) AS types_80, min(rn) FILTER (cum >= 0.9 * t) AS types_90, sum(n) FILTER (rn <= 10)::DOUBLE / max(t) AS top10_share, count(*) AS n_types FROM c""", "top10_share", [words()])
def w13(spark, sf):
    return W.concentration(B.words(spark, sf), "word")


@query("w14_order_by_median", """SELECT phone_class, median(abs(onset_error_ms)) AS median, row_number() OVER (ORDER BY median(abs(onset_error_ms)), phone_class) AS rank FROM aln WHERE onset_error_ms IS NOT NULL GROUP BY 1""", "median", [UNITS, ALN])
def w14(spark, sf):
    return W.order_by_median(B.alignment(spark, sf), "phone_class", F.abs(F.col("onset_error_ms")))
