"""Token decisions (M6) and competing positions of a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanaccord.operators.align import ALL_VOWELS, HIGH_BASE, align_prons, value_of, values_at
from spanaccord.operators.neighbours import nearest_nonempty


def _in(col, vals):
    return col.isin(*sorted(vals))


def anchors(lexicon: DataFrame) -> DataFrame:
    """Per word the variant with the most vowels, then the longest; the first of equals."""
    n_v = F.size(F.filter("pron", lambda x: _in(x, ALL_VOWELS)))
    best = F.min_by("pron", F.struct((-n_v).alias("v"), (-F.size("pron")).alias("l"), F.col("ord")))
    return lexicon.groupBy("word").agg(best.alias("anchor"), F.count(F.lit(1)).alias("n_variants"))


def competing_positions(lexicon: DataFrame) -> DataFrame:
    """Positions of high vowels of the anchor where the variants disagree.

    One row per word, position and variant with its value.
    """
    a = anchors(lexicon).where("n_variants > 1")
    e = align_prons(lexicon.join(a, "word"), "anchor", "pron")
    e = e.select("word", "anchor", "pron", F.posexplode("left").alias("pos", "j"))
    e = e.where(_in(F.get("anchor", F.col("pos")), HIGH_BASE))
    e = e.withColumn("value", F.when(F.col("j") >= 0, value_of(F.get("pron", F.col("j")))).otherwise("A"))
    vals = e.groupBy("word", "pos").agg(F.collect_set("value").alias("v"))
    comp = vals.where(F.array_contains("v", "V") & (F.array_contains("v", "D") | F.array_contains("v", "A")))
    return e.join(comp.select("word", "pos"), ["word", "pos"]).select("word", "anchor", "pron", "pos", "value")


def decide_tokens(aln: DataFrame, units: DataFrame, words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M6: what the machine chose at each reference vowel, or why that is not known.

    ``aln``: file_id, place (order in the file), ref_unit_id, error_type,
    hyp_unit_ids, wanted (is a reference vowel of interest), fused.
    ``units``: unit_id, file_id, seq (running index of evaluable units), wkey,
    pos, label.  ``words``: wkey, word, pron.  ``lexicon``: word, pron.
    """
    rows = nearest_nonempty(aln, ["file_id"], ["place"], "hyp_unit_ids").where("wanted")
    u = units.select("unit_id", "file_id", "seq", "wkey", "pos", "label")

    # matched rows: the one vowel unit, or the gap behind the last unit of a fused reference
    x = rows.where("error_type <> 'omission'").select("ref_unit_id", "fused", F.posexplode("hyp_unit_ids").alias("p", "unit_id"))
    x = x.join(u, "unit_id")
    vowel, high = _in(F.col("label"), ALL_VOWELS), _in(F.col("label"), HIGH_BASE)
    spot = F.struct("wkey", "pos")
    m = x.groupBy("ref_unit_id", "fused").agg(
        F.count_if(vowel).alias("nv"), F.count_if(high).alias("nh"),
        F.min_by(spot, F.when(vowel, F.col("p"))).alias("v"), F.min_by(spot, F.when(high, F.col("p"))).alias("h"),
        F.max_by(spot, "p").alias("last"),
    )
    pick = F.when(F.col("nv") == 1, F.col("v")).when((F.col("nv") > 1) & (F.col("nh") == 1), F.col("h"))
    gap_case = (F.col("nv") == 0) & F.col("fused")
    reason = F.when((F.col("nv") > 1) & (F.col("nh") != 1), "ambiguous_vowel_units").when((F.col("nv") == 0) & ~F.col("fused"), "excluded_no_vowel")
    matched = m.select(
        "ref_unit_id", reason.alias("reason"), F.when(gap_case, F.when(F.col("last.pos").isNotNull(), F.col("last.wkey"))).otherwise(pick["wkey"]).alias("wkey"),
        pick["pos"].alias("pos"), F.when(gap_case, F.col("last.pos") + 1).alias("gap"), F.lit(0).alias("rank"),
    )

    # omissions: the gap between the nearest units of the other side
    side = lambda t: u.select(*[F.col(c).alias(f"{t}_{c}") for c in ("unit_id", "file_id", "seq", "wkey", "pos")])
    size = words.select("wkey", F.size("pron").alias("len"))
    o = rows.where("error_type = 'omission'").select("ref_unit_id", F.col("prev_id").alias("p_unit_id"), F.col("next_id").alias("n_unit_id"))
    o = o.join(side("p"), "p_unit_id", "left").join(side("n"), "n_unit_id", "left")
    o = o.join(size.select(F.col("wkey").alias("p_wkey"), F.col("len").alias("p_len")), "p_wkey", "left")
    edge = F.col("p_unit_id").isNull() | F.col("n_unit_id").isNull()
    adjacent = F.coalesce((F.col("p_file_id") == F.col("n_file_id")) & (F.col("n_seq") == F.col("p_seq") + 1), F.lit(False))
    same = F.coalesce(F.col("p_wkey") == F.col("n_wkey"), F.lit(False))
    cand = lambda k, g, r: F.struct(k.alias("wkey"), g.cast("int").alias("gap"), F.lit(r).alias("rank"))
    cands = F.when(same, F.array(cand(F.col("n_wkey"), F.col("n_pos"), 0))).otherwise(F.array_compact(F.array(
        F.when(F.col("p_wkey").isNotNull() & (F.col("p_pos") == F.col("p_len") - 1), cand(F.col("p_wkey"), F.col("p_len"), 0)),
        F.when(F.col("n_wkey").isNotNull() & (F.col("n_pos") == 0), cand(F.col("n_wkey"), F.lit(0), 1)),
    )))
    why = F.when(edge, "omission_edge").when(~adjacent, "omission_not_adjacent").when(F.size(cands) == 0, "omission_no_word")
    o = o.select("ref_unit_id", why.alias("reason"), F.explode_outer(F.when(why.isNull(), cands)).alias("c"))
    omitted = o.select("ref_unit_id", "reason", "c.wkey", F.lit(None).cast("int").alias("pos"), "c.gap", F.coalesce("c.rank", F.lit(0)).alias("rank"))

    places = matched.unionByName(omitted).join(words.select("wkey", "word", "pron"), "wkey", "left")
    vals = values_at(places.where("reason is null and word is not null"), lexicon)
    j = places.join(vals.withColumn("_known", F.lit(True)), (
        (places.word == vals.word) & (places.pron == vals.pron) & places.pos.eqNullSafe(vals.pos) & places.gap.eqNullSafe(vals.gap)
    ), "left").select(places["*"], vals.vals)
    # of two word edges the first whose variants have a voiced vowel, else the first
    better = F.struct((~F.coalesce(F.contains("vals", F.lit("V")), F.lit(False))).alias("novoice"), "rank")
    t = j.groupBy("ref_unit_id").agg(F.min_by(F.struct("reason", "wkey", "word", "pron", "pos", "gap", "vals"), better).alias("t")).select("ref_unit_id", "t.*")

    hyp_value = F.when(F.col("pos").isNotNull(), value_of(F.get("pron", F.col("pos")))).otherwise("A")
    why = F.coalesce(
        "reason", F.when(F.col("wkey").isNull() | (F.col("pos").isNull() & F.col("gap").isNull()), "no_word"),
        F.when(F.col("vals").isNull(), "word_not_in_dictionary"), F.when(hyp_value.isNull(), "position_not_vowel"),
    )
    has = lambda x: F.contains("vals", F.lit(x))
    comp = has("V") & (has("D") | has("A"))
    out = t.withColumn("reason", why)
    ok = F.col("reason").isNull()
    return out.select(
        "ref_unit_id", "reason", "wkey", "word", "pos", "gap", F.when(ok, F.col("vals")).alias("vals"), F.when(ok, hyp_value).alias("hyp_value"),
        F.when(ok, F.when(hyp_value.isin("D", "A"), "devoiced").otherwise("voiced")).alias("hyp_label"),
        F.when(ok, F.when(comp, "competing").otherwise("lexical")).alias("status"),
        F.when(ok, F.when(~comp, "").when(has("D") & has("A"), "mixed").when(has("D"), "symbol").otherwise("presence")).alias("ctype"),
    )
