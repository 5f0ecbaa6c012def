"""Views over the driver tables that play the part of the annotation data.

Every view grows with its table.  ``plans/oracle.py`` states the same views in
SQL for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanaccord.operators.scan import lag, lead, running_sum, scan
from spanaccord.settings import cut

EPOCH_US = 1704067200000000
WINDOW_GAP_S = 43200.0
#: error types, class per label
CLASSES = {
    "click": "stop", "error": "fricative", "purchase": "nasal", "signup": "vowel_long", "view": "vowel_short",
}
#: (source label, machine label, class); several machine labels per source label
LABEL_MAP = [
    ("click", "click", "stop"), ("click", "tap", "stop"), ("error", "error", "fricative"),
    ("purchase", "purchase", "nasal"), ("purchase", "buy", "nasal"), ("signup", "signup", "vowel_long"),
    ("view", "view", "vowel_short"), ("view", "look", "vowel_short"), ("view", "tap", "vowel_short"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def label_map(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(LABEL_MAP)]
    return spark.createDataFrame(rows, "ord int, source_label string, machine_label string, category string")


def ref_base(spark, sf) -> DataFrame:
    """Units of the first source: an event lasts until the next one of its file."""
    ev = table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.element_at(F.array(F.lit("A"), F.lit("R"), F.lit("S")), (F.col("user_id") % 3 + 1).cast("int")),
            F.col("user_id").cast("string"),
        ).alias("file_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("speaker_id"),
        F.col("event_type").alias("label"),
        "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)).alias("us"),
    )
    out = scan(
        ev, ["file_id"], ["us", "event_id"], {"us_next": lead("us"), "us_prev": lag("us")}, keep_piece=True
    ).where("us_next is not null")
    return (
        out.withColumn("t_start", F.col("us") / F.lit(1e6))
        .withColumn("t_end", F.col("us_next") / F.lit(1e6))
        .withColumn("gap_s", (F.col("us") - F.col("us_prev")) / F.lit(1e6))
    )


def _finish(df: DataFrame) -> DataFrame:
    e = F.col("event_id")
    cls = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    return df.select(
        "file_id", "speaker_id",
        *(["ipu_id"] if "ipu_id" in df.columns else []),
        "event_id",
        F.concat(F.lit("u"), e.cast("string")).alias("unit_id"),
        "t_start", "t_end", "label", "value",
        F.element_at(cls, F.col("label")).alias("phone_class"),
        F.when(e % 31 == 0, "derived").when(e % 37 == 0, "undeterminable").otherwise("measured").alias("boundary_source_start"),
        F.when(e % 47 == 0, "derived").otherwise("measured").alias("boundary_source_end"),
        F.when(e % 41 == 0, "unmapped_label").when(e % 43 == 0, "zero_duration").alias("excluded_reason"),
        (e % 3 + 1).alias("merged_from"),
        (e % 5 == 0).alias("devoiced"),
        (e % 7 == 0).alias("tag_vlong"),
        (e % 9 == 0).alias("tag_clong"),
        (e % 6 == 0).alias("is_accent_nucleus"),
        F.when(e % 4 != 3, e % 4).alias("accent_type"),
    )


def ref_units(spark, sf) -> DataFrame:
    """Reference units without pause windows."""
    return _finish(ref_base(spark, sf))


def windowed_units(spark, sf) -> DataFrame:
    """Reference units with ``ipu_id``: a new window after a long gap."""
    base = ref_base(spark, sf)
    new = F.when(F.col("gap_s").isNull() | (F.col("gap_s") > WINDOW_GAP_S), 1).otherwise(0).cast("long")
    out = scan(base, ["file_id"], ["us", "event_id"], {"ipu_no": running_sum(new)})
    return _finish(out.withColumn("ipu_id", F.concat(F.lit("w"), F.col("ipu_no").cast("string"))))


def hyp_units(spark, sf, units: DataFrame | None = None) -> DataFrame:
    """Units of the second source: dropped, shifted, relabelled and added rows."""
    r = ref_units(spark, sf) if units is None else units
    e = F.col("event_id")
    far = F.when(e % 19 == 0, F.lit(0.4)).otherwise(F.lit(0.0))
    base = r.where(e % 17 != 0).select(
        "file_id", "event_id",
        F.concat(F.lit("h"), e.cast("string")).alias("unit_id"),
        (F.col("t_start") + (e % 11 - 5) * F.lit(0.0073) + far).alias("t_start"),
        (F.col("t_end") + (e % 13 - 6) * F.lit(0.0089) + far).alias("t_end"),
        F.when(e % 23 == 0, "error").when((e % 2 == 0) & (F.col("label") == "view"), "look").otherwise(F.col("label")).alias("label"),
        "phone_class",
    )
    extra = r.where(e % 29 == 0).select(
        "file_id", "event_id",
        F.concat(F.lit("x"), e.cast("string")).alias("unit_id"),
        (F.col("t_start") + 1.0).alias("t_start"),
        (F.col("t_start") + 1.5).alias("t_end"),
        F.lit("tap").alias("label"),
        "phone_class",
    )
    return base.unionByName(extra)


def alignment(spark, sf, units: DataFrame | None = None) -> DataFrame:
    """Typed pairs of the two sources, known from the way the second was made."""
    r = ref_units(spark, sf) if units is None else units
    e = F.col("event_id")
    keep = [c for c in ("ipu_id",) if c in r.columns]
    ok = (
        F.col("excluded_reason").isNull()
        & (F.col("boundary_source_start") == "measured")
        & (F.col("boundary_source_end") == "measured")
    )
    omitted = e % 17 == 0
    sid = e.cast("string")
    main = r.where(ok).select(
        "file_id", "speaker_id", *keep, "event_id",
        F.col("unit_id").alias("ref_unit_id"),
        F.when(omitted, F.array().cast("array<string>"))
        .when(e % 13 == 0, F.array(F.concat(F.lit("h"), sid), F.concat(F.lit("x"), sid)))
        .otherwise(F.array(F.concat(F.lit("h"), sid))).alias("hyp_unit_ids"),
        "label", "phone_class", "t_start", "t_end", "value", "devoiced", "tag_vlong", "tag_clong", "accent_type", "is_accent_nucleus",
        F.when(omitted, "omission").when((e % 23 == 0) & (e % 13 != 0), "substitution").otherwise("displacement").alias("error_type"),
        F.when(~omitted, (e % 11 - 5) * F.lit(7.3) + F.col("value") % F.lit(1.0)).alias("onset_error_ms"),
        F.when(~omitted, (e % 13 - 6) * F.lit(8.9) - F.col("value") % F.lit(1.0)).alias("offset_error_ms"),
        F.when(omitted, 0).when(e % 13 == 0, 2).otherwise(1).cast("long").alias("n_hyp_units"),
    )
    ins = r.where(e % 29 == 0).select(
        "file_id", "speaker_id", *keep, "event_id",
        F.lit(None).cast("string").alias("ref_unit_id"),
        F.array(F.concat(F.lit("x"), sid)).alias("hyp_unit_ids"),
        F.lit("tap").alias("label"), "phone_class", "t_start", "t_end", "value", "devoiced", "tag_vlong", "tag_clong", "accent_type", "is_accent_nucleus",
        F.lit("insertion").alias("error_type"),
        F.lit(None).cast("double").alias("onset_error_ms"),
        F.lit(None).cast("double").alias("offset_error_ms"),
        F.lit(1).cast("long").alias("n_hyp_units"),
    )
    return main.unionByName(ins)


def decisions(spark, sf) -> DataFrame:
    """Binary decisions with speaker, word, process and two scores, one per line item."""
    li = table(spark, sf, "lineitem")
    mix = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % 10
    human = (F.col("l_linestatus") == "F").cast("int")
    aligner = F.when(mix < 3, 1 - human).otherwise(human)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("cand_id"),
        F.col("l_returnflag").alias("process"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("speaker"),
        F.concat(F.lit("w"), (F.col("l_partkey") % 97).cast("string")).alias("word_type"),
        F.col("l_orderkey").alias("utterance_id"),
        human.alias("human"),
        aligner.alias("aligner"),
        (human == aligner).cast("int").alias("correct"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("dev_word_ms"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") + F.col("l_discount")).alias("dev_site_ms"),
        (F.col("l_partkey") % 3 != 0).cast("int").alias("identity_safe"),
    )


def paired(spark, sf) -> DataFrame:
    """Paired durations: one by hand, one by machine, with factors and clusters."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("vowel"),
        F.col("l_linestatus").alias("length_class"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("speaker_id"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 50).cast("string"), F.lit("_"), (F.col("l_partkey") % 4).cast("string")).alias("file_id"),
        (F.col("l_linenumber") % 2 == 0).alias("is_accent_nucleus"),
        F.when(F.col("l_linenumber") > 4, "stop").otherwise("nasal").alias("following_context"),
        F.col("l_quantity").alias("dur_hand_ms"),
        (F.col("l_quantity") * (F.lit(1.0) - F.col("l_discount")) + F.col("l_tax") * 10).alias("dur_mfa_ms"),
    )


def words(spark, sf, name="documents", key="doc_id") -> DataFrame:
    """Words of a text table with their position."""
    return table(spark, sf, name).select(
        F.col(key).alias("doc"), F.posexplode(F.split("text", r"\s+")).alias("pos", "word")
    ).where("word <> ''")


def distinct_words(spark, sf) -> DataFrame:
    """The distinct words of the documents in lower case.

    They are kept: under another distinct or a filter the planner drops this one or moves the filter below it,
    and whatever is made of a word would then be made of each of its occurrences.
    """
    return cut(words(spark, sf).select(F.lower("word").alias("word")).distinct())


SYMBOLS = ["Q", "SclS", "t", "a", "H", "N", "m", "i", "k", "SclS"]


def phones(spark, sf) -> DataFrame:
    """Phone symbols inside the pause windows, with uncertainty flags."""
    e = F.col("event_id")
    sym = F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), ((e * 3 + F.floor(e / 5)) % 10 + 1).cast("int"))
    return windowed_units(spark, sf).select(
        "file_id", "ipu_id", "event_id", "unit_id", "t_start", "t_end", "devoiced", "tag_vlong", "accent_type",
        sym.alias("sym"), sym.isin("a", "i", "H").alias("is_vowel"),
        (e % 3 == 0).alias("start_uncertain"), (e % 4 == 0).alias("end_uncertain"),
    )


def hangul_words(spark, sf) -> DataFrame:
    """Hangul spellings made from the distinct words of the documents: two of three syllables."""
    from spanaccord.functions.hashing import h32

    w = distinct_words(spark, sf)

    def syllable(tag, n):
        cp = F.lit(0xAC00) + h32(F.col("word"), tag) % n
        return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")

    last = F.when(h32(F.col("word"), "d") % 4 == 0, "").otherwise(syllable("c", 11172))
    alt = F.when(h32(F.col("word"), "e") % 3 == 0, syllable("f", 588)).otherwise(syllable("b", 11172))
    return w.select(
        "word", F.concat(syllable("a", 11172), syllable("b", 11172), last).alias("token"),
        F.concat(syllable("a", 11172), alt, last).alias("other"), (h32(F.col("word"), "k") % 3).cast("int").alias("k"),
    )


IPA_LIST = "k ɡ k̚ kʰ t d t̚ tʰ p b p̚ s sʰ tɕ dʑ h m n ŋ ɾ ɭ i e ɐ o u ʌ ɨ j w k͈ ʎː".split()
CHANGES = ["tensification", "aspiration", "nasalization_obstruent", "nasalization_liquid", "liquidization", "palatalization", "liaison"]


def ipa_pairs(spark, sf) -> DataFrame:
    """Citation and applied phone sequences made from the distinct words of the documents."""
    from spanaccord.functions.hashing import h32

    w = distinct_words(spark, sf)
    table = F.array(*[F.lit(x) for x in IPA_LIST])
    h = lambda tag: h32(F.col("word"), tag)
    cit = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.get(table, (h32(F.col("word"), i) % len(IPA_LIST)).cast("int")))
    spot = (h("p") % F.length("word")).cast("int")
    drawn = lambda tag: F.get(table, (h(tag) % len(IPA_LIST)).cast("int"))
    # one symbol differs; in a fifth of the words perhaps also the first one
    san = F.transform("citation", lambda x, i: F.when(i == spot, drawn("q")).when((i == 0) & (h("d") % 5 == 1), drawn("r")).otherwise(x))
    d = w.withColumn("citation", cit).withColumn("applied", san)
    d = d.withColumn("applied", F.when(h("d") % 5 == 0, F.slice("applied", F.lit(1), F.size("applied") - 1)).otherwise(F.col("applied")))
    change = F.get(F.array(*[F.lit(c) for c in CHANGES]), (h("t") % len(CHANGES)).cast("int"))
    return d.select("word", "citation", "applied", change.alias("change"), spot.alias("border"), (h("y") % 2).cast("int").alias("decided"))
