"""Operators on pronunciation lexica and candidate words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.functions import phones as PH
from spanaccord.functions.text import split_at

# fixed values: short vowels that may be doubled; kana of the five vowels; particles
SHORT_VOWELS = ["a", "e", "i", "o", "ɯ", "ɨ"]
KANA_ROWS = {
    "a": "あかさたなはまやらわがざだばぱアカサタナハマヤラワガザダバパ",
    "i": "いきしちにひみりぎじぢびぴイキシチニヒミリギジヂビピ",
    "u": "うくすつぬふむゆるぐずづぶぷウクスツヌフムユルグズヅブプ",
    "e": "えけせてねへめれげぜでべぺエケセテネヘメレゲゼデベペ",
    "o": "おこそとのほもよろごぞどぼぽオコソトノホモヨロゴゾドボポ",
}
PARTICLES = "をはがにへともの"


def doubled_at(seq: Column) -> Column:
    """Start positions of equal short vowels side by side."""
    n = F.greatest(F.size(seq) - 1, F.lit(0))
    z = F.transform(F.arrays_zip(F.slice(seq, F.lit(1), n).alias("a"), F.slice(seq, F.lit(2), n).alias("b")),
                    lambda x, i: F.when((x["a"] == x["b"]) & x["a"].isin(SHORT_VOWELS), i))
    return F.array_compact(z)


def fold_doubled(seq: Column) -> Column:
    """Equal short vowels side by side become one long symbol, pairs taken from the left."""
    step = F.aggregate(
        seq, F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open")),
        lambda acc, p: F.when(
            (acc["open"] == p) & p.isin(SHORT_VOWELS),
            F.struct(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(p, F.lit("ː")))).alias("out"), F.lit("").alias("open")),
        ).otherwise(F.struct(F.concat(acc["out"], F.array(p)).alias("out"), p.alias("open"))),
        lambda acc: acc["out"],
    )
    return step


def doubled_kana(surface: Column) -> Column:
    """Does a spelling hold a length mark or a kana followed by the kana of its vowel."""
    hit = surface.contains("ー")
    for v in KANA_ROWS.values():
        second = v[0] + v[len(v) // 2]
        hit = hit | surface.rlike(f"[{v}][{second}]")
    return hit


def doubled_vowel_verdict(lex: DataFrame) -> DataFrame:
    """Entries with a doubled vowel judged by five ordered signals.

    ``lex``: word, symbols (array).  The cross reference asks whether the folded
    sequence is the pronunciation of any entry.
    """
    e = lex.where(F.size(doubled_at(F.col("symbols"))) > 0).select(
        "word", "symbols", F.array_join(fold_doubled(F.col("symbols")), " ").alias("_folded")
    )
    known = lex.select(F.array_join("symbols", " ").alias("_folded")).distinct().withColumn("_x", F.lit(True))
    j = e.join(known, "_folded", "left")
    latin = F.regexp_count("word", F.lit("[A-Za-zＡ-Ｚａ-ｚ0-9０-９]"))
    letters = (latin >= 2) & (latin / F.length("word") >= 0.6)
    signal = (
        F.when(F.col("word").contains("・"), "compound_mark").when(letters, "letter_spelling")
        .when(F.col("word").rlike(f"[{PARTICLES}]"), "particle_phrase").when(F.coalesce("_x", F.lit(False)), "cross_reference")
        .when(doubled_kana(F.col("word")), "doubled_kana").otherwise("uncertain")
    )
    keep = F.col("signal").isin("compound_mark", "letter_spelling", "particle_phrase")
    out = j.select("word", "symbols", signal.alias("signal"))
    return out.withColumn("verdict", F.when(keep, "keep").when(F.col("signal") == "uncertain", "uncertain").otherwise("merge"))


def bigram_report(df: DataFrame, by: str, decided: str) -> DataFrame:
    """Rate of illegal neighbours per category and the decision with and without them."""
    v = F.col("_v")
    d = df.withColumn("_v", PH.bigram_violations(F.col("citation")) > 0).withColumn("_s", PH.bigram_violations(F.col("applied")) > 0)
    y = F.col(decided).cast("double")
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v).alias("citation_bad"), F.count_if("_s").alias("applied_bad"),
        F.avg(v.cast("int")).alias("citation_rate"), (F.avg(F.when(v, y)) - F.avg(F.when(~v, y))).alias("effect"),
    )


def synthesise(df: DataFrame) -> DataFrame:
    """The given applied form, or the rewritten citation form where it lacks the change."""
    ok = PH.variant_valid(F.col("change"), F.col("citation"), F.col("applied"))
    made = PH.rewrite_at(F.col("change"), F.col("citation"), F.col("border"))
    d = df.withColumn("_ok", ok).withColumn("form", F.when(F.col("_ok"), F.col("applied")).otherwise(made))
    still = PH.variant_valid(F.col("change"), F.col("citation"), F.col("form"))
    return d.withColumn("note", F.when(F.col("_ok"), "given").when(still, "rewritten").otherwise("still_invalid")).drop("_ok")


def two_way_lexicon(pairs: DataFrame, prons: DataFrame) -> DataFrame:
    """Pronunciations of both spellings; undecidable when one is missing or both are equal.

    ``prons``: word, pron, one row per word (the first one).
    """
    f = prons.select(F.col("word").alias("form"), F.col("pron").alias("pron_form"))
    o = prons.select(F.col("word").alias("orig"), F.col("pron").alias("pron_orig"))
    j = pairs.select("form", "orig").distinct().join(f, "form", "left").join(o, "orig", "left")
    why = F.when(F.col("pron_form").isNull() | F.col("pron_orig").isNull(), "missing").when(F.col("pron_form") == F.col("pron_orig"), "equal").otherwise("")
    return j.select("form", "orig", "pron_form", "pron_orig", why.alias("why"), (why == "").alias("decidable"))


def parts_needed(df: DataFrame, word: str, k: str) -> DataFrame:
    """Distinct left and right parts and whole words."""
    s = split_at(F.col(word), F.col(k))
    return df.select(F.explode(F.array(s["left"], s["right"], F.col(word))).alias("part")).where("part <> ''").distinct()
