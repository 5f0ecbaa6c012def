"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanaccord.llm import decontam, langid, lengths, linededup, negatives, packing, pii, prefixes, quality, rules, simhash, vafile, warc
from spanaccord.llm.common import table

#: where the public vocabularies lie; a parameter of every operator that needs one
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{VOCABULARIES}/{name}"
    return public_tokenizers.path(name)


def fold(of: int, at: int) -> Column:
    """Whether a document is in a fold: crc32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == at, F.lit(False))


def op1_va_top_k(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vafile.top_k(e, e.where("vec_id % 50 = 0"), k=5)


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    got = warc.resolve_revisits(warc.captures(table(spark, sf, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return got.select("record_id", "url_key", "outcome", "source_id", merged.alias("headers"))


def op4_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.limits(lengths.histogram(lengths.encoded_lengths(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))))


def op5_pii_boosting(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.digest(docs, pii.fit(docs))


def op6_compression_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), fold(5, 0)
    model = quality.fit(docs, table(spark, sf, "labels"), ~held)
    return quality.score(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")])


def op7_pack_differencing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


def op8_language_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), fold(3, 1)
    return langid.predict(docs, langid.fit(docs, ~held), [F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")])


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.line_report(table(spark, sf, "documents"))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf, "documents"))


def op11_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.verdicts(table(spark, sf, "documents"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mine(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=negatives.moved_label)


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_va_top_k, op2_decontaminate, op3_warc_revisits, op4_length_histogram, op5_pii_boosting, op6_compression_quality,
    op7_pack_differencing, op8_language_hierarchy, op9_line_dedup, op10_simhash, op11_quality_rules, op12_hard_negatives, op13_prefix_trie,
)}
ORACLES: dict[str, str] = {"op1_va_top_k": vafile.TOP_K_SQL, "op11_quality_rules": rules.verdicts_sql(), "op12_hard_negatives": negatives.MINE_SQL, "op13_prefix_trie": prefixes.TRIE_SQL}
