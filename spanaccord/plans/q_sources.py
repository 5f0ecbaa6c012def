"""Queries that write derived data in a file format and read it back."""

from pyspark.sql import functions as F

from spanaccord import settings
from spanaccord.operators import neighbours as W
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import DEC, PHONES, RUNS, UNITS, words
from spanaccord.plans.registry import query
from spanaccord.sources import readers as R, sinks as K


@query("s01_read_mapping", "SELECT p_partkey::VARCHAR AS source_label, p_name AS machine_label, p_type AS category FROM part")
def s01(spark, sf):
    path = settings.scratch(spark, "mapping")
    cells = B.table(spark, sf, "part").select(
        F.concat(F.lit(" "), "p_partkey").alias("source_label"), F.concat("p_name", F.lit(" ")).alias("machine_label"), F.col("p_type").alias("category"), "p_partkey"
    )
    cols = ["source_label", "machine_label", "category"]
    cells.select(cols).write.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # comment lines of their own
    cells.where("p_partkey % 7 = 0").select(F.lit("# note").alias("value")).write.mode("append").text(path)
    return R.read_mapping(spark, path)


@query("s02_read_units", "SELECT unit_id, t_start, t_end, devoiced, accent_type, excluded_reason FROM ref", "t_start t_end", [UNITS])
def s02(spark, sf):
    path = settings.scratch(spark, "units")
    K.write_units(B.windowed_units(spark, sf).select("unit_id", "t_start", "t_end", "devoiced", "accent_type", "excluded_reason"), path)
    from spanaccord.schema import _struct

    return R.read_units(spark, path, _struct("unit_id:s t_start:d t_end:d devoiced:b accent_type:i excluded_reason:s"))


@query("s03_read_candidates", "SELECT cand_id, process, human::BIGINT AS human, dev_word_ms FROM dcs", "dev_word_ms", [DEC])
def s03(spark, sf):
    path = settings.scratch(spark, "cands")
    B.decisions(spark, sf).select("cand_id", "process", "human", "dev_word_ms").write.csv(path, header=True)
    return R.read_candidates(spark, path, "cand_id string, process string, human int, dev_word_ms double")


@query("s04_read_utterances", "SELECT utterance_id, speaker_id, i - 1 AS word_index, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id || '.' || turn AS utterance_id, role AS speaker_id, list_filter(regexp_split_to_array(trim(text, E' \\n\\t'), '\\s+'), lambda x: x <> '') AS w FROM conversations))")
def s04(spark, sf):
    path = settings.scratch(spark, "corpus")
    c = B.table(spark, sf, "conversations")
    u = F.struct(F.concat_ws(".", "conv_id", "turn").alias("id"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("form"), F.col("text").alias("original_form"), F.col("role").alias("speaker_id"))
    d = c.groupBy("conv_id").agg(F.collect_list(u).alias("utterance")).select(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), "utterance")).alias("document"))
    K.write_json(d, path)
    return R.read_utterances(spark, path, multiline=False).select("utterance_id", "speaker_id", "word_index", "word")


@query("s05_read_xml_units", "SELECT file_id, ipu_id, t_start, t_end, sym AS entity, devoiced, start_uncertain, coalesce(accent_type, -1) AS accent_type FROM ph WHERE file_id NOT LIKE 'R%'", "t_start t_end", [UNITS, PHONES])
def s05(spark, sf):
    path = settings.scratch(spark, "xml")
    p = B.phones(spark, sf).where("file_id not like 'R%'")
    flag = lambda c: F.col(c).cast("int").cast("string")
    mora = F.format_string(
        '<SUW><XJToBILabelWord PerceivedAccPos="%s"/><TransSUW><Mora TagVLong="%s"><Phoneme><Phone PhoneStartTime="%s" PhoneEndTime="%s" PhoneEntity="%s" Devoiced="%s" StartTimeUncertain="%s"/></Phoneme></Mora></TransSUW></SUW>',
        F.coalesce(F.col("accent_type").cast("string"), F.lit("none")), flag("tag_vlong"), F.col("t_start").cast("string"), F.col("t_end").cast("string"), "sym", flag("devoiced"), flag("start_uncertain"),
    )
    ipu = p.groupBy("file_id", "ipu_id").agg(F.array_join(F.array_sort(F.collect_list(mora)), "").alias("x"))
    ipu = ipu.select("file_id", F.concat(F.lit('<IPU IPUID="'), "ipu_id", F.lit('" IPUStartTime="0" IPUEndTime="1"><LUW>'), "x", F.lit("</LUW></IPU>")).alias("i"))
    # one recording per line: their number grows with the events, that of files with the tasks
    talk = ipu.groupBy("file_id").agg(F.array_join(F.collect_list("i"), "").alias("x"))
    talk.select("file_id", F.concat(F.lit('<Talk TalkID="'), "file_id", F.lit('" SpeakerID="s">'), "x", F.lit("</Talk>")).alias("value")).select("value").write.text(path)
    d = R.read_xml_units(spark, f"{path}/*.txt", multiline=False)
    return d.select("file_id", "ipu_id", "t_start", "t_end", "entity", "devoiced", "start_uncertain", F.coalesce("accent_type", F.lit(-1)).alias("accent_type"))


@query("s06_parse_tiers", """SELECT file_id, tier, position, t_start AS "start", t_end AS "end", text FROM (SELECT file_id, 'phones' AS tier, row_number() OVER (PARTITION BY file_id ORDER BY t_start, unit_id) - 1 AS position, t_start, t_end, '"' || label || '"' AS text FROM ref
  UNION ALL SELECT file_id, 'words', row_number() OVER (PARTITION BY file_id ORDER BY t_start, unit_id) - 1, t_start, t_end, unit_id FROM ref WHERE event_id % 4 = 0)""", '"start" "end"', [UNITS])
def s06(spark, sf):
    u = B.ref_units(spark, sf)

    def tier(df, name, text, n):
        item = F.format_string('        intervals [1]:\n            xmin = %s\n            xmax = %s\n            text = "%s"\n', F.col("t_start").cast("string"), F.col("t_end").cast("string"), text)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_start", "unit_id", item.alias("i")))), lambda x: x["i"]), "")
        return df.groupBy("file_id").agg(F.concat(F.lit(f'    item [{n}]:\n        class = "IntervalTier"\n        name = "{name}"\n        xmin = 0\n        xmax = 9\n        intervals: size = 1\n'), body).alias(name))

    ph = tier(u, "phones", F.concat(F.lit('""'), "label", F.lit('""')), 1)
    wd = tier(u.where("event_id % 4 = 0"), "words", F.col("unit_id"), 2)
    d = ph.join(wd, "file_id", "left").select("file_id", F.concat(F.lit('File type = "ooTextFile"\nitem []:\n'), "phones", F.coalesce("words", F.lit(""))).alias("content"))
    return R.parse_tiers(d, "content", ["file_id"])


@query("s07_read_label_lines", "SELECT round(t_start * 1e7)::BIGINT / 1e7 AS t_start, round(t_end * 1e7)::BIGINT / 1e7 AS t_end, label FROM ref WHERE event_id % 9 <> 0", "t_start t_end", [UNITS])
def s07(spark, sf):
    path = settings.scratch(spark, "lab")
    tick = lambda c: F.round(F.col(c) * 1e7).cast("long").cast("string")
    u = B.ref_units(spark, sf)
    line = F.when(F.col("event_id") % 9 == 0, F.lit("no label here")).otherwise(F.concat_ws(" ", tick("t_start"), tick("t_end"), F.concat(F.lit("x^y-"), "label", F.lit("+z=w/A:1"))))
    u.select(line.alias("value")).write.text(path)
    return R.read_label_lines(spark, path).select("t_start", "t_end", "label")


@query("s08_read_lexicon", "SELECT lower(p_type) AS word, p_name AS symbols, count(*) AS n FROM (SELECT DISTINCT p_type, p_name FROM part) GROUP BY 1, 2")
def s08(spark, sf):
    path = settings.scratch(spark, "lexicon")
    p = B.table(spark, sf, "part")
    prob = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "0.5 ").otherwise("0.99 0.2 1.0 1.1 ")
    p.select(F.concat("p_type", F.lit("\t"), prob, "p_name").alias("value")).write.text(path)
    d = R.read_lexicon(spark, path)
    return d.groupBy("word", F.array_join("pron", " ").alias("symbols")).agg(F.count("*").alias("n"))


@query("s09_read_transcripts", "SELECT 'u' || o_orderkey AS id, o_orderpriority || ':' || o_orderstatus AS text FROM orders WHERE o_orderkey % 5 <> 0")
def s09(spark, sf):
    path = settings.scratch(spark, "transcripts")
    o = B.table(spark, sf, "orders")
    line = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no colon")).otherwise(F.concat(F.lit("u"), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderpriority", F.lit(":"), "o_orderstatus"))
    o.select(line.alias("value")).write.text(path)
    return R.read_transcripts(spark, path)


@query("s10_list_files", "SELECT 'kind=' || p_type AS folder FROM part GROUP BY 1")
def s10(spark, sf):
    path = settings.scratch(spark, "files")
    B.table(spark, sf, "part").select(F.col("p_type").alias("kind"), "p_partkey").write.partitionBy("kind").parquet(path)
    d = R.list_files(spark, path, "*.parquet")
    return d.select(F.regexp_extract("path", r"(kind=[^/]+)", 1).alias("folder")).distinct()


@query("k02_write_unit_set", "SELECT 'unit' AS kind, count(*) AS n FROM runs UNION ALL SELECT 'inner', count(*) FROM (SELECT *, lead(1) OVER (PARTITION BY file_id, ipu_id, run ORDER BY t_start, unit_id) AS nx FROM runs) WHERE nx = 1", ctes=[UNITS, PHONES, RUNS])
def k02(spark, sf):
    path = settings.scratch(spark, "set")
    r = W.merge_runs(B.phones(spark, sf))
    K.write_unit_set(r, W.inner_boundaries(r, ["file_id", "ipu_id"]), path, "parquet")
    count = lambda part, kind: spark.read.parquet(f"{path}_{part}").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("units", "unit").unionByName(count("internal_boundaries", "inner"))


@query("k04_write_json", "SELECT l_returnflag AS process, avg((l_linestatus = 'F')::INT) AS rate FROM lineitem GROUP BY 1", "rate")
def k04(spark, sf):
    path = settings.scratch(spark, "rates")
    K.write_json(B.decisions(spark, sf).groupBy("process").agg(F.avg("human").alias("rate")), path)
    return spark.read.schema("process string, rate double").json(path)
