"""Readers that turn annotation files into flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spanaccord import schema

TICKS_PER_S = 1e7


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Lookup table with a header; lines that start with # are skipped anywhere."""
    d = spark.read.csv(path, sep="\t", header=True, comment="#", quote="")
    return d.select(*[F.trim(f"`{c}`").alias(c.strip()) for c in d.columns])


def read_units(spark: SparkSession, path: str, columns: T.StructType = schema.UNIT) -> DataFrame:
    """Typed table from TSV; blanks are null, flags are 1 and 0."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in columns])
    d = spark.read.csv(path, sep="\t", header=True, schema=text, nullValue="", quote="")

    def typed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return (c == "1").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.when(c.isNull(), F.array().cast(f.dataType)).otherwise(F.split(c, ";")).alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return d.select(*[typed(f) for f in columns])


def read_candidates(spark: SparkSession, path: str, columns: T.StructType | str | None = None) -> DataFrame:
    """S3: table with a header; all columns are text unless a schema is given."""
    r = spark.read.option("header", True).option("escape", '"')
    return r.schema(columns).csv(path) if columns is not None else r.csv(path)


def read_utterances(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per word of every utterance of every document."""
    d = spark.read.schema(schema.CORPUS).json(path, multiLine=multiline)
    u = d.select(F.explode("document").alias("d")).select(F.explode("d.utterance").alias("u")).select("u.*")
    words = F.posexplode(F.filter(F.split(F.trim("form"), r"\s+"), lambda w: w != ""))
    return u.select(F.col("id").alias("utterance_id"), "speaker_id", "form", "original_form", words.alias("word_index", "word"))


def read_xml_units(spark: SparkSession, path: str, row_tag: str = "Talk", multiline: bool = True) -> DataFrame:
    """One row per phone with the attributes of its recording, window, word and mora.

    The schema is explicit: inference would turn a single child into a struct.
    Words and phones are looked for at both depths at which they occur.  Without ``multiline`` a
    file has one recording per line.
    """
    d = spark.read.format("xml").option("rowTag", row_tag).option("multiLine", multiline).schema(schema.TALK).load(path)
    i = d.select(F.col("_TalkID").alias("file_id"), F.coalesce("_SpeakerID", F.lit("unknown")).alias("speaker_id"), F.explode("IPU").alias("i"))
    suws = F.flatten(F.array_compact(F.array(F.col("i.SUW"), F.flatten("i.LUW.SUW"))))
    s = i.select("file_id", "speaker_id", F.col("i._IPUID").alias("ipu_id"), F.col("i._IPUStartTime").alias("ipu_start"), F.col("i._IPUEndTime").alias("ipu_end"), suws.alias("s"))
    on = lambda x, c: F.coalesce(x[c] == "1", F.lit(False))
    masked = F.exists("s", lambda w: F.exists(F.coalesce(w["TransSUW"], F.array().cast(schema.TALK["IPU"].dataType.elementType["SUW"].dataType.elementType["TransSUW"].dataType)),
                                               lambda t: on(t, "_TagMaskStart") | on(t, "_TagMaskMidst") | on(t, "_TagMaskEnd")))
    word = F.array_join(F.transform("s", lambda w: F.trim(F.coalesce(w["_PlainOrthographicTranscription"], F.lit("")))), "")
    s = s.withColumn("masked", masked).withColumn("word", F.nullif(word, F.lit("")))
    head = ["file_id", "speaker_id", "ipu_id", "ipu_start", "ipu_end", "masked", "word"]
    w = s.select(*head, F.explode("s").alias("w"))
    acc = F.element_at("w.XJToBILabelWord", -1)["_PerceivedAccPos"].try_cast("int")
    m = w.select(*head, acc.alias("accent_type"), F.explode(F.flatten(F.array_compact(F.array(F.col("w.Mora"), F.flatten("w.TransSUW.Mora"))))).alias("m"))
    p = m.select(
        *head, "accent_type", on(F.col("m"), "_TagVLong").alias("tag_vlong"), on(F.col("m"), "_TagCLong").alias("tag_clong"), on(F.col("m"), "_PerceivedAcc").alias("is_accent_nucleus"),
        F.explode(F.flatten(F.array_compact(F.array(F.col("m.Phone"), F.flatten("m.Phoneme.Phone"))))).alias("p"),
    )
    x = F.col("p")
    return p.select(
        *head, "accent_type", "tag_vlong", "tag_clong", "is_accent_nucleus",
        F.col("p._PhoneStartTime").alias("t_start"), F.col("p._PhoneEndTime").alias("t_end"), F.col("p._PhoneEntity").alias("entity"), F.col("p._PhoneClass").alias("cls"),
        on(x, "_Devoiced").alias("devoiced"), on(x, "_StartTimeUncertain").alias("start_uncertain"), on(x, "_EndTimeUncertain").alias("end_uncertain"),
    )


def parse_tiers(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Interval rows of the named tiers in a text column."""
    parts = df.select(*keys, F.split(content, r"item \[\d+\]:").alias("_p"))
    t = parts.select(*keys, F.explode(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0)))).alias("_t"))
    number = r"xmin\s*=\s*([-\d.eE]+)\s+xmax\s*=\s*([-\d.eE]+)\s+text\s*=\s*\"((?:[^\"]|\"\")*)\""
    get = lambda i: F.regexp_extract_all("_t", F.lit(number), F.lit(i))
    z = F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c"))
    return t.select(*keys, F.regexp_extract("_t", r'name\s*=\s*"([^"]*)"', 1).alias("tier"), F.posexplode(z).alias("position", "z")).select(
        *keys, "tier", "position", F.col("z.a").cast("double").alias("start"), F.col("z.b").cast("double").alias("end"), F.replace("z.c", F.lit('""'), F.lit('"')).alias("text")
    )


def read_tiers(spark: SparkSession, path: str, encoding: str = "UTF-8", pattern: str = "*.TextGrid") -> DataFrame:
    """Interval rows of all tiers of all files; the file name is ``file_id``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    d = d.select(stem(F.col("path")).alias("file_id"), F.decode("content", encoding).alias("_content"))
    return parse_tiers(d, "_content", ["file_id"])


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Time-stamped lines in 100 ns ticks; the centre of the context is the label."""
    line = r"^\s*(\d+)\s+(\d+)\s+[^\s]*?\^[^\s]*?-([^\s+]+)\+"
    d = spark.read.text(path).select(stem(F.input_file_name()).alias("file_id"), F.col("value"))
    g = lambda i: F.regexp_extract("value", line, i)
    return d.where(F.col("value").rlike(line)).select(
        "file_id", (g(1).cast("double") / TICKS_PER_S).alias("t_start"), (g(2).cast("double") / TICKS_PER_S).alias("t_end"), g(3).alias("label")
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Word, zero to four probabilities, symbols; the first of equal entries stays.

    ``ord`` is the place in the file: file name and line order are kept by the
    ordered id of the scan.
    """
    from spanaccord.functions.columns import norm_word

    d = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split(F.trim("value"), r"\s+").alias("x")).where("size(x) > 1")
    rest = F.slice("x", F.lit(2), F.size("x"))
    is_p = lambda i: F.coalesce(F.get(rest, F.lit(i)).rlike(r"^(\d+\.\d+|1)"), F.lit(False))
    n = F.when(~is_p(0), 0).when(~is_p(1), 1).when(~is_p(2), 2).when(~is_p(3), 3).otherwise(4)
    e = d.select(
        "ord", norm_word(F.get("x", F.lit(0))).alias("word"), F.transform(F.slice(rest, F.lit(1), n), lambda v: v.cast("double")).alias("probs"),
        F.slice(rest, n + 1, F.size("x")).alias("pron"),
    )
    best = F.min_by(F.struct("ord", "probs"), "ord").alias("_b")
    return e.groupBy("word", "pron").agg(best).select("word", "_b.probs", "pron", "_b.ord")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``id:text`` lines; lines without a colon are skipped."""
    d = spark.read.text(path).where(F.col("value").contains(":"))
    at = F.instr("value", ":")
    return d.select(F.trim(F.substring("value", F.lit(1), at - 1)).alias("id"), F.trim(F.substring("value", at + 1, F.length("value"))).alias("text"))


def list_files(spark: SparkSession, root: str, pattern: str = "*", limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Files below a folder by name pattern, in path order, optionally limited to ids or to the first few."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    d = d.select("path", stem(F.col("path")).alias("file_id"), "length")
    if ids is not None:
        d = d.join(ids.select("file_id").distinct(), "file_id", "left_semi").select("path", "file_id", "length")
    d = d.orderBy("path")
    return d if limit is None else d.limit(limit)
