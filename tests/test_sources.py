"""Readers and writers on small files."""

from pathlib import Path

from pyspark.sql import functions as F

from spanaccord import schema
from spanaccord.sources import readers as R, sinks as K


def put(path: Path, text: str, encoding="utf-8") -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_mapping_skips_comments(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "# head\nsrc\tdst \n# note\n a\tb\nc\t-\n")
    assert [tuple(r) for r in R.read_mapping(spark, p).collect()] == [("a", "b"), ("c", "-")] and R.read_mapping(spark, p).columns == ["src", "dst"]


TIERS = '''File type = "ooTextFile"
Object class = "TextGrid"
xmin = 0
xmax = 2
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = 2
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 1.5
            text = "say ""hi"""
        intervals [2]:
            xmin = 1.5
            xmax = 2
            text = ""
    item [2]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 2
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 2
            text = "k̚"
'''


def test_tiers_in_two_encodings(spark, tmp_path):
    put(tmp_path / "a" / "x" / "one.TextGrid", TIERS, "utf-16")
    put(tmp_path / "b" / "two.TextGrid", TIERS)
    for folder, enc, name in (("a", "UTF-16", "one"), ("b", "UTF-8", "two")):
        rows = [tuple(r) for r in R.read_tiers(spark, str(tmp_path / folder), enc).orderBy("tier", "position").collect()]
        assert rows == [(name, "phones", 0, 0.0, 2.0, "k̚"), (name, "words", 0, 0.0, 1.5, 'say "hi"'), (name, "words", 1, 1.5, 2.0, "")]


def test_label_lines(spark, tmp_path):
    p = put(tmp_path / "u1.lab", "0 1500000 xx^xx-sil+m=i/A:1\n1500000 2000000 xx^sil-m+i=z/A:2\nbad line\n")
    assert [tuple(r) for r in R.read_label_lines(spark, p).orderBy("t_start").collect()] == [("u1", 0.0, 0.15, "sil"), ("u1", 0.15, 0.2, "m")]


def test_lexicon_drops_numbers_and_repeats(spark, tmp_path):
    p = put(tmp_path / "d.dict", "Ａb\t0.99\t0.2\t1.0\t1.1\tk a\nab k a\nab\t1\tk i\nlonely\nc 0.5 0.5 0.5 0.5 0.5\n")
    got = [(r.word, r.pron, len(r.probs)) for r in R.read_lexicon(spark, p).orderBy("ord").collect()]
    assert got == [("ab", ["k", "a"], 4), ("ab", ["k", "i"], 1), ("c", ["0.5"], 4)]


def test_transcripts(spark, tmp_path):
    p = put(tmp_path / "t.txt", "u1:a:b\nno\nu2: c \n")
    assert [tuple(r) for r in R.read_transcripts(spark, p).collect()] == [("u1", "a:b"), ("u2", "c")]


def test_utterances(spark, tmp_path):
    p = put(tmp_path / "c.json", '{"document": [{"id": "d", "utterance": [{"id": "d.1", "form": "가 나", "original_form": "가 나요", "speaker_id": "s"}]}]}')
    got = [(r.utterance_id, r.word_index, r.word) for r in R.read_utterances(spark, p).collect()]
    assert got == [("d.1", 0, "가"), ("d.1", 1, "나")]


XML = """<?xml version="1.0"?>
<Talk TalkID="A01" SpeakerID="7">
 <IPU IPUID="1" IPUStartTime="0.0" IPUEndTime="1.0"><LUW><SUW PlainOrthographicTranscription="あ"><XJToBILabelWord PerceivedAccPos="2"/>
  <TransSUW><Mora PerceivedAcc="1"><Phoneme><Phone PhoneStartTime="0.0" PhoneEndTime="0.5" PhoneEntity="a" PhoneClass="vowel" Devoiced="1"/></Phoneme></Mora></TransSUW></SUW></LUW></IPU>
 <IPU IPUID="2" IPUStartTime="1.0" IPUEndTime="2.0"><SUW><TransSUW TagMaskMidst="1"/><Mora TagVLong="1"><Phone PhoneStartTime="1.0" PhoneEndTime="1.5" PhoneEntity="k" StartTimeUncertain="1"/></Mora></SUW></IPU>
</Talk>"""


def test_xml_at_both_depths(spark, tmp_path):
    d = R.read_xml_units(spark, put(tmp_path / "a.xml", XML)).orderBy("t_start").collect()
    a, b = d
    assert (a.file_id, a.speaker_id, a.ipu_id, a.word, a.accent_type, a.is_accent_nucleus, a.devoiced, a.masked) == ("A01", "7", "1", "あ", 2, True, True, False)
    assert (b.ipu_id, b.word, b.accent_type, b.tag_vlong, b.start_uncertain, b.masked) == ("2", None, None, True, True, True)


def test_units_round_trip(spark, tmp_path):
    row = {f.name: None for f in schema.UNIT} | {"file_id": "f", "unit_id": "u", "t_start": 0.125, "devoiced": True, "zero_vot": False, "merged_from": 2, "label_source": 'a"b'}
    d = spark.createDataFrame([row], schema.UNIT)
    K.write_units(d, str(tmp_path / "u"))
    back = R.read_units(spark, str(tmp_path / "u")).first().asDict()
    assert back == row


def test_report_is_partitioned(spark, tmp_path):
    d = spark.createDataFrame([("P1", "x", 1.0), ("P2", "y", 2.0)], "analysis string, quantity string, estimate double")
    K.write_report(d, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").glob("analysis=*")} == {"analysis=P1", "analysis=P2"}


def test_list_files(spark, tmp_path):
    for n in ("b/2.lab", "a/1.lab", "a/3.txt", "c/4.lab"):
        put(tmp_path / n, "x")
    got = [r.file_id for r in R.list_files(spark, str(tmp_path), "*.lab", limit=2).collect()]
    ids = spark.createDataFrame([("4",), ("9",)], "file_id string")
    assert got == ["1", "2"] and [r.file_id for r in R.list_files(spark, str(tmp_path), "*.lab", ids=ids).collect()] == ["4"]


def test_xml_of_one_recording_per_line(spark, tmp_path):
    line = "".join(x.strip() for x in XML.splitlines() if not x.startswith("<?xml"))
    one = R.read_xml_units(spark, put(tmp_path / "a.xml", XML)).count()
    assert R.read_xml_units(spark, put(tmp_path / "b.xml", f"{line}\n{line}\n"), multiline=False).count() == 2 * one > 0
