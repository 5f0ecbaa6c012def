"""Schemas of the tables that cross a file."""

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(text: str) -> T.StructType:
    kinds = {"s": _S, "d": _D, "i": _I, "b": _B}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


#: one labelled interval
UNIT = _struct(
    "file_id:s speaker_id:s corpus:s style:s metric_type:s ipu_id:s ipu_start:d ipu_end:d unit_id:s t_start:d t_end:d "
    "label_canonical:s label_source:s phone_class:s boundary_source_start:s boundary_source_end:s merged_from:i burst_t:d "
    "devoiced:b tag_vlong:b tag_clong:b zero_vot:b following_context:s accent_type:i is_accent_nucleus:b word:s word_phone_index:i excluded_reason:s"
)
#: boundary inside a merged unit
INNER = _struct("file_id:s unit_id:s t:d source:s position:i note:s")
#: one row of an alignment
ALIGNMENT = T.StructType([
    T.StructField("file_id", _S), T.StructField("ref_unit_id", _S), T.StructField("hyp_unit_ids", T.ArrayType(_S)),
    *_struct("ref_label_source:s ref_label_canonical:s").fields, T.StructField("hyp_labels", T.ArrayType(_S)),
    *_struct("phone_class:s error_type:s onset_error_ms:d offset_error_ms:d n_hyp_units:i metric_type:s").fields,
])


def _nest(**kids) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kids.items()])


def _many(t) -> T.ArrayType:
    return T.ArrayType(t)


_PHONE = _struct("_PhoneStartTime:d _PhoneEndTime:d _PhoneEntity:s _PhoneClass:s _Devoiced:s _StartTimeUncertain:s _EndTimeUncertain:s")
_MORA = _nest(_TagVLong=_S, _TagCLong=_S, _PerceivedAcc=_S, Phone=_many(_PHONE), Phoneme=_many(_nest(Phone=_many(_PHONE))))
_TRANS = _nest(_TagMaskStart=_S, _TagMaskMidst=_S, _TagMaskEnd=_S, Mora=_many(_MORA))
_SUW = _nest(
    _PlainOrthographicTranscription=_S, Mora=_many(_MORA), TransSUW=_many(_TRANS), XJToBILabelWord=_many(_nest(_PerceivedAccPos=_S)),
)
_IPU = _nest(_IPUID=_S, _IPUStartTime=_D, _IPUEndTime=_D, SUW=_many(_SUW), LUW=_many(_nest(SUW=_many(_SUW))))
#: hierarchical annotation of one recording
TALK = _nest(_TalkID=_S, _SpeakerID=_S, IPU=_many(_IPU))

#: nested corpus of utterances
CORPUS = _nest(document=_many(_nest(id=_S, utterance=_many(_struct("id:s form:s original_form:s speaker_id:s")))))
