"""The views of ``bindings`` stated in SQL."""

from spanaccord.plans.bindings import CLASSES, EPOCH_US, LABEL_MAP, WINDOW_GAP_S

_cls = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())
MAP = "lm AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i},'{a}','{b}','{c}')" for i, (a, b, c) in enumerate(LABEL_MAP)
) + ") v(ord, source_label, machine_label, category))"

UNITS = f"""
ev AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'S' END || user_id AS file_id,
  'p' || (user_id % 40) AS speaker_id, event_type AS label, value, epoch_us(ts) - {EPOCH_US} AS us FROM events),
ev1 AS (SELECT *, lead(us) OVER w AS us_next, lag(us) OVER w AS us_prev FROM ev WINDOW w AS (PARTITION BY file_id ORDER BY us, event_id)),
ev2 AS (SELECT *, sum(CASE WHEN us_prev IS NULL OR (us - us_prev)/1e6 > {WINDOW_GAP_S} THEN 1 ELSE 0 END)
  OVER (PARTITION BY file_id ORDER BY us, event_id) AS ipu_no FROM ev1 WHERE us_next IS NOT NULL),
ref AS (SELECT file_id, speaker_id, 'w' || ipu_no::BIGINT AS ipu_id, event_id, 'u' || event_id AS unit_id, us/1e6 AS t_start, us_next/1e6 AS t_end,
  label, value, CASE label {_cls} END AS phone_class,
  CASE WHEN event_id % 31 = 0 THEN 'derived' WHEN event_id % 37 = 0 THEN 'undeterminable' ELSE 'measured' END AS boundary_source_start,
  CASE WHEN event_id % 47 = 0 THEN 'derived' ELSE 'measured' END AS boundary_source_end,
  CASE WHEN event_id % 41 = 0 THEN 'unmapped_label' WHEN event_id % 43 = 0 THEN 'zero_duration' END AS excluded_reason,
  event_id % 3 + 1 AS merged_from, event_id % 5 = 0 AS devoiced, event_id % 7 = 0 AS tag_vlong, event_id % 9 = 0 AS tag_clong,
  event_id % 6 = 0 AS is_accent_nucleus, CASE WHEN event_id % 4 <> 3 THEN event_id % 4 END AS accent_type FROM ev2)"""

HYP = """
hyp AS (SELECT file_id, event_id, 'h' || event_id AS unit_id,
  t_start + (event_id % 11 - 5) * 0.0073::DOUBLE + (CASE WHEN event_id % 19 = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END) AS t_start,
  t_end + (event_id % 13 - 6) * 0.0089::DOUBLE + (CASE WHEN event_id % 19 = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END) AS t_end,
  CASE WHEN event_id % 23 = 0 THEN 'error' WHEN event_id % 2 = 0 AND label = 'view' THEN 'look' ELSE label END AS label, phone_class
  FROM ref WHERE event_id % 17 <> 0
  UNION ALL SELECT file_id, event_id, 'x' || event_id, t_start + 1.0::DOUBLE, t_start + 1.5::DOUBLE, 'tap', phone_class FROM ref WHERE event_id % 29 = 0)"""

ALN = """
aln AS (SELECT file_id, speaker_id, ipu_id, event_id, unit_id AS ref_unit_id,
  CASE WHEN event_id % 17 = 0 THEN []::VARCHAR[] WHEN event_id % 13 = 0 THEN ['h' || event_id, 'x' || event_id] ELSE ['h' || event_id] END AS hyp_unit_ids,
  label, phone_class, t_start, t_end, value, devoiced, tag_vlong, tag_clong, accent_type, is_accent_nucleus,
  CASE WHEN event_id % 17 = 0 THEN 'omission' WHEN event_id % 23 = 0 AND event_id % 13 <> 0 THEN 'substitution' ELSE 'displacement' END AS error_type,
  CASE WHEN event_id % 17 <> 0 THEN (event_id % 11 - 5) * 7.3::DOUBLE + value % 1.0::DOUBLE END AS onset_error_ms,
  CASE WHEN event_id % 17 <> 0 THEN (event_id % 13 - 6) * 8.9::DOUBLE - value % 1.0::DOUBLE END AS offset_error_ms,
  CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS n_hyp_units
  FROM ref WHERE excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured'
  UNION ALL SELECT file_id, speaker_id, ipu_id, event_id, NULL, ['x' || event_id], 'tap', phone_class, t_start, t_end, value, devoiced, tag_vlong, tag_clong,
  accent_type, is_accent_nucleus, 'insertion', NULL, NULL, 1 FROM ref WHERE event_id % 29 = 0)"""

DEC = """
dec0 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cand_id, l_returnflag AS process, 's' || l_suppkey AS speaker,
  'w' || (l_partkey % 97) AS word_type, l_orderkey AS utterance_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS human,
  (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 10 AS mix, l_extendedprice / 1000.0::DOUBLE AS dev_word_ms,
  CASE WHEN l_linenumber <> 7 THEN l_quantity + l_discount END AS dev_site_ms, CASE WHEN l_partkey % 3 <> 0 THEN 1 ELSE 0 END AS identity_safe FROM lineitem),
dcs AS (SELECT *, CASE WHEN mix < 3 THEN 1 - human ELSE human END AS aligner, CASE WHEN mix < 3 THEN 0 ELSE 1 END AS correct FROM dec0)"""

PAIRED = """
paired AS (SELECT l_returnflag AS vowel, l_linestatus AS length_class, 's' || l_suppkey AS speaker_id,
  't' || (l_suppkey % 50) || '_' || (l_partkey % 4) AS file_id, l_linenumber % 2 = 0 AS is_accent_nucleus,
  CASE WHEN l_linenumber > 4 THEN 'stop' ELSE 'nasal' END AS following_context, l_quantity AS dur_hand_ms,
  l_quantity * (1.0::DOUBLE - l_discount) + l_tax * 10 AS dur_mfa_ms FROM lineitem)"""


def words(name="documents", key="doc_id"):
    return f"""
words AS (SELECT doc, pos - 1 AS pos, word FROM (SELECT {key} AS doc, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT {key}, regexp_split_to_array(text, '\\s+') AS w FROM {name})) WHERE word <> '')"""


PHONES = """
ph AS (SELECT *, sym IN ('a','i','H') AS is_vowel FROM (SELECT file_id, ipu_id, event_id, unit_id, t_start, t_end, devoiced, tag_vlong, accent_type,
  (['Q','SclS','t','a','H','N','m','i','k','SclS'])[((event_id * 3 + event_id // 5) % 10 + 1)::INT] AS sym, event_id % 3 = 0 AS start_uncertain, event_id % 4 = 0 AS end_uncertain FROM ref))"""
RUNS = """
mr AS (SELECT *, lag(sym) OVER w AS p, lag(is_vowel) OVER w AS pv,
  last_value(CASE WHEN sym <> 'SclS' THEN sym END IGNORE NULLS) OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
  FROM ph WINDOW w AS (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id)),
runs AS (SELECT *, sum(CASE WHEN coalesce((sym = 'H' AND pv) OR (p = 'Q' AND sym = 'SclS') OR (p = 'SclS' AND h = 'Q') OR (p = 'N' AND sym IN ('m','n','ny','my')) OR (devoiced AND is_vowel AND NOT pv), false) THEN 0 ELSE 1 END)
  OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id)::BIGINT AS run FROM mr)"""


def h32(expr):
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def _syl(tag, n):
    return f"chr((44032 + {h32(chr(39).join(['word || ', '|' + tag, '']))} % {n})::INT)"


HANGUL = f"""
hw AS (SELECT word, {_syl('a', 11172)} || {_syl('b', 11172)} || CASE WHEN {h32("word || '|d'")} % 4 = 0 THEN '' ELSE {_syl('c', 11172)} END AS token,
  {_syl('a', 11172)} || CASE WHEN {h32("word || '|e'")} % 3 = 0 THEN {_syl('f', 588)} ELSE {_syl('b', 11172)} END || CASE WHEN {h32("word || '|d'")} % 4 = 0 THEN '' ELSE {_syl('c', 11172)} END AS other,
  {h32("word || '|k'")} % 3 AS k FROM (SELECT DISTINCT lower(word) AS word FROM words)),
syl AS (SELECT word, i - 1 AS i, unicode(a) - 44032 AS a, CASE WHEN b <> '' THEN unicode(b) - 44032 END AS b, unicode(o) - 44032 AS o FROM (SELECT word, i, token[i] AS a, token[i + 1] AS b, other[i] AS o FROM (SELECT *, unnest(range(1, length(token) + 1)) AS i FROM hw)))"""

from spanaccord.plans.bindings import CHANGES, IPA_LIST  # noqa: E402

_ipa = "[" + ",".join(f"'{x}'" for x in IPA_LIST) + "]"
_n = len(IPA_LIST)
IPA = f"""
ip0 AS (SELECT word, list_transform(range(0, length(word)), lambda i: {_ipa}[{h32("word || '|' || i")} % {_n} + 1]) AS citation, {h32("word || '|p'")} % length(word) AS border, {_ipa}[{h32("word || '|q'")} % {_n} + 1] AS q,
  {h32("word || '|d'")} % 5 = 0 AS cutoff, [{','.join(f"'{c}'" for c in CHANGES)}][{h32("word || '|t'")} % {len(CHANGES)} + 1] AS change, {h32("word || '|y'")} % 2 AS decided
  FROM (SELECT DISTINCT lower(word) AS word FROM words)),
ip1 AS (SELECT *, list_transform(range(0, len(citation)), lambda i: CASE WHEN i = border THEN q WHEN i = 0 AND {h32("word || '|d'")} % 5 = 1 THEN {_ipa}[{h32("word || '|r'")} % {_n} + 1] ELSE citation[i + 1] END) AS full_ FROM ip0),
ip AS (SELECT *, CASE WHEN cutoff THEN full_[1:len(full_) - 1] ELSE full_ END AS applied FROM ip1)"""
