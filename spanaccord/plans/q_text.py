"""Queries for text, Hangul, phone sequence and lexicon operators."""

from pyspark.sql import functions as F

from spanaccord.functions import columns as C, hangul as H, phones as PH, text as TX
from spanaccord.operators import lexicon as L
from spanaccord.operators.scan import lead, scan
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import HANGUL, IPA, PHONES, UNITS, words
from spanaccord.plans.registry import query

W = words()
NAS = "(1,2,3,7,9,11,14,17,18,19,20,22,23,24,25,26,27)"
_cls = PH.CLASS_OF
CLS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _cls.items()) + "}"


@query("t01_clean_tokens", """SELECT word, CASE WHEN regexp_full_match(t, '[가-힣]+') THEN t END AS clean FROM (SELECT word, regexp_replace(trim(regexp_replace(regexp_replace(raw, '-([가-힣]+)-', '\\1', 'g'), '\\{[^}]*\\}|\\([^)]*\\)|&[^&]*&|[.,!?~''/]', '', 'g')), '^-+|-+$', '', 'g') AS t
  FROM (SELECT word, CASE k WHEN 0 THEN '-' || token || '-.' WHEN 1 THEN '(' || word || ')' || token || '?' ELSE token || '{x}&n&-' || word END AS raw FROM hw))""", ctes=[W, HANGUL])
def t01(spark, sf):
    raw = F.when(F.col("k") == 0, F.concat(F.lit("-"), "token", F.lit("-."))).when(F.col("k") == 1, F.concat(F.lit("("), "word", F.lit(")"), "token", F.lit("?")))
    raw = raw.otherwise(F.concat("token", F.lit("{x}&n&-"), "word"))
    return B.hangul_words(spark, sf).select("word", TX.clean_token(raw).alias("clean"))


@query("t01_strip_page_markup", """SELECT page_id, regexp_replace(html, '\\{[^}]*\\}|\\([^)]*\\)|&[^&]*&|[.,!?~''/]', '', 'g') AS text FROM pages""")
def t01b(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.regexp_replace("html", TX.MARKUP, "").alias("text"))


TAGGED = """CASE pos % 8 WHEN 0 THEN '(F ' || word || ')' WHEN 1 THEN '(A ' || word || ';X9)' WHEN 2 THEN '(? ' || word || ', other)' WHEN 3 THEN '(R ×××' || word || ')' WHEN 4 THEN '(M (A ' || word || ';Ｓ))' WHEN 5 THEN word || '<H>' WHEN 6 THEN '(L (? ' || word || ', (D b)) (笑 c))' ELSE '(' || word || ')' END"""
PLAIN = """CASE pos % 8 WHEN 3 THEN '' WHEN 6 THEN word || ' c' ELSE word END"""


@query("t02_strip_tags", f"""SELECT doc, string_agg({PLAIN}, ' ' ORDER BY pos) AS text, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT *, unnest(CASE pos % 8 WHEN 0 THEN ['F'] WHEN 1 THEN ['A'] WHEN 2 THEN ['?'] WHEN 3 THEN ['R'] WHEN 4 THEN ['M','A'] WHEN 6 THEN ['L','?','D','笑'] ELSE [''] END) AS t FROM words WHERE regexp_full_match(word, '[a-z]+')) GROUP BY 1""".replace(f"string_agg({PLAIN}, ' ' ORDER BY pos) AS text, ", "").replace("SELECT doc, string_agg(DISTINCT", "SELECT doc, (SELECT string_agg(" + PLAIN + ", ' ' ORDER BY pos) FROM words w2 WHERE w2.doc = q.doc AND regexp_full_match(w2.word, '[a-z]+')) AS text, string_agg(DISTINCT").replace("'[a-z]+')) GROUP BY 1", "'[a-z]+')) q GROUP BY q.doc").replace("string_agg(DISTINCT t, ',' ORDER BY t)", "coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (t <> ''), '')"), ctes=[words("benchmark", "item_id")])
def t02(spark, sf):
    w = B.words(spark, sf, "benchmark", "item_id").where(F.col("word").rlike("^[a-z]+$"))
    tagged = F.expr(TAGGED.replace("||", "||"))
    parts = F.array_sort(F.collect_list(F.struct("pos", tagged.alias("t"))))
    d = w.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("raw"))
    return d.select("doc", TX.strip_tags(F.col("raw")).alias("text"), F.array_join(TX.tags_seen(F.col("raw")), ",").alias("tags"))


@query("t03_hangul_parts", f"""SELECT word, 'ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ'[a // 588 + 1] AS cho, 'ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ'[(a % 588) // 28 + 1] AS jung, trim(' ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ'[a % 28 + 1]) AS jong, chr((44032 + a)::INT) AS again FROM syl WHERE i = 0""", ctes=[W, HANGUL])
def t03(spark, sf):
    c = H.code(F.substring("token", 1, 1))
    d = B.hangul_words(spark, sf).select("word", H.onset(c).alias("o"), H.nucleus(c).alias("n"), H.coda(c).alias("c"))
    return d.select("word", H.letter(H.CHO, F.col("o")).alias("cho"), H.letter(H.JUNG, F.col("n")).alias("jung"), H.letter(H.JONG, F.col("c")).alias("jong"), H.compose(F.col("o"), F.col("n"), F.col("c")).alias("again"))


_simple = {i: (0, H.CHO.index(x)) for i, x in enumerate(H.JONG) if x != " " and x in H.CHO}
_comp = {H.JONG.index(a): (H.JONG.index(b), H.CHO.index(c)) for a, (b, c) in H.COMPOUND.items()}
_hl = {H.JONG.index(a): (0, H.CHO.index(b)) for a, b in H.H_LOST.items()}
RESYL = "(VALUES " + ", ".join(f"({k},{s},{m})" for k, (s, m) in sorted({**_simple, **_comp, **_hl}.items())) + ") r(j, stay, move)"


@query("t04_resyllabify", f"""SELECT s.word, chr((44032 + a - a % 28 + stay)::INT) AS "left", chr((44032 + move * 588 + b % 588)::INT) AS "right" FROM (SELECT word, a, (b % 588) + 11 * 588 AS b FROM syl WHERE i = 0) s JOIN {RESYL} ON r.j = a % 28""", ctes=[W, HANGUL])
def t04(spark, sf):
    second = H.code(F.substring("token", 2, 1))
    empty = H.compose(F.lit(H.CHO.index("ㅇ")), H.nucleus(second), H.coda(second))
    d = B.hangul_words(spark, sf).select("word", H.resyllabify(F.substring("token", 1, 1), empty).alias("r"))
    return d.where("r is not null").select("word", "r.left", "r.right")


ENV = f"""CASE WHEN j = 0 OR j = 20 THEN NULL WHEN j IN {NAS} AND c IN (2, 6) THEN 'nasalization_obstruent' WHEN j NOT IN (4, 8) AND c = 5 THEN 'nasalization_liquid' WHEN j IN (7, 25) AND c = 11 AND v = 20 THEN 'palatalization'
  WHEN (j = 27 AND c IN (0, 3, 7, 12)) OR (j IN (1, 7, 17, 22) AND c = 18) THEN 'aspiration' WHEN j IN {NAS} AND c IN (0, 3, 7, 9, 12) THEN 'tensification' WHEN (j = 4 AND c = 5) OR (j = 8 AND c = 2) THEN 'liquidization' WHEN j NOT IN (21, 4, 16) AND c = 11 THEN 'liaison' END"""


@query("t05_find_environments", f"SELECT word, i, change FROM (SELECT word, i, {ENV} AS change FROM (SELECT word, i, a % 28 AS j, b // 588 AS c, (b % 588) // 28 AS v FROM syl WHERE b IS NOT NULL)) WHERE change IS NOT NULL", ctes=[W, HANGUL])
def t05(spark, sf):
    return B.hangul_words(spark, sf).select("word", F.explode(H.find_environments(F.col("token"))).alias("s")).select("word", "s.i", "s.change")


T6 = """CASE WHEN o // 588 <> a // 588 THEN CASE WHEN (a // 588, o // 588) IN ((0,1),(3,4),(7,8),(9,10),(12,13)) THEN 'tensification' WHEN (a // 588, o // 588) IN ((0,15),(3,16),(7,17),(12,14)) THEN 'aspiration' WHEN a // 588 = 11 OR o // 588 = 11 THEN 'onset_liaison' ELSE 'onset_other' END END"""
T6V = """CASE WHEN (o % 588) // 28 <> (a % 588) // 28 THEN CASE WHEN ((a % 588) // 28, (o % 588) // 28) IN ((8,13),(4,18),(1,5),(0,1),(6,5),(2,1),(8,11),(13,18)) THEN 'vowel_raising' ELSE 'vowel_other' END END"""
T6C = """CASE WHEN o % 28 <> a % 28 THEN CASE WHEN o % 28 = 0 THEN 'coda_deletion' WHEN a % 28 = 0 THEN 'coda_addition' ELSE 'coda_change' END END"""


@query("t06_classify_pair", f"""WITH l AS (SELECT word, list_distinct(list_filter(list_concat(list({T6}), list({T6V}), list({T6C})), lambda x: x IS NOT NULL)) AS l FROM syl GROUP BY 1)
  SELECT l.word, CASE WHEN hw.k = 0 THEN 'syllable_addition' WHEN len(l) = 0 THEN 'identical' WHEN len(l) = 1 THEN l[1] ELSE 'multiple:' || array_to_string(list_sort(l), '+') END AS label FROM l JOIN hw USING (word)""", ctes=[W, HANGUL])
def t06(spark, sf):
    d = B.hangul_words(spark, sf)
    other = F.when(F.col("k") == 0, F.concat("other", F.lit("가"))).otherwise(F.col("other"))
    return d.select("word", H.classify_pair(F.col("token"), other).alias("label"))


RELEASED = ", ".join(f"'{a} {b}', '{b} {a}'" for a, b in PH.RELEASE)


@query("t07_contrast_kind", f"""WITH d AS (SELECT word, citation, applied, CASE WHEN len(citation) = len(applied) THEN list_filter(list_zip(citation, applied), lambda z: z[1] <> z[2]) END AS d FROM ip),
  m AS (SELECT *, d[1][1] AS x, d[1][2] AS y, {CLS}[d[1][1]] AS cx, {CLS}[d[1][2]] AS cy FROM d)
  SELECT word, CASE WHEN d IS NULL THEN 'count_changes' WHEN len(d) = 0 THEN 'none' WHEN len(d) > 1 THEN 'several_places' WHEN (x || ' ' || y) IN ({RELEASED}) THEN 'release_voicing' WHEN cx IS NULL OR cy IS NULL THEN 'other' WHEN cx = cy AND cx IN ('P','T','K','S','C') THEN 'laryngeal' ELSE 'manner_place' END AS kind FROM m""", ctes=[W, IPA])
def t07(spark, sf):
    return B.ipa_pairs(spark, sf).select("word", PH.contrast_kind(F.col("citation"), F.col("applied")).alias("kind"))


_BARE = "regexp_replace(replace(p, 'ː', ''), '(.)[ʲʷ]$', '\\1')"
_kmap = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in PH.KEPT_CLASS.items()) + "}"


def _counted(c: str, hit: str) -> str:
    return f"coalesce(list_sum(list_transform({c}, lambda p: CASE WHEN {hit} THEN CASE WHEN p LIKE '%ː%' THEN 2 ELSE 1 END ELSE 0 END)), 0)"


def valid_sql(c: str, a: str) -> str:
    """Whether form ``a`` holds the change declared against form ``c``."""
    def grows(k):
        hit = f"{_BARE} IN ({', '.join(repr(x) for x in PH.GROWS[k])})"
        return f"{_counted(a, hit)} > {_counted(c, hit)}"

    kept = " AND ".join(f"{_counted(a, f'{_kmap}[{_BARE}] = {k!r}')} >= {_counted(c, f'{_kmap}[{_BARE}] = {k!r}')}" for k in dict.fromkeys(PH.KEPT_CLASS.values()) if k != "H")
    return f"""CASE change WHEN 'tensification' THEN {grows('tensification')} WHEN 'aspiration' THEN {grows('aspiration')} WHEN 'nasalization_obstruent' THEN {grows('nasalization')} WHEN 'nasalization_liquid' THEN {grows('nasalization')}
  WHEN 'liquidization' THEN list_has_any({a}, ['ʎː','ɭː','lː']) OR {grows('liquidization')} WHEN 'palatalization' THEN {grows('palatalization')} ELSE {kept} AND {c} <> {a} END"""


@query("t08_variant_valid", f"SELECT word, change, {valid_sql('citation', 'applied')} AS valid FROM ip", ctes=[W, IPA])
def t08(spark, sf):
    v = PH.variant_valid(F.col("change"), F.col("citation"), F.col("applied"))
    return B.ipa_pairs(spark, sf).select("word", "change", v.alias("valid"))


BAD = "len(list_filter(range(1, len({c})), lambda i: {c}[i] IN ('k̚','p̚','t̚') AND {c}[i + 1] IN ('b','d','dʑ','ɡ'))) > 0"


@query("t09_bigram_report", f"""WITH v AS (SELECT *, {BAD.format(c='citation')} AS v, {BAD.format(c='applied')} AS s FROM ip)
  SELECT change, count(*) AS n, count(*) FILTER (v) AS citation_bad, count(*) FILTER (s) AS applied_bad, avg(v::INT) AS citation_rate, avg(decided) FILTER (v) - avg(decided) FILTER (NOT v) AS effect FROM v GROUP BY 1""", "citation_rate effect", [W, IPA])
def t09(spark, sf):
    return L.bigram_report(B.ipa_pairs(spark, sf), "change", "decided")


def _look(table: dict, key: str) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + f"}}[{key}]"


def _in(key: str, values) -> str:
    return f"{key} IN ({', '.join(repr(x) for x in values)})"


@query("t10_synthesise", f"""WITH k AS (SELECT *, border > 0 AS inside, citation[border] AS coda, citation[border + 1] AS onset, citation[1:border - 1] AS bef, citation[border + 1:] AS aft, citation[border + 2:] AS rest, {valid_sql('citation', 'applied')} AS ok FROM ip),
  m AS (SELECT *, {_look(PH.TO_NASAL, 'coda')} AS nasal, {_look(PH.TO_TENSE, 'onset')} AS tense, {_look(PH.TO_ONSET, 'coda')} AS moved, {_look(PH.TO_PALATAL, 'coda')} AS palatal, {_in('onset', PH.PALATAL_SOUNDS)} OR onset LIKE '%ʲ' AS soft,
    CASE WHEN {_in('onset', PH.H_SOUNDS)} AND {_look(PH.TO_ASPIRATE, 'coda')} IS NOT NULL THEN {_look(PH.TO_ASPIRATE, 'coda')} WHEN {_in('coda', PH.H_SOUNDS)} THEN {_look(PH.TO_ASPIRATE, 'onset')} END AS merged FROM k),
  f AS (SELECT *, CASE WHEN onset = 'j' THEN CASE WHEN moved = 'ɡ' THEN 'ɟ' ELSE moved || 'ʲ' END WHEN {_in('onset', PH.GLIDES)} THEN moved || 'ʷ' END AS fused FROM m),
  made AS (SELECT *, CASE WHEN ok THEN applied WHEN change = 'nasalization_obstruent' AND inside AND nasal IS NOT NULL THEN bef || [nasal] || aft WHEN change = 'nasalization_liquid' AND inside THEN bef || [coalesce(nasal, coda), CASE WHEN soft THEN 'ɲ' ELSE 'n' END] || rest
    WHEN change = 'tensification' AND tense IS NOT NULL THEN CASE WHEN inside THEN bef || [coda, tense] || rest ELSE [tense] || rest END WHEN change = 'liquidization' AND inside THEN bef || [CASE WHEN soft THEN 'ʎː' ELSE 'ɭː' END] || rest
    WHEN change = 'aspiration' AND inside AND merged IS NOT NULL THEN bef || [merged] || rest WHEN change = 'liaison' AND inside AND moved IS NOT NULL THEN CASE WHEN {_in('fused', PH.MODEL_PHONES)} THEN bef || [fused] || rest ELSE bef || [moved] || aft END
    WHEN change = 'palatalization' AND inside AND palatal IS NOT NULL THEN bef || [palatal] || aft ELSE citation END AS form FROM f)
  SELECT word, change, array_to_string(form, ' ') AS form, CASE WHEN ok THEN 'given' WHEN {valid_sql('citation', 'form')} THEN 'rewritten' ELSE 'still_invalid' END AS note FROM made""", ctes=[W, IPA])
def t10(spark, sf):
    d = L.synthesise(B.ipa_pairs(spark, sf))
    return d.select("word", "change", F.array_join("form", " ").alias("form"), "note")


_fold = "sym"
for _v in L.SHORT_VOWELS:
    _fold = f"replace({_fold}, '{_v} {_v}', '{_v}ː')"
_kana = " OR ".join(f"regexp_matches(surf, '[{v}][{v[0]}{v[len(v) // 2]}]')" for v in L.KANA_ROWS.values())
_KEEP = "('compound_mark', 'letter_spelling', 'particle_phrase')"


@query("t11_doubled_vowel_verdict", f"""WITH l AS (SELECT DISTINCT lower(word) AS word FROM words),
  s AS (SELECT CASE WHEN length(word) % 5 = 0 THEN translate(word, 'aeiou', 'あえいおう') WHEN length(word) % 5 = 1 THEN word || '・' ELSE translate(word, 'aeioust', 'ああいおうのさ') END AS surf,
    array_to_string(list_transform(string_split(CASE WHEN length(word) % 3 = 0 THEN replace(word, 'oo', 'o:') ELSE word END, ''), lambda x: CASE WHEN x = ':' THEN 'ː' ELSE x END), ' ') AS sym FROM l),
  d AS (SELECT *, {_fold} IN (SELECT sym FROM s) AS known, len(regexp_extract_all(surf, '[A-Za-zＡ-Ｚａ-ｚ0-9０-９]')) AS latin FROM s WHERE {_fold} <> sym),
  v AS (SELECT surf AS word, sym AS symbols, CASE WHEN contains(surf, '・') THEN 'compound_mark' WHEN latin >= 2 AND latin / length(surf) >= 0.6::DOUBLE THEN 'letter_spelling' WHEN regexp_matches(surf, '[{L.PARTICLES}]') THEN 'particle_phrase'
    WHEN known THEN 'cross_reference' WHEN contains(surf, 'ー') OR {_kana} THEN 'doubled_kana' ELSE 'uncertain' END AS signal FROM d)
  SELECT *, CASE WHEN signal IN {_KEEP} THEN 'keep' WHEN signal = 'uncertain' THEN 'uncertain' ELSE 'merge' END AS verdict FROM v""", ctes=[W])
def t11(spark, sf):
    w = B.distinct_words(spark, sf)
    # a spelling in kana or letters, and a pronunciation in which doubled letters may already be folded
    sym = F.split(F.regexp_replace("word", "oo", "o:"), "")
    sym = F.transform(F.when(F.length("word") % 3 == 0, sym).otherwise(F.split("word", "")), lambda x: F.when(x == ":", "ː").otherwise(x))
    surf = F.when(F.length("word") % 5 == 0, F.translate("word", "aeiou", "あえいおう")).when(F.length("word") % 5 == 1, F.concat("word", F.lit("・"))).otherwise(F.translate("word", "aeioust", "ああいおうのさ"))
    v = L.doubled_vowel_verdict(w.select(surf.alias("word"), sym.alias("symbols")))
    return v.select("word", F.array_join("symbols", " ").alias("symbols"), "signal", "verdict")


@query("t12_symbol_index", """SELECT hw.word, CASE WHEN length(token) > k THEN (SELECT sum(1 + (a // 588 <> 11)::INT + (a % 28 <> 0)::INT)::BIGINT FROM syl WHERE syl.word = hw.word AND i <= hw.k) END AS n FROM hw""", ctes=[W, HANGUL])
def t12(spark, sf):
    return B.hangul_words(spark, sf).select("word", H.symbol_index(F.col("token"), F.col("k")).alias("n"))


@query("t13_pseudonym", "SELECT c_custkey, substr(sha1('salt-1' || c_name), 1, 12) AS word_id FROM customer")
def t13(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", C.pseudonym(F.col("c_name"), "salt-1").alias("word_id"))


@query("t14_nasal_context", """SELECT ctx, count(*) AS n FROM (SELECT sym, CASE WHEN nx IS NULL THEN 'final_or_pause' WHEN nx IN ('N','m','n') THEN 'nasal_fused' WHEN nx IN ('a','i','H') THEN 'vowel_or_fricative' ELSE 'stop_or_affricate' END AS ctx FROM (SELECT *, lead(sym) OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id) AS nx FROM ph)) WHERE sym = 'N' GROUP BY 1""", ctes=[UNITS, PHONES])
def t14(spark, sf):
    p = scan(B.phones(spark, sf), ["file_id", "ipu_id"], ["t_start", "unit_id"], {"nx": lead("sym")})
    return p.where("sym = 'N'").groupBy(TX.nasal_context(F.col("nx")).alias("ctx")).agg(F.count("*").alias("n"))


@query("t15_identity_safe", f"""SELECT word, coalesce(list_transform(citation, lambda p: {CLS}[p]) = list_transform(applied, lambda p: {CLS}[p]) AND len(list_filter(list_concat(citation, applied), lambda p: {CLS}[p] IS NULL)) = 0, false) AS safe FROM ip""", ctes=[W, IPA])
def t15(spark, sf):
    return B.ipa_pairs(spark, sf).select("word", PH.identity_safe(F.col("citation"), F.col("applied")).alias("safe"))


@query("t16_two_way_lexicon", """WITH pr AS (SELECT token AS w, min(word[1:3]) AS p FROM hw WHERE k < 2 GROUP BY 1), pairs AS (SELECT DISTINCT token AS form, other AS orig FROM hw)
  SELECT form, orig, a.p AS pron_form, b.p AS pron_orig, CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'missing' WHEN a.p = b.p THEN 'equal' ELSE '' END AS why, a.p IS NOT NULL AND b.p IS NOT NULL AND a.p <> b.p AS decidable FROM pairs LEFT JOIN pr a ON a.w = form LEFT JOIN pr b ON b.w = orig""", ctes=[W, HANGUL])
def t16(spark, sf):
    h = B.hangul_words(spark, sf)
    prons = h.where("k < 2").groupBy(F.col("token").alias("word")).agg(F.min(F.substring("word", 1, 3)).alias("pron"))
    return L.two_way_lexicon(h.select(F.col("token").alias("form"), F.col("other").alias("orig")), prons)


@query("t17_parts_needed", "SELECT DISTINCT unnest([token[1:k + 1], token[k + 2:], token]) AS part FROM hw".replace("SELECT DISTINCT unnest", "SELECT DISTINCT part FROM (SELECT unnest").replace("AS part FROM hw", "AS part FROM hw) WHERE part <> ''"), ctes=[W, HANGUL])
def t17(spark, sf):
    return L.parts_needed(B.hangul_words(spark, sf), "token", "k")


@query("t18_length_diff", "SELECT change, len(applied) - len(citation) AS diff, count(*) AS n FROM ip GROUP BY 1, 2", ctes=[W, IPA])
def t18(spark, sf):
    return B.ipa_pairs(spark, sf).groupBy("change", PH.length_diff(F.col("citation"), F.col("applied")).alias("diff")).agg(F.count("*").alias("n"))
