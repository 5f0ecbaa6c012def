"""Syllable arithmetic on Hangul code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: letters of a syllable in code order, first code point of the block
CHO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
JUNG = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
JONG = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, COUNT = 0xAC00, 11172
# fixed values: compound codas as coda, what stays, what moves; codas whose h is lost
COMPOUND = {"ㄳ": ("ㄱ", "ㅅ"), "ㄵ": ("ㄴ", "ㅈ"), "ㄺ": ("ㄹ", "ㄱ"), "ㄻ": ("ㄹ", "ㅁ"), "ㄼ": ("ㄹ", "ㅂ"), "ㄽ": ("ㄹ", "ㅅ"), "ㄾ": ("ㄹ", "ㅌ"), "ㄿ": ("ㄹ", "ㅍ"), "ㅄ": ("ㅂ", "ㅅ")}
H_LOST = {"ㄶ": "ㄴ", "ㅀ": "ㄹ"}
# fixed values: obstruent codas that become nasal, plain sounds that aspirate, codas that palatalise
NASAL_CODAS = ("ㄱ", "ㄲ", "ㅋ", "ㄳ", "ㄺ", "ㄷ", "ㅅ", "ㅆ", "ㅈ", "ㅊ", "ㅌ", "ㅎ", "ㅂ", "ㅍ", "ㄼ", "ㄿ", "ㅄ")
ASPIRATING = ("ㄱ", "ㄷ", "ㅂ", "ㅈ")
PALATAL_CODAS = ("ㄷ", "ㅌ")
# fixed values: plain to tense, plain to aspirated, vowel pairs that count as raising
TENSE = {"ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ", "ㅅ": "ㅆ", "ㅈ": "ㅉ"}
ASPIRATED = {"ㄱ": "ㅋ", "ㄷ": "ㅌ", "ㅂ": "ㅍ", "ㅈ": "ㅊ"}
RAISING = [("ㅗ", "ㅜ"), ("ㅓ", "ㅡ"), ("ㅐ", "ㅔ"), ("ㅏ", "ㅐ"), ("ㅕ", "ㅔ"), ("ㅑ", "ㅐ"), ("ㅗ", "ㅚ"), ("ㅜ", "ㅡ")]


def code(ch: Column) -> Column:
    """Index of a syllable in its block; null for anything else."""
    c = F.ascii(ch) - FIRST
    return F.when((c >= 0) & (c < COUNT), c)


def onset(c: Column) -> Column:
    return F.floor(c / 588).cast("int")


def nucleus(c: Column) -> Column:
    return F.floor((c % 588) / 28).cast("int")


def coda(c: Column) -> Column:
    return (c % 28).cast("int")


def letter(table: str, i: Column) -> Column:
    return F.trim(F.substring(F.lit(table), i + 1, F.lit(1)))


def compose(cho: Column, jung: Column, jong: Column) -> Column:
    """Syllable from the three indices (``chr`` stops at 255)."""
    cp = F.lit(FIRST) + (cho * 21 + jung) * 28 + jong
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 4, "0")), "UTF-16BE")


def _ids(table: str, letters: str | tuple[str, ...]) -> list[int]:
    return [table.index(x) for x in letters]


def resyllabify(left: Column, right: Column) -> Column:
    """T4: the coda of the left part moves into the empty onset of the right part; null if it cannot.

    Returns a struct (left, right).
    """
    stay, move = {}, {}
    for i, x in enumerate(JONG):
        if x != " " and x in CHO:
            stay[i], move[i] = 0, CHO.index(x)
    for a, (b, c) in COMPOUND.items():
        stay[JONG.index(a)], move[JONG.index(a)] = JONG.index(b), CHO.index(c)
    for a, b in H_LOST.items():
        stay[JONG.index(a)], move[JONG.index(a)] = 0, CHO.index(b)
    table = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    a, b = code(F.substring(left, -1, 1)), code(F.substring(right, 1, 1))
    new_left = F.concat(F.substring(left, F.lit(1), F.length(left) - 1), compose(onset(a), nucleus(a), table(stay)[coda(a)]))
    new_right = F.concat(compose(table(move)[coda(a)], nucleus(b), coda(b)), F.substring(right, F.lit(2), F.length(right)))
    ok = a.isNotNull() & b.isNotNull() & (coda(a) > 0) & (onset(b) == CHO.index("ㅇ")) & table(move)[coda(a)].isNotNull()
    return F.when(ok, F.struct(new_left.alias("left"), new_right.alias("right")))


def _change(a: Column, b: Column) -> Column:
    """Sound change that the border between two syllables invites; ordered, first rule wins."""
    j, c, v = coda(a), onset(b), nucleus(b)
    jong = lambda s: j.isin(_ids(JONG, s))
    cho = lambda s: c.isin(_ids(CHO, s))
    return (
        F.when(a.isNull() | b.isNull() | (j == 0) | jong("ㅆ"), F.lit(None))
        .when(jong(NASAL_CODAS) & cho("ㄴㅁ"), "nasalization_obstruent")
        .when(~jong("ㄴㄹ") & cho("ㄹ"), "nasalization_liquid")
        .when(jong(PALATAL_CODAS) & cho("ㅇ") & (v == JUNG.index("ㅣ")), "palatalization")
        .when((jong("ㅎ") & cho(ASPIRATING)) | (jong(ASPIRATING) & cho("ㅎ")), "aspiration")
        .when(jong(NASAL_CODAS) & cho("ㄱㄷㅂㅅㅈ"), "tensification")
        .when((jong("ㄴ") & cho("ㄹ")) | (jong("ㄹ") & cho("ㄴ")), "liquidization")
        .when(~jong("ㅇㄴㅁ") & cho("ㅇ"), "liaison")
    )


def find_environments(token: Column) -> Column:
    """T5: array of (i, change) for the borders after syllable i where a change can happen."""
    codes = F.transform(F.split(token, ""), code)
    pair = F.arrays_zip(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))).alias("a"), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))).alias("b"))
    sites = F.transform(pair, lambda p, i: F.struct(i.alias("i"), _change(p["a"], p["b"]).alias("change")))
    return F.filter(sites, lambda s: s["change"].isNotNull())


def classify_pair(a: Column, b: Column) -> Column:
    """What tells two spellings apart, one label or ``multiple:...``."""
    def labels(x, y):
        x, y = code(x), code(y)
        cx, cy, vx, vy, jx, jy = onset(x), onset(y), nucleus(x), nucleus(y), coda(x), coda(y)
        pairs = lambda t, s, p, q: F.struct(p, q).isin([F.struct(F.lit(t.index(m)), F.lit(t.index(n))) for m, n in s])
        empty = CHO.index("ㅇ")
        on = F.when(cx != cy, F.when(pairs(CHO, TENSE.items(), cx, cy), "tensification").when(pairs(CHO, ASPIRATED.items(), cx, cy), "aspiration")
                    .when((cx == empty) | (cy == empty), "onset_liaison").otherwise("onset_other"))
        vo = F.when(vx != vy, F.when(pairs(JUNG, RAISING, vx, vy), "vowel_raising").otherwise("vowel_other"))
        co = F.when(jx != jy, F.when(jy == 0, "coda_deletion").when(jx == 0, "coda_addition").otherwise("coda_change"))
        return F.array_compact(F.array(on, vo, co))

    found = F.array_distinct(F.flatten(F.zip_with(F.split(a, ""), F.split(b, ""), labels)))
    return (
        F.when(F.length(b) < F.length(a), "syllable_deletion").when(F.length(b) > F.length(a), "syllable_addition")
        .when(F.size(found) == 0, "identical").when(F.size(found) == 1, F.get(found, F.lit(0)))
        .otherwise(F.concat(F.lit("multiple:"), F.array_join(F.array_sort(found), "+")))
    )


def symbol_index(text: Column, k: Column) -> Column:
    """Number of symbols up to the end of syllable k; null past the end or outside the block."""
    codes = F.transform(F.split(text, ""), code)
    upto = F.slice(codes, F.lit(1), k + 1)
    n = F.aggregate(upto, F.lit(0), lambda acc, c: acc + 1 + F.when(onset(c) == CHO.index("ㅇ"), 0).otherwise(1) + F.when(coda(c) == 0, 0).otherwise(1))
    return F.when(F.size(codes) > k, n)
