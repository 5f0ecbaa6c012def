"""Comparison and rewriting of phone sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: phone to coarse class
CLASS_OF = {
    "p": "P", "pʰ": "P", "p͈": "P", "b": "P", "p̚": "P", "pʲ": "P", "pʷ": "P", "ɸʷ": "P", "βʷ": "P",
    "t": "T", "tʰ": "T", "t͈": "T", "d": "T", "t̚": "T", "tʷ": "T",
    "k": "K", "kʰ": "K", "k͈": "K", "ɡ": "K", "k̚": "K", "kʷ": "K", "kʷː": "K", "ɡʷ": "K", "c": "K", "cʰ": "K", "cʰː": "K", "c͈": "K", "ɟ": "K",
    "s": "S", "sʰ": "S", "s͈": "S", "sː": "S", "ɕʰ": "S", "ɕ͈": "S",
    "tɕ": "C", "tɕʰ": "C", "tɕ͈": "C", "tɕ͈ː": "C", "dʑ": "C", "tɕʷ": "C",
    "h": "H", "ç": "H", "ɦ": "H", "ʝ": "H",
    "m": "M", "mʲ": "M",
    "n": "N", "nː": "N", "ɲ": "N",
    "ŋ": "NG",
    "l": "L", "ɭ": "L", "ɭː": "L", "ɾ": "L", "ɾʲ": "L", "ʎ": "L", "ʎː": "L",
    "j": "G", "w": "G", "ɰ": "G",
    "i": "I", "iː": "I",
    "e": "E", "eː": "E", "ɛː": "E",
    "ɐ": "A",
    "o": "O", "oː": "O",
    "u": "U", "uː": "U",
    "ʌ": "V^", "ʌː": "V^",
    "ɨ": "U^",
}
# fixed values: consonant to the class kept by re-syllabification
KEPT_CLASS = {
    "k": "K", "ɡ": "K", "ɣ": "K", "k̚": "K", "c": "K", "ɟ": "K",
    "kʰ": "KH", "cʰ": "KH",
    "k͈": "KK",
    "t": "T", "d": "T", "t̚": "T",
    "tʰ": "TH",
    "t͈": "TT",
    "p": "P", "b": "P", "p̚": "P",
    "pʰ": "PH",
    "p͈": "PP",
    "s": "S", "sʰ": "S", "ɕʰ": "S",
    "s͈": "SS", "ɕ͈": "SS",
    "tɕ": "C", "dʑ": "C",
    "tɕʰ": "CH",
    "tɕ͈": "CC",
    "x": "H", "β": "H", "ɸ": "H", "h": "H", "ɦ": "H", "ç": "H", "ʝ": "H",
    "m": "M",
    "n": "N", "ɲ": "N",
    "ŋ": "NG",
    "ɾ": "R", "l": "R", "ɭ": "R", "ʎ": "R",
}
# fixed values: classes of sounds whose number must grow for a change to be there
GROWS = {
    "tensification": ["p͈", "t͈", "k͈", "s͈", "tɕ͈", "c͈", "ɕ͈"],
    "aspiration": ["pʰ", "tʰ", "kʰ", "tɕʰ", "cʰ"],
    "nasalization": ["m", "n", "ŋ", "ɲ"],
    "liquidization": ["ɭ", "ʎ", "l"],
    "palatalization": ["tɕ", "tɕʰ", "dʑ"],
}
# fixed values: pairs that differ by release or voicing only; obstruent classes
RELEASE = [("p̚", "b"), ("t̚", "d"), ("k̚", "ɡ"), ("t̚", "dʑ"), ("k̚", "ɟ"), ("p̚", "bʲ"), ("k̚", "ɡʷ"), ("p̚", "bʷ")]
OBSTRUENT = ["P", "T", "K", "S", "C"]
# fixed values: stop codas and voiced obstruents that cannot follow them
CODA_STOPS = ["k̚", "p̚", "t̚"]
VOICED = ["b", "bʲ", "bʷ", "d", "dʲ", "dʷ", "dʑ", "dʑʷ", "ɟ", "ɡ", "ɡʷ", "ɣ", "β", "βʷ", "ʝ"]
# fixed values: rewrites at a border
TO_TENSE = {"k": "k͈", "ɡ": "k͈", "ɣ": "k͈", "c": "k͈", "ɟ": "k͈", "t": "t͈", "d": "t͈", "p": "p͈", "b": "p͈", "β": "p͈", "s": "s͈", "sʰ": "s͈", "ɕʰ": "s͈", "tɕ": "tɕ͈", "dʑ": "tɕ͈"}
TO_ASPIRATE = {"k̚": "kʰ", "k": "kʰ", "ɡ": "kʰ", "t̚": "tʰ", "t": "tʰ", "d": "tʰ", "p̚": "pʰ", "p": "pʰ", "b": "pʰ", "tɕ": "tɕʰ", "dʑ": "tɕʰ"}
TO_NASAL = {"k̚": "ŋ", "k": "ŋ", "ɡ": "ŋ", "t̚": "n", "t": "n", "d": "n", "p̚": "m", "p": "m", "b": "m"}
TO_ONSET = {"k̚": "ɡ", "k": "ɡ", "t̚": "d", "t": "d", "p̚": "b", "p": "b", "ɭ": "ɾ", "s": "sʰ", "sʰ": "sʰ", "tɕ": "dʑ", "tɕʰ": "tɕʰ", "n": "n", "m": "m", "ŋ": "ŋ"}
TO_PALATAL = {"t̚": "dʑ", "t": "dʑ", "d": "dʑ", "tʰ": "tɕʰ"}
H_SOUNDS = ["h", "ɦ", "ç", "x", "ɸ", "β", "ʝ"]
GLIDES = ["j", "w", "ɥ", "ɰ"]
PALATAL_SOUNDS = ["ɾʲ", "ʎ", "ʎː", "ɲ", "ʝ"]
MODEL_PHONES = ["bʲ", "bʷ", "dʲ", "dʷ", "kʷ", "ɡʷ", "mʲ", "pʲ", "pʷ", "sʷ", "tʲ", "tʷ", "ɾʲ", "ɾʷ", "ɟ", "ɲ", "ʎ"]


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def classes_of(seq: Column) -> Column:
    """Coarse class of every phone, null for an unknown one."""
    m = _map(CLASS_OF)
    return F.transform(seq, lambda p: m[p])


def identity_safe(a: Column, b: Column) -> Column:
    """Both variants known and of one class sequence."""
    ca, cb = classes_of(a), classes_of(b)
    return F.coalesce((ca == cb) & ~F.exists(ca, lambda x: x.isNull()) & ~F.exists(cb, lambda x: x.isNull()), F.lit(False))


def contrast_kind(a: Column, b: Column) -> Column:
    """How two variants differ."""
    diff = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] != x["b"])
    x, y = F.get(diff, F.lit(0))["a"], F.get(diff, F.lit(0))["b"]
    m = _map(CLASS_OF)
    release = F.concat(x, F.lit(" "), y).isin([f"{p} {q}" for p, q in RELEASE] + [f"{q} {p}" for p, q in RELEASE])
    return (
        F.when(F.size(a) != F.size(b), "count_changes").when(F.size(diff) == 0, "none").when(F.size(diff) > 1, "several_places")
        .when(release, "release_voicing").when(m[x].isNull() | m[y].isNull(), "other")
        .when((m[x] == m[y]) & m[x].isin(OBSTRUENT), "laryngeal").otherwise("manner_place")
    )


def _bare(p: Column) -> Column:
    """Phone without length and secondary articulation."""
    return F.regexp_replace(F.regexp_replace(p, "ː", ""), "(?<=.)[ʲʷ]$", "")


def _weight(p: Column) -> Column:
    return F.when(p.contains("ː"), 2).otherwise(1)


def _count_in(seq: Column, sounds: list[str]) -> Column:
    return F.aggregate(seq, F.lit(0), lambda n, p: n + F.when(_bare(p).isin(sounds), _weight(p)).otherwise(0))


def liaison_valid(citation: Column, applied: Column) -> Column:
    """No class of consonant gets rarer (h may), and the forms differ."""
    m = _map(KEPT_CLASS)
    count = lambda seq, c: F.aggregate(seq, F.lit(0), lambda n, p: n + F.when(m[_bare(p)] == c, _weight(p)).otherwise(0))
    kept = F.lit(True)
    for c in dict.fromkeys(KEPT_CLASS.values()):
        if c != "H":
            kept = kept & (count(applied, c) >= count(citation, c))
    return kept & (citation != applied)


def variant_valid(change: Column, citation: Column, applied: Column) -> Column:
    """Does the applied form hold the declared change; counted, not just present."""
    grows = lambda k: _count_in(applied, GROWS[k]) > _count_in(citation, GROWS[k])
    gem = F.exists(applied, lambda p: p.isin("ʎː", "ɭː", "lː"))
    return (
        F.when(change == "tensification", grows("tensification")).when(change == "aspiration", grows("aspiration"))
        .when(change.startswith("nasalization"), grows("nasalization")).when(change == "liquidization", gem | grows("liquidization"))
        .when(change == "palatalization", grows("palatalization")).when(change.startswith("liaison"), liaison_valid(citation, applied))
        .otherwise(F.lit(True))
    )


def bigram_violations(seq: Column) -> Column:
    """Number of stop codas directly before a voiced obstruent."""
    n = F.greatest(F.size(seq) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(seq, F.lit(1), n).alias("a"), F.slice(seq, F.lit(2), n).alias("b"))
    return F.size(F.filter(pairs, lambda x: x["a"].isin(CODA_STOPS) & x["b"].isin(VOICED)))


def rewrite_at(change: Column, citation: Column, k: Column) -> Column:
    """The citation form with the change made at the border before symbol k.

    Where the rule does not apply the form stays as it is.
    """
    inside = (k > 0) & (k < F.size(citation))
    before, after = F.slice(citation, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(citation, k + 1, F.size(citation))
    rest = F.slice(citation, k + 2, F.size(citation))
    coda, onset = F.get(citation, k - 1), F.get(citation, k)
    put = lambda *x: F.concat(before, F.array(*x[:-1]), x[-1])

    nas = _map(TO_NASAL)
    soft = onset.isin(PALATAL_SOUNDS) | onset.endswith("ʲ")
    tense = _map(TO_TENSE)[onset]
    asp = _map(TO_ASPIRATE)
    merged = F.when(asp[coda].isNotNull() & onset.isin(H_SOUNDS), asp[coda]).when(coda.isin(H_SOUNDS) & asp[onset].isNotNull(), asp[onset])
    moved = _map(TO_ONSET)[coda]
    fused = F.when(onset == "j", F.when(moved == "ɡ", "ɟ").otherwise(F.concat(moved, F.lit("ʲ")))).when(onset.isin(GLIDES), F.concat(moved, F.lit("ʷ")))
    pal = _map(TO_PALATAL)[coda]
    first = k == 0
    made = (
        F.when(change.isin("nasalization", "nasalization_obstruent"), F.when(inside & nas[coda].isNotNull(), put(nas[coda], after)))
        .when(change == "nasalization_liquid", F.when(inside, put(F.coalesce(nas[coda], coda), F.when(soft, "ɲ").otherwise("n"), rest)))
        .when(change == "tensification", F.when((inside | (first & (F.size(citation) > 0))) & tense.isNotNull(),
                                               F.when(first, F.concat(F.array(tense), rest)).otherwise(put(coda, tense, rest))))
        .when(change == "liquidization", F.when(inside, put(F.when(soft, "ʎː").otherwise("ɭː"), rest)))
        .when(change == "aspiration", F.when(inside & merged.isNotNull(), put(merged, rest)))
        .when(change.startswith("liaison"), F.when(inside & moved.isNotNull(), F.when(fused.isin(MODEL_PHONES), put(fused, rest)).otherwise(put(moved, after))))
        .when(change == "palatalization", F.when(inside & pal.isNotNull(), put(pal, after)))
    )
    return F.coalesce(made, citation)


def length_diff(a: Column, b: Column) -> Column:
    """Difference of the numbers of symbols."""
    return F.size(b) - F.size(a)
