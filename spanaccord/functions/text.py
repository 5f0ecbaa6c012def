"""Text operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: markup of transcribed words, and a fragment between hyphens
MARKUP = r"\{[^}]*\}|\([^)]*\)|&[^&]*&|[.,!?~'/]"
FRAGMENT = r"-([가-힣]+)-"
# fixed values: tag names of the transcription scheme
RANGE_TAG = r"D2|[FD?MORXAKWB]|笑|泣|咳|L"
SYMBOL_TAG = r"<(FV|VN|H|Q|笑|咳|息|P(:[0-9.\-]+)?)>"


def clean_token(tok: Column) -> Column:
    """Token without markup; null unless it is all Hangul."""
    t = F.regexp_replace(tok, FRAGMENT, "$1")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, MARKUP, "")), r"^-+|-+$", "")
    return F.when(t.rlike("^[가-힣]+$"), t)


def strip_tags(text: Column) -> Column:
    """Text without tags, innermost tags first, however deeply they are nested.

    Left of ``;`` for readings, first of several guesses, nothing for masked
    spans, the content of all others.
    """
    plain = F.regexp_replace(text, SYMBOL_TAG, "")

    def innermost(t: Column, _: Column) -> Column:
        t = F.regexp_replace(t, r"\([AKWB](?=[\s×])\s*([^();]*);[^()]*\)", "$1")
        t = F.regexp_replace(t, r"\(\?(?=[\s×)])\s*([^(),，、]*)(?:[,，、][^()]*)?\)", "$1")
        t = F.regexp_replace(t, r"\(R(?=[\s×)])[^()]*\)", "")
        t = F.regexp_replace(t, r"\((?:" + RANGE_TAG + r")(?=[\s×)])\s*([^()]*)\)", "$1")
        return F.regexp_replace(t, r"\((?!(?:" + RANGE_TAG + r")(?:[\s×)]))([^()]*)\)", "$1")

    # every pass takes at least one pair of brackets away, so as many passes as opening brackets do
    done = F.aggregate(F.split(plain, r"\("), plain, innermost)
    # an opening bracket without its partner keeps the rest as it is; stray closing ones go
    return F.when(done.contains("("), done).otherwise(F.regexp_replace(done, r"\)", ""))


def tags_seen(text: Column) -> Column:
    """Distinct tag names in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\((" + RANGE_TAG + r")(?=[\s×)])"), F.lit(1))))


def nasal_context(following: Column) -> Column:
    """Stratum of a moraic nasal by the phone that follows."""
    # fixed values: phones of the strata
    nasal = ["N", "m", "n", "nj", "ny", "my"]
    open_ = ["a", "i", "u", "e", "o", "A", "I", "U", "E", "O", "H", "s", "sj", "sy", "h", "hj", "hy", "F", "z", "zj", "zy"]
    return (
        F.when(following.isNull(), "final_or_pause").when(following.isin(nasal), "nasal_fused")
        .when(following.isin(open_), "vowel_or_fricative").otherwise("stop_or_affricate")
    )


def split_at(word: Column, k: Column) -> Column:
    """The word up to and including character k, and the rest."""
    return F.struct(F.substring(word, F.lit(1), k + 1).alias("left"), F.substring(word, k + 2, F.length(word)).alias("right"))
