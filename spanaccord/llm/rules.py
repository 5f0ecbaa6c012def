"""Operator 11: quality rules, a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanaccord.llm.common import text_of

#: characters between words: blank and tab to carriage return (fixed values)
BLANKS = r"[\x20\x09-\x0D]+"
#: signs that count as symbols (fixed values)
SYMBOLS = "#*$%&|<>"
#: a word with two capital letters or more and no small one
CAPITALS = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
#: frequent function words of four languages; a parameter of ``verdicts``
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "a", "in", "that", "have", "with", "is", "for", "on", "as", "was", "by", "this", "are", "at", "it"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "ist", "nicht", "mit", "von", "ein", "eine", "sich", "auf", "für", "des", "dem", "im", "es"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "lo"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
}


@dataclass(frozen=True)
class Rule:
    """``least`` <= 1000 * count / per <= ``most``; without ``per`` the bounds hold for the count itself."""

    name: str
    count: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


#: the table of thresholds; shares are in thousandths, so that every comparison is one of whole numbers
RULES = (
    Rule("words", "n_words", least=50, most=100_000),
    Rule("repeated_words", "n_repeat_words", "n_words", most=500),
    Rule("mean_word_length", "word_chars", "n_words", least=2_500, most=12_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("letter_words", "n_letter_words", "n_words", least=700),
    Rule("capital_words", "n_capital_words", "n_words", most=500),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("open_lines", "n_open_lines", "n_lines", most=300),
)
#: the rules whose failure is reported apart
BASE = ("words_least", "repeated_words_most")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in a window of ``n`` words found twice or more, the first included.

    The windows are sorted with their places, so that equal ones are neighbours; the places of repeated ones,
    sorted again, cover min(n, distance to the next) words each.  Texts whose windows all differ skip that.
    """
    def placed(s: Column) -> Column:
        twice = lambda x, j: F.when((x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]), x["i"])
        covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(F.sort_array(F.filter(F.transform(s, twice), lambda x: x.isNotNull())), covered)

    def counted(g: Column) -> Column:
        once = let(F.sort_array(g), lambda s: ~F.exists(F.transform(s, lambda x, j: x == F.get(s, j + 1)), lambda x: x))
        return F.when(F.coalesce(once, F.lit(True)), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), placed))

    # words hold no blank, so a blank between them keeps different windows apart
    window = lambda x, i: F.concat(x, *[y for k in range(1, n) for y in (F.lit(" "), F.get(words, i + k))])
    return F.when(F.size(words) <= n, F.lit(0).cast("long")).otherwise(let(F.transform(F.slice(words, F.lit(1), F.size(words) - (n - 1)), window), counted))


def measures(text: Column, stop_words: list[str]) -> Column:
    """One struct of whole numbers: everything a rule can name."""
    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            count_where(w, lambda x: F.lower(x).isin(stop_words)).alias("n_stop_words"),
            count_where(w, lambda x: x.rlike(r"\p{L}")).alias("n_letter_words"),
            # two capital letters or more and no small one
            count_where(w, lambda x: x.rlike(CAPITALS)).alias("n_capital_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            count_where(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
            count_where(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_open_lines"),
        )

    return F.struct(
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(F.filter(F.split(text, BLANKS, -1), lambda x: x != ""), of_words).alias("w"),
        let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
    )


def compile_rules(rules: tuple[Rule, ...], value: Callable[[str], Column]) -> dict[str, Column]:
    """Name of a bound to the condition that it is broken; a share of nothing breaks no bound."""
    broken = {}
    for r in rules:
        share, whole = (value(r.count), F.lit(1)) if r.per is None else (value(r.count) * 1000, value(r.per))
        if r.least is not None:
            broken[f"{r.name}_least"] = share < r.least * whole
        if r.most is not None:
            broken[f"{r.name}_most"] = share > r.most * whole
    return broken


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS, base: tuple[str, ...] = BASE) -> DataFrame:
    """All measures of every document, the bounds it breaks and whether it is kept.

    ``docs`` has doc_id and text.  Every row gives one row, repeated ones and those with a null doc_id too.  A
    null text is read as empty and has no word; texts of any length are measured whole.  ``base_failed`` is
    the failure of a bound named in ``base``, ``failed`` lists all broken bounds in the order of the table.
    Other columns are not read.  The plan is a scan and projections: no shuffle, no user function.
    """
    flat = lambda m: F.col("m")[m] if m == "n_symbols" else F.col("m")["l" if m.endswith("lines") else "w"][m]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_capital_words", "n_lines", "n_bullet_lines", "n_open_lines"]
    listed = sorted({w for ws in stop_words.values() for w in ws})
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(text_of(), listed).alias("m")).select("doc_id", *[flat(n).alias(n) for n in names])
    broken = compile_rules(rules, F.col)
    either = lambda cs: F.array_contains(F.array(*cs), True) if cs else F.lit(False)
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    return got.select("*", either([broken[b] for b in base if b in broken]).alias("base_failed"), F.array_join(failed, ",").alias("failed"), (~either(list(broken.values()))).alias("kept"))


def verdicts_sql(rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE) -> str:
    """The same in SQL, over documents."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    broken = {}
    for r in rules:
        share, whole = (r.count, "1") if r.per is None else (f"1000 * {r.count}", r.per)
        if r.least is not None:
            broken[f"{r.name}_least"] = f"{share} < {r.least} * {whole}"
        if r.most is not None:
            broken[f"{r.name}_most"] = f"{share} > {r.most} * {whole}"
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in broken.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT r, unnest(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM d),
w AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM w0 WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, x1, x2) AS n FROM w WHERE x2 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY r),
ws AS (SELECT r, count(*) AS n, count(*) FILTER (lower(x) IN ({stops})) AS stops, count(*) FILTER (regexp_matches(x, '\\p{{L}}')) AS letters,
  count(*) FILTER (regexp_matches(x, '{CAPITALS}')) AS caps FROM w0 GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS y FROM d),
ls AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT y) AS dup, count(*) FILTER (regexp_matches(y, '^[\\x20\\x09-\\x0D]*[-*\\x{{2022}}]')) AS bullets,
  count(*) FILTER (regexp_matches(y, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09-\\x0D]*$')) AS opened FROM ln WHERE regexp_matches(y, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(ws.n, 0) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(ls.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(ws.stops, 0) AS n_stop_words, coalesce(ws.letters, 0) AS n_letter_words, coalesce(ws.caps, 0) AS n_capital_words,
  coalesce(ls.n, 0) AS n_lines, coalesce(ls.bullets, 0) AS n_bullet_lines, coalesce(ls.opened, 0) AS n_open_lines FROM d LEFT JOIN ws USING (r) LEFT JOIN rep USING (r) LEFT JOIN ls USING (r))
SELECT *, ({' OR '.join(broken[b] for b in base)}) AS base_failed, array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), ',') AS failed, NOT ({' OR '.join(broken.values())}) AS kept FROM m"""
