"""Small column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def canon_label(label: Column, devoiced: Column) -> Column:
    """Upper case marks a devoiced vowel."""
    return F.when(devoiced, F.upper(label)).otherwise(label)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def norm_word(word: Column) -> Column:
    """NFKC and lower case.

    Spark has no normalisation function; plain ASCII never leaves the JVM path.
    """
    ascii_only = word.rlike(r"^[\x00-\x7F]*$")
    return F.lower(F.when(ascii_only, word).otherwise(_nfkc(F.when(~ascii_only, word))))


def pseudonym(key: Column, salt: str, digits: int = 12) -> Column:
    """First hex digits of the salted SHA-1."""
    return F.substring(F.sha1(F.concat(F.lit(salt), key).cast("binary")), 1, digits)
