"""Text rules: folding for search, ordering text, tokens, safe export text."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Every character a Unicode-aware regular expression calls white space.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def fold_text(value: str) -> str:
    """Case- and accent-insensitive form: decompose, casefold, drop marks."""
    if value.isascii():
        return value.lower()
    wide = unicodedata.normalize("NFKD", value).casefold()
    return "".join(c for c in wide if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Column form of :func:`fold_text`."""
    return text.map(fold_text, na_action="ignore")


@F.pandas_udf(StringType())
def sort_text(text: pd.Series) -> pd.Series:
    """Ordering form: canonical composition around a casefold, code-point order."""

    def one(value: str) -> str:
        if value.isascii():
            return value.lower()
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())

    return text.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return text.map(lambda value: unicodedata.normalize("NFC", value), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def words(text: str) -> list[str]:
    """Distinct words of a query, folded."""
    return sorted(set(re.findall(r"[^\W_]+", fold_text(text))))


def has_all_words(folded: Column, query: str) -> Column:
    """Every word of the query occurs as a whole word of the folded text.

    A query without a word matches nothing.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    wanted = [F.contains(spaced, F.lit(f" {word} ")) for word in words(query)]
    return reduce(lambda a, b: a & b, wanted) if wanted else F.lit(False)


def escape_controls(text: Column) -> Column:
    r"""Spell control characters as ``\u00xx``; tab and line breaks stay."""
    escaped = text
    for code in range(32):
        if chr(code) not in "\t\n\r":
            escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\u%04x" % code))
    return F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), escaped).otherwise(text)


def fragments(text: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` characters, in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length(text) - 1) / size)).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
