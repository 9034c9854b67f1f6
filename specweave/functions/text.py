"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave.model import DESCRIPTION_SEPARATOR

# Whitespace as Unicode defines it, not only the ASCII part of ``\s``.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, whitespace or the text ``nan``."""
    return c.isNull() | F.coalesce(strip(c).isin("", "nan"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def token_sort(c: Column) -> Column:
    """Whitespace tokens in code point order, joined by one blank."""
    return F.array_join(F.array_sort(F.split(strip(c), f"{_SPACE}+")), " ")


def fold_name(c: Column) -> Column:
    """Lower case, letters and digits only (Latin and Hangul syllables)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9가-힣]", "")


def head_of(description: Column, default: Column) -> Column:
    """The part before the first separator, ``default`` where there is none."""
    return F.when(
        F.contains(description, F.lit(DESCRIPTION_SEPARATOR)),
        F.substring_index(description, DESCRIPTION_SEPARATOR, 1),
    ).otherwise(default)


def tail_of(description: Column) -> Column:
    """The part after the first separator, the whole text where there is none."""
    at = F.instr(description, DESCRIPTION_SEPARATOR)
    return F.when(
        at > 0, F.substring(description, at + len(DESCRIPTION_SEPARATOR), F.length(description))
    ).otherwise(description)


def md5_bucket(key: Column, digits: int) -> Column:
    """A bucket name of ``digits`` hex digits: 16**digits buckets."""
    return F.substring(F.md5(key.cast("string")), 1, digits) if digits else F.lit("")


def bare(text: Column) -> Column:
    """A text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def unfenced(text: Column) -> Column:
    """A reply without code fence: fence marks off, then the line with the language."""
    inner = F.regexp_replace(F.regexp_replace(bare(text), "^`+|`+$", ""), r"^[^\n]*\n", "")
    return F.when(F.startswith(bare(text), F.lit("```")), inner).otherwise(bare(text))
