"""Word column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case, in order; null and blank texts give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_id(text: Column) -> Column:
    """An id as compared: trimmed, lower case, null if blank."""
    return F.nullif(F.lower(strip(text)), F.lit(""))
