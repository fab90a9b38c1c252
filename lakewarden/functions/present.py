"""Cleaning of single values: blanks, placeholders, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c\xa0\u3000"

# The placeholders that stand for a missing value.
PLACEHOLDERS = ("", "N/A", "null", "None")


def strip(value: Column | str) -> Column:
    """``value`` without the blanks round it; null stays null."""
    return F.btrim(F.col(value) if isinstance(value, str) else value, F.lit(BLANKS))


def present(value: Column | str) -> Column:
    """The stripped value, or null where it is empty or a placeholder (compared exactly)."""
    stripped = strip(value)
    return F.when(~stripped.isin(*PLACEHOLDERS), stripped)


def first_present(*values: Column | str) -> Column:
    """The first of ``values`` that is present."""
    return F.coalesce(*[present(v) for v in values])


def strip_quotes(value: Column | str) -> Column:
    """``value`` without double, then single quotes at both ends."""
    value = F.col(value) if isinstance(value, str) else value
    return F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
