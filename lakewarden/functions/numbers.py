"""Whole-number arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(value: Column | str, width: int) -> Column:
    """floor(value / width) of BIGINTs, exact for negative and for large values too."""
    value = F.col(value) if isinstance(value, str) else value
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")
