"""Text as column expressions: slugs, tags, tokens, matching forms, personal data."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakewarden.functions.present import strip

# What counts as a mail address, an IPv4 address, a phone number, a checksum, a technique id, a user's folder.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PHONE = r"(?:\b\d{4}\s*\(\d{2}\)\s*\d{8,9}\b)|(?:\+?\d{1,3}\s*\(?\d{2}\)?\s*\d{4,5}[-\s]?\d{4})"
HEX_HASH = r"(?i)\b[a-f0-9]{32,64}\b"
TECHNIQUE = r"(?i)\bT\d{4}(?:\.\d{3})?\b"
WINDOWS_USER = r"(?i)([A-Z]:\\Users\\)[^\\\s]+"
POSIX_USER = r"(?i)(/Users/|/home/)[^/\s]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(value: Column | str, default: str = "unknown") -> Column:
    """Lower case, anything else than a-z and 0-9 as one underscore, none at the ends."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def tag_part(value: Column | str, default: str = "unknown") -> Column:
    """Everything but letters, digits, hyphen and underscore as an underscore, none at the ends."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(_c(value), r"[^\p{L}\p{N}_-]", "_"), F.lit("_")), F.lit("")), F.lit(default))


def digits(value: Column | str, default: str = "000000") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(_c(value), "[^0-9]", ""), F.lit("")), F.lit(default))


def tokens(value: Column | str, stop: list[str]) -> Column:
    """Words of three and more of a-z, 0-9 and underscore, without stop words and numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(value), F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))


def without_tags(value: Column | str) -> Column:
    """Markup tags as blanks, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(_c(value), "<[^>]+>", " "), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    def fold(text: str | None) -> str | None:
        if text is None:
            return None
        plain = unicodedata.normalize("NFKD", " ".join(re.sub("<[^>]+>", " ", html.unescape(text)).lower().split()))
        return "".join(c for c in plain if not unicodedata.combining(c))

    return texts.map(fold)


def match_form(value: Column | str) -> Column:
    """References resolved, without tags, in lower case, white space collapsed, compatible forms one, without combining marks.

    Texts of plain ASCII without references don't leave the JVM.
    """
    odd = F.when(_c(value).rlike("&|[^\\x00-\\x7F]"), _c(value))
    return F.coalesce(_folded(odd), F.lower(without_tags(value)))


def contains_any(value: Column, needles: list[str]) -> Column:
    """Whether a lower-cased ``value`` holds any of ``needles``; false for none."""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(value, F.lit(n.lower()))
    return found


def contains_all(value: Column, needles: list[str]) -> Column:
    """Whether a lower-cased ``value`` holds all of ``needles``; true for none."""
    found = F.lit(True)
    for n in needles:
        found = found & F.contains(value, F.lit(n.lower()))
    return found


def format_p(p: Column | str) -> Column:
    """Four digits, halves up; "<0.0001" below that."""
    return F.when(_c(p) < 0.0001, "<0.0001").otherwise(F.format_string("%.4f", _c(p).cast("double") + 1e-9))
