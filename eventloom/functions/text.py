"""Small text columns shared by the cleaning rules."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.fixed_values import (
    ENCODING_FIXES,
    ISBN_10_PATTERN,
    ISBN_13_PATTERN,
    LINK_FORMATS,
    LINK_PATTERNS,
    LIST_SEPARATOR,
)


def isbn_type(value: Column) -> Column:
    """``ISBN-10``, ``ISBN-13`` or null; the empty text counts as ISBN-13."""
    return F.when(value.rlike(f"^(?:{ISBN_10_PATTERN})$"), "ISBN-10").when(
        value.rlike(f"^(?:{ISBN_13_PATTERN})$"), "ISBN-13"
    )


def to_isbn13(value: Column) -> Column:
    """Prefix an ISBN-10 with ``978-`` (check digit kept), pass an ISBN-13, else null."""
    kind = isbn_type(value)
    return F.when(kind == "ISBN-10", F.concat(F.lit("978-"), value)).when(kind == "ISBN-13", value)


def fix_encodings(value: Column) -> Column:
    for found, replacement in ENCODING_FIXES:
        value = F.replace(value, F.lit(found), F.lit(replacement))
    return value


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(value: Column) -> Column:
    """HTML entities to characters; only text with an ``&`` is sent to Python."""
    return F.coalesce(_unescape(F.when(value.contains("&"), value)), value)


_XML_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}


@F.pandas_udf(StringType())
def _resolve(values: pd.Series) -> pd.Series:
    def resolve(text: str) -> str:
        return re.sub(
            "&([A-Za-z][A-Za-z0-9]*);", lambda m: m.group(0) if m.group(1) in _XML_ENTITIES else html.unescape(m.group(0)), text
        )

    return values.map(resolve, na_action="ignore")


def resolve_entities(value: Column) -> Column:
    """Named entities to characters, the five of XML itself kept.

    Only text with other entities is sent to Python.
    """
    foreign = "&(?!(?:amp|lt|gt|quot|apos);|#)[A-Za-z][A-Za-z0-9]*;"
    return F.coalesce(_resolve(F.when(value.rlike(foreign), value)), value)


def leading_int(value: Column) -> Column:
    """Leading integer of a text, 0 without one: how a lenient SQL cast reads it."""
    number = F.nullif(F.regexp_extract(value, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    return F.when(value.isNotNull(), F.coalesce(number.try_cast("int"), F.lit(0)))


def link(value: Column, name: str) -> Column:
    """URL for a value by the name of its link format."""
    if name in LINK_PATTERNS:
        value = F.nullif(F.regexp_extract(value, LINK_PATTERNS[name], 1), F.lit(""))
    before, after = LINK_FORMATS[name].split("{value}")
    return F.concat(F.lit(before), value, F.lit(after))


def split_list(value: Column) -> Column:
    """A stored list value as an array."""
    return F.split(value, LIST_SEPARATOR)


def lookup_acronym(acronym: Column, event: Column, year: Column) -> Column:
    """Acronym, or else the event text, followed by the year unless it holds four digits."""
    name = F.coalesce(acronym, event)
    return F.when(
        year.isNotNull() & ~name.rlike("[0-9]{4}"), F.concat_ws(" ", name, year.cast("string"))
    ).otherwise(name)


def percent_quote(value: Column) -> Column:
    """Percent-encode a page title, blanks as ``%20`` and slashes kept."""
    quoted = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted
