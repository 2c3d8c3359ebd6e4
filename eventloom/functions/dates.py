"""Date columns read out of free text.

A text is matched once by one pattern; its groups are then bound to a lambda variable, so
that no regular expression runs again for every field made from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.fixed_values import DAY_PATTERN, MONTH_PATTERN, MONTHS, YEAR_PATTERN

_MARK = "\u001f"  # the ASCII unit separator, not found in titles


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def regex_groups(text: Column, pattern: str, count: int) -> Column:
    """Groups 1 to ``count`` of the first match as array items 1 to ``count``.

    One pass of the regex engine. Without a match the array has one item; a group that took
    no part is empty.
    """
    marked = F.regexp_replace(text, f"(?s)^.*?(?:{pattern}).*$", "".join(f"{_MARK}${i}" for i in range(1, count + 1)))
    return F.split(marked, _MARK)


def group(groups: Column, i: int) -> Column:
    """Group of :func:`regex_groups`, null if it is empty or nothing matched."""
    found = F.get(groups, F.lit(i))
    return F.when(found != "", found)


def extract_or_null(text: Column, pattern: str, number: int = 1) -> Column:
    """One regex group, or null where the pattern or the group does not match."""
    found = F.regexp_extract(text, pattern, number)
    return F.when(found != "", found)


def _date(*year_month_day: Column) -> Column:
    """Date of its parts; null if one is missing or there is no such day."""
    with_dashes = [part for c in year_month_day for part in (F.lit("-"), c)][1:]
    return F.concat(*with_dashes).try_cast("date")


def _span(year: Column, start: Column, end: Column) -> Column:
    return F.struct(year.alias("year"), start.alias("startDate"), end.alias("endDate"))


_DAY_MONTH = (
    f"^({YEAR_PATTERN})$"
    r"|^\s*([1-9]|[12][0-9]|30)-([1-9]|[12][0-9]|30)(?:st|nd|rd|th)?\s+("
    + "|".join(MONTHS)
    + rf")\s+({YEAR_PATTERN})\s*[.]?$"
)


def day_month_range(text: Column) -> Column:
    """``18-21 September 2005`` or a bare year as struct(year, startDate, endDate).

    Days 1 to 30 within one month; both dates must exist or neither is set.
    """

    def dates(g: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), group(g, 4)).cast("string")
        return F.struct(
            group(g, 1).cast("int").alias("year"),
            _date(group(g, 5), month, group(g, 2)).alias("start"),
            _date(group(g, 5), month, group(g, 3)).alias("end"),
        )

    def span(d: Column) -> Column:
        both = d["start"].isNotNull() & d["end"].isNotNull()
        year = F.coalesce(d["year"], F.when(both, F.year(d["start"])))
        return _span(year, F.when(both, d["start"]), F.when(both, d["end"]))

    return bind(bind(regex_groups(text, _DAY_MONTH, 5), dates), span)


def title_range(title: Column) -> Column:
    """Date range in the last comma-separated part of a title."""
    return day_month_range(F.substring_index(title, ",", -1))


_TEXT = (
    f"^({YEAR_PATTERN})-?(?:{YEAR_PATTERN})?$"
    rf"|^([0-9]{{2}})[.]([0-9]{{2}})[.]({YEAR_PATTERN})(?:-|-([0-9]{{2}})[.]([0-9]{{2}})[.]({YEAR_PATTERN}))?$"
    rf"|^({YEAR_PATTERN})\.({MONTH_PATTERN})\.({DAY_PATTERN})-(?:({MONTH_PATTERN})\.({DAY_PATTERN})|({DAY_PATTERN}))$"
)


def text_range(text: Column) -> Column:
    """Catalogue date text as struct(year, startDate, endDate), all null if unreadable.

    Forms: ``2018``, ``2018-2019``, ``08.01.2019``, ``08.01.2019-11.01.2019``,
    ``1996.05.23-25`` and ``2021.02.28-03.02``.
    """

    def dates(g: Column) -> Column:
        until_month = F.coalesce(group(g, 11), group(g, 9))
        until_day = F.coalesce(group(g, 12), group(g, 13))
        return F.struct(
            group(g, 1).cast("int").alias("year"),
            F.coalesce(_date(group(g, 4), group(g, 3), group(g, 2)), _date(group(g, 8), group(g, 9), group(g, 10))).alias("start"),
            F.coalesce(_date(group(g, 7), group(g, 6), group(g, 5)), _date(group(g, 8), until_month, until_day)).alias("end"),
        )

    def span(d: Column) -> Column:
        return _span(F.coalesce(d["year"], F.year(d["start"])), d["start"], d["end"])

    return bind(bind(regex_groups(text, _TEXT, 13), dates), span)


def month_day(date: Column) -> Column:
    """``month * 100 + day``."""
    return F.month(date) * 100 + F.dayofmonth(date)
