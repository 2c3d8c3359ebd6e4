"""Title columns: ordinals, volumes, scores, words and catalogue descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.fixed_values import (
    ODD_ORDINALS,
    ORDINAL_WORDS,
    PLACE_TIME_PATTERN,
    TENS_WORDS,
    TITLE_CITIES,
    TITLE_COUNTRIES,
    TITLE_PROVINCES,
    TITLE_SEPARATORS,
    TITLE_VOCABULARY,
    TITLE_YEARS,
    VOLUME_DISTRIBUTION_PATTERN,
    VOLUME_LETTERS,
    VOLUME_PATTERN,
    VOLUME_ROMAN,
    MONTHS,
)
from eventloom.functions.dates import bind, extract_or_null, group, regex_groups, text_range


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


# digits with a suffix, a word ending like an ordinal, or a number up to 99 before a full stop
_ORDINAL_TOKEN = (
    r"(?<![\p{L}0-9-])((?i:[0-9]{1,9}(?:st|nd|rd|th)|(?:[a-z]+-)?(?:first|second|third|[a-z]+th)|eight)(?![\p{L}0-9-])"
    r"|(?<![^\s])(?:[1-9][0-9]?\.|[CLXVI]+\.|III?|[12])(?=\s|$))"
)


def roman_values() -> dict[str, int]:
    """``I`` … ``XCIX`` with their numbers."""
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    tens = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
    return {tens[n // 10] + ones[n % 10]: n for n in range(1, 100)}


def ordinal_word_values() -> dict[str, int]:
    """``first`` … ``ninety-ninth`` with their numbers."""
    words = dict(zip(ORDINAL_WORDS, range(1, 20)))
    for tens, word in zip(range(20, 100, 10), TENS_WORDS):
        words[word[:-1] + "ieth"] = tens
        for unit in range(1, 10):
            words[f"{word}-{ORDINAL_WORDS[unit - 1]}"] = tens + unit
    return words


def title_dictionary() -> list[tuple[str, str, int | None, str | None]]:
    """(word, type, value, item) rows: fixed categories, and years, months and ordinals built by rule.

    Entries may have several words. ``value`` is the number a word stands for, ``item`` the
    Wikidata item of a country.
    """
    rows = [(word, kind, None) for word, kind in TITLE_VOCABULARY]
    rows += [(name, "month", i) for i, name in enumerate(MONTHS, start=1)]
    for word, value in ordinal_word_values().items():
        rows += [(word, "enum", value), (word.title(), "enum", value)]
    for roman, value in roman_values().items():
        suffix = {1: "st", 2: "nd", 3: "rd"}.get(value % 10 if value // 10 != 1 else 0, "th")
        rows += [(f"{value}{suffix}", "enum", value), (f"{value}.", "enum", value), (f"{roman}.", "enum", value)]
    rows += [(word, "enum", value) for word, value in ODD_ORDINALS]
    rows += [(str(year), "year", year) for year in range(TITLE_YEARS[0], TITLE_YEARS[1] + 1)]
    rows += [(name, "province", None) for name in TITLE_PROVINCES] + [(name, "city", None) for name in TITLE_CITIES]
    return [(*row, None) for row in rows] + [(name, "country", None, item) for name, item in TITLE_COUNTRIES]


def ordinals(title: Column) -> Column:
    """All ordinals of a title in order: ``12th``, ``12.`` and ``XII.`` forms, and ordinal words."""
    words = _literal_map(ordinal_word_values() | {"eight": 8})
    romans = _literal_map(roman_values())
    candidates = F.regexp_extract_all(title, F.lit(_ORDINAL_TOKEN), F.lit(1))

    def number(token: Column) -> Column:
        digits = F.regexp_extract(token, "^[0-9]+", 0).try_cast("int")
        roman = F.try_element_at(romans, F.rtrim(token, F.lit(".")))
        return F.coalesce(digits, F.try_element_at(words, F.lower(token)), roman)

    return F.filter(F.transform(candidates, number), lambda n: n.isNotNull())


def first_ordinal(title: Column) -> Column:
    return F.try_element_at(ordinals(title), F.lit(1))


def volume_number(title: Column) -> Column:
    """Number of a volume or part; letters count from A, roman numbers from I."""
    letters = {c: i for i, c in enumerate(VOLUME_LETTERS, start=1)}
    roman = {c: i for i, c in enumerate(VOLUME_ROMAN, start=1)}
    digits = {f"{i:0{width}}": i for width in (1, 2) for i in range(1, 100)}
    return F.try_element_at(_literal_map({**letters, **roman, **digits}), F.regexp_extract(title, VOLUME_PATTERN, 3))


def volume_text(title: Column) -> Column:
    """The text standing for the volume, empty if there is none after the marker."""
    return F.when(title.rlike(VOLUME_DISTRIBUTION_PATTERN), F.regexp_extract(title, VOLUME_DISTRIBUTION_PATTERN, 2))


def title_score(title: Column) -> Column:
    """How well a title stands for the whole event; 0 for a missing title."""
    lowered = F.lower(title)
    points = [
        F.when(lowered.contains("proceeding"), 1.0).otherwise(0.0),
        F.when(lowered.contains("conference"), 1.0).otherwise(0.0),
        F.coalesce(F.lit(1.0) / volume_number(title), F.lit(0.0)),
        F.lit(0.5),
    ]
    return F.when(title.isNull(), 0.0).otherwise(reduce(lambda a, b: a + b, points))


def series_acronym(acronym: Column) -> Column:
    """Series part of ``ABC 2020``, null for any other form."""
    return extract_or_null(acronym, r"^([A-Z]+)\s*[0-9]+$")


def title_words(title: Column) -> Column:
    """Words of a title after its special characters became spaces."""
    blanks = " " * len(TITLE_SEPARATORS)
    return F.when(title.isNull(), F.array().cast("array<string>")).otherwise(
        F.split(F.translate(title, TITLE_SEPARATORS, blanks), " ")
    )


def description(text: Column) -> Column:
    """``Workshop (WIRN) ; 8 (Vietri) : 1996.05.23-25`` as a struct.

    Without ``;`` or with an ordinal above 1000 every field is null.
    """

    def read(p: Column) -> Column:
        return F.struct(
            (F.size(p) > 1).alias("parted"),
            regex_groups(p[0], r"\(([^)]*)\)", 1).alias("bracket"),
            p[0].alias("head"),
            regex_groups(F.get(p, F.lit(1)), PLACE_TIME_PATTERN, 3).alias("g"),
        )

    def fields(r: Column) -> Column:
        ordinal = group(r["g"], 1).try_cast("int")
        usable = r["parted"] & (group(r["g"], 1).isNull() | F.coalesce(ordinal <= 1000, F.lit(False)))
        return F.struct(
            F.when(usable, F.coalesce(F.get(r["bracket"], F.lit(1)), F.trim(r["head"]))).alias("acronym"),
            F.when(usable, ordinal).alias("ordinal"),
            F.when(usable, F.get(r["g"], F.lit(2))).alias("location"),
            F.when(usable, text_range(group(r["g"], 3))).alias("span"),
        )

    def flat(f: Column) -> Column:
        span = [f["span"][name].alias(name) for name in ("year", "startDate", "endDate")]
        return F.struct(f["acronym"].alias("acronym"), f["ordinal"].alias("ordinal"), f["location"].alias("location"), *span)

    return bind(bind(bind(F.split(text, ";"), read), fields), flat)


_FULLTITLE = r"^(.*?)\((.*?)\).*$"


def fulltitle(text: Column) -> Column:
    """``Symposium on X (1 : 1965 : Pittsburgh, Pa.)`` as a struct with its defects flagged.

    The bracket holds year / year : place / ordinal : year : place /
    organisation : ordinal : year : place.
    """

    def parts_of(g: Column) -> Column:
        inner = F.get(g, F.lit(2))
        parts = F.split(inner, ":")
        return F.struct(
            F.trim(F.get(g, F.lit(1))).alias("title"), parts.alias("parts"), F.when(inner.isNotNull(), F.size(parts)).alias("n")
        )

    def texts(t: Column) -> Column:
        n = t["n"]

        def part(from_end: int) -> Column:
            return F.get(t["parts"], n - from_end)

        return F.struct(
            t["title"].alias("title"),
            n.alias("n"),
            F.when(n == 4, part(4)).alias("organization"),
            F.trim(F.when(n.isin(3, 4), part(3))).alias("ordinal"),
            F.trim(F.when(n == 1, part(1)).when(n.isin(2, 3, 4), part(2))).alias("year"),
            F.when(n.isin(2, 3, 4), F.trim(part(1))).alias("location"),
        )

    def fields(f: Column) -> Column:
        span = r"^([0-9]+)\s*-\s*([0-9]+)$"
        year = F.regexp_extract(f["year"], r"^([0-9]+)(?:\s*-\s*[0-9]+)?$", 1)
        ordinal = F.regexp_extract(f["ordinal"], r"^([0-9]+)\.?$", 1)
        return F.struct(
            f["title"].alias("title"),
            f["organization"].alias("organization"),
            ordinal.try_cast("int").alias("ordinal"),
            year.try_cast("int").alias("year"),
            f["location"].alias("location"),
            f["n"].alias("partCount"),
            f["n"].isNull().alias("invalidTitle"),
            F.coalesce(ordinal == "", F.lit(False)).alias("invalidOrdinal"),
            F.coalesce(year == "", F.lit(False)).alias("invalidYear"),
            F.coalesce(f["year"].rlike(span), F.lit(False)).alias("yearRange"),
        )

    return bind(bind(bind(regex_groups(text, _FULLTITLE, 2), parts_of), texts), fields)
