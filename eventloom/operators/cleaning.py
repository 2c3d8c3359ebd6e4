"""Source-specific record cleaning as column expressions; none of it shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.fixed_values import (
    CONFREF_PREFIX,
    CROSSREF_WORK_PREFIX,
    DBLP_PREFIX,
    DOI_PREFIX,
    MATCH_ID_COLUMNS,
    PLACEHOLDER_TITLE,
    SERIES_TITLE_SUFFIX,
    WIKICFP_EVENT_PREFIX,
    WIKICFP_SERIES_PREFIX,
    WIKIDATA_ENTITY_PREFIX,
)
from eventloom.functions import dates, titles
from eventloom.functions.text import fix_encodings, html_unescape, lookup_acronym, percent_quote


def _last_doi(links: Column) -> Column:
    dois = F.filter(F.split(links, ","), lambda e: e.startswith(DOI_PREFIX))
    return F.replace(F.try_element_at(dois, F.lit(-1)), F.lit(DOI_PREFIX), F.lit(""))


def with_ordinal(df: DataFrame) -> DataFrame:
    """Add the ordinal found in the title where the record has none."""
    found = titles.first_ordinal(F.col("title"))
    return df.withColumn("ordinal", F.coalesce(F.col("ordinal"), found) if "ordinal" in df.columns else found)


def conference_of_key(key: Column) -> Column:
    """Series part of a ``conf/…`` record key."""
    return F.when(key.startswith("conf/"), F.regexp_replace(key, "conf/(.*)/.*", "$1"))


def clean_dblp(raw: DataFrame) -> DataFrame:
    """Bibliography records: URL, dates of the title, acronym, DOI and series."""
    span = dates.title_range(F.col("title"))
    year = F.coalesce(span["year"], F.col("year").try_cast("int"))
    return with_ordinal(
        raw.select(
            F.col("key").alias("eventId"),
            F.lit("dblp").alias("source"),
            conference_of_key(F.col("key")).alias("series"),
            "title",
            year.alias("year"),
            "booktitle",
            F.when(F.col("booktitle").isNotNull() & year.isNotNull(), F.concat_ws(" ", "booktitle", year.cast("string"))).alias("acronym"),
            span["startDate"].alias("startDate"),
            span["endDate"].alias("endDate"),
            F.concat(F.lit(DBLP_PREFIX), "url").alias("url"),
            "ee",
            _last_doi(F.col("ee")).alias("doi"),
            "isbn",
            "mdate",
        )
    )


def _date_part(parts: Column, i: int) -> Column:
    return F.get(F.get(parts, F.lit(0)), F.lit(i))


def _full_date(parts: Column) -> Column:
    text = F.concat_ws("-", *[_date_part(parts, i).cast("string") for i in range(3)])
    return F.when(F.size(F.get(parts, F.lit(0))) == 3, F.try_to_date(text, "y-M-d"))


def clean_crossref(raw: DataFrame) -> DataFrame:
    """Flatten work records: event struct, first title and sponsor, date parts, encodings."""
    event = F.col("event")
    start, end = event["start"]["date-parts"], event["end"]["date-parts"]
    size = F.size(F.get(start, F.lit(0)))
    text = {name: event[name] for name in ("name", "location", "acronym", "number", "theme")}
    text["title"] = F.get("title", F.lit(0))
    text["sponsor"] = F.get("sponsor", F.lit(0))
    return with_ordinal(
        raw.select(
            F.col("DOI").alias("eventId"),
            F.lit("crossref").alias("source"),
            F.col("DOI").alias("doi"),
            F.concat(F.lit(CROSSREF_WORK_PREFIX), "DOI").alias("url"),
            *[fix_encodings(column).alias(name) for name, column in text.items()],
            F.when(size.between(1, 3), _date_part(start, 0)).alias("year"),
            F.when(size.between(2, 3), _date_part(start, 1)).alias("month"),
            _full_date(start).alias("startDate"),
            _full_date(end).alias("endDate"),
        )
    )


def clean_confref(raw: DataFrame) -> DataFrame:
    """Unescape, flatten area and series, rename, and join city and country."""
    series = F.col("confSeries")
    dblp_id = html_unescape(series["dblpId"])
    short = F.regexp_extract(dblp_id, "^https://dblp.org/db/(.*)/", 1)
    return with_ordinal(
        raw.select(
            F.col("id").alias("eventId"),
            F.lit("confref").alias("source"),
            F.concat(F.lit(CONFREF_PREFIX), "id").alias("url"),
            html_unescape(F.col("name")).alias("title"),
            F.col("number").try_cast("int").alias("ordinal"),
            F.col("year").try_cast("int").alias("year"),
            html_unescape(F.col("area")["value"]).alias("area"),
            F.when(short != "", short).otherwise(dblp_id).alias("dblpSeriesId"),
            series["id"].alias("seriesId"),
            html_unescape(series["name"]).alias("seriesTitle"),
            series["issn"].alias("seriesIssn"),
            series["eissn"].alias("seriesEissn"),
            html_unescape(F.col("city")).alias("city"),
            html_unescape(F.col("country")).alias("country"),
        ).withColumn("location", F.concat("city", F.lit(","), "country"))
    )


def clean_wikicfp(raw: DataFrame) -> DataFrame:
    """Drop deleted, spam and placeholder calls; take the year from the start date."""
    deleted = F.coalesce("deleted", F.lit(False))
    spam = F.coalesce(F.col("locality").startswith("1"), F.lit(False))
    placeholder = F.coalesce(F.col("title").startswith(PLACEHOLDER_TITLE), F.lit(False))
    year = F.year("startDate")
    return raw.where(~deleted & ~spam & ~placeholder).withColumns(
        {
            "source": F.lit("wikicfp"),
            "year": F.coalesce(year, F.col("year")) if "year" in raw.columns else year,
            "url": F.coalesce(F.col("url") if "url" in raw.columns else F.lit(None), F.concat(F.lit(WIKICFP_EVENT_PREFIX), "eventId")),
        }
    )


def clean_wikicfp_series(raw: DataFrame) -> DataFrame:
    title = F.col("title")
    suffixed = title.endswith(SERIES_TITLE_SUFFIX)
    return raw.withColumns(
        {
            "source": F.lit("wikicfp"),
            "eventSeriesId": F.col("seriesId"),
            "url": F.concat(F.lit(WIKICFP_SERIES_PREFIX), "seriesId"),
            "acronym": F.when(title.contains(":"), F.substring_index(title, ":", 1)),
            "title": F.when(suffixed, F.replace(title, F.lit(SERIES_TITLE_SUFFIX), F.lit(""))).otherwise(title),
        }
    )


def clean_wikidata(raw: DataFrame) -> DataFrame:
    bare = {
        c: F.replace(F.col(c), F.lit(WIKIDATA_ENTITY_PREFIX), F.lit(""))
        for c in ("eventId", "countryId", "locationId", "eventInSeriesId")
        if c in raw.columns
    }
    year = F.year("startDate")
    return raw.withColumns(
        {
            **bare,
            "source": F.lit("wikidata"),
            "year": F.coalesce(year, F.col("year")) if "year" in raw.columns else year,
            "ordinal": F.col("ordinal").try_cast("int"),
        }
    )


# Formats a wiki date may be written in, tried in this order.
WIKI_DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]


def lenient_date(text: Column) -> Column:
    """Date of a text in any known format, null if unreadable or empty."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in WIKI_DATE_FORMATS]).cast("date")


def clean_wiki_event(raw: DataFrame, base_url: str) -> DataFrame:
    """Wiki pages of events: id, whole-number year beside its text, dates and URL."""
    return with_ordinal(
        raw.withColumns(
            {
                "eventId": F.col("pageTitle"),
                "yearStr": F.col("year"),
                "year": F.col("year").try_cast("int"),
                "startDate": lenient_date(F.col("startDate")),
                "endDate": lenient_date(F.col("endDate")),
                "ordinal": F.col("ordinal").try_cast("int"),
                "url": F.concat(F.lit(f"{base_url}/index.php?title="), percent_quote(F.col("pageTitle"))),
            }
        )
    )


def clean_wiki_series(raw: DataFrame) -> DataFrame:
    number = F.when(F.col("period").rlike("^[0-9]+$"), F.col("period").try_cast("int"))
    return raw.withColumns({"eventSeriesId": F.col("pageTitle"), "period": number})


def clean_gnd(raw: DataFrame) -> DataFrame:
    """Authority records: parts of the full title, overruled by a readable date."""
    x = F.col("x")
    span = F.col("span")
    return raw.withColumns(
        {"x": titles.fulltitle(F.coalesce("fulltitle", F.lit(""))), "span": dates.text_range(F.col("date"))}
    ).select(
        "eventId",
        F.lit("gnd").alias("source"),
        "fulltitle",
        "date",
        *[x[f].alias(f) for f in ("title", "organization", "ordinal", "location")],
        F.coalesce(span["year"], x["year"]).alias("year"),
        span["startDate"].alias("startDate"),
        span["endDate"].alias("endDate"),
        (F.col("date").isNotNull() & F.coalesce(span["year"].isNull() & span["endDate"].isNull(), F.lit(True))).alias("invalidDate"),
        *[x[f] for f in ("partCount", "invalidTitle", "invalidOrdinal", "invalidYear", "yearRange")],
    )


def _shortest(parsed: Column) -> Column:
    """Of several parsed descriptions the first with the shortest acronym."""
    usable = F.filter(parsed, lambda d: d["acronym"].isNotNull() & d["ordinal"].isNotNull())
    ranked = F.transform(usable, lambda d, i: F.struct(F.length(d["acronym"]).alias("size"), i.alias("at"), d.alias("d")))
    return F.array_min(ranked)["d"]


def clean_tibkat(raw: DataFrame) -> DataFrame:
    """Catalogue records: acronym, ordinal, place and dates from the description list.

    A single description gives whatever it holds; of several the one with the shortest
    acronym and an ordinal counts.
    """
    parsed = F.transform("description", titles.description)
    chosen = F.when(F.size("description") == 1, F.get(parsed, F.lit(0))).otherwise(_shortest(parsed))
    fields = ("acronym", "ordinal", "location", "year", "startDate", "endDate")
    base = raw.withColumn("_d", chosen)
    return base.withColumns(
        {
            "source": F.lit("tibkat"),
            "eventId": F.col("ppn"),
            **{f: F.coalesce(F.col("_d")[f], F.col(f)) if f in raw.columns else F.col("_d")[f] for f in fields},
        }
    ).drop("_d")


def wanted_classification(codes: Column, prefixes: list[str]) -> Column:
    """True where any code starts with a wanted prefix; no prefixes keep everything."""
    if not prefixes:
        return F.lit(True)

    def fits(code: Column) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | code.startswith(prefix)
        return hit

    return F.coalesce(F.exists(codes, fits), F.lit(False))


def rename_properties(
    df: DataFrame, names: dict[str, str], reverse: bool = False, force: bool = False, include: Iterable[str] = ()
) -> DataFrame:
    """Template parameters to property names or back; unknown columns go unless forced or included.

    Works by exact name, as ``Series`` and ``series`` may be different columns.
    """
    mapping = {v: k for k, v in names.items()} if reverse else names
    kept = [c for c in df.columns if c in mapping or force or c in include]
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in kept])


def normalize_ids(records: DataFrame) -> DataFrame:
    """Event and series ids of every source copied to their own id columns."""
    source, event = F.col("source"), F.col("eventId")

    def column(name: str) -> Column:
        return F.col(name) if name in records.columns else F.lit(None).cast("string")

    wiki = source.isin("orclone", "openresearch")
    dblp_id = column("dblpId")
    wiki_dblp = F.when(dblp_id.startswith("conf/"), dblp_id).otherwise(F.concat(F.lit("conf/"), dblp_id))
    rules = {
        "confrefId": F.when(source == "confref", event),
        "confrefSeriesId": F.when(source == "confref", column("seriesId")),
        "dblpConferenceId": F.when(source == "dblp", event).when(source == "wikidata", dblp_id).when(wiki, wiki_dblp),
        "dblpSeriesId": F.when(source == "dblp", F.concat(F.lit("conf/"), column("seriesId"))),
        "TibKatId": F.when(source == "tibkat", event),
        "gndId": F.when(source == "tibkat", column("gndIds")),
        "wikicfpId": F.when(source == "wikicfp", event).when(source == "wikidata", column("wikiCfpId")),
        "seriesWikicfpId": F.when(source == "wikicfp", column("seriesId")),
        "wikidataId": F.when(source == "wikidata", event),
        "seriesWikidataId": F.when(source == "wikidata", column("eventInSeriesId")),
        "openresearchId": F.when(wiki, event),
        "seriesOpenresearchId": F.when(wiki, column("inEventSeries")),
    }
    return records.withColumns({name: F.coalesce(rules[name], column(name)) for name in MATCH_ID_COLUMNS})


def title_location(title: Column) -> Column:
    """Third and fourth comma part of a title with more than three parts."""
    parts = F.split(title, ",")
    return F.when(F.size(parts) > 3, F.concat_ws(", ", F.trim(F.get(parts, F.lit(2))), F.trim(F.get(parts, F.lit(3)))))


def wiki_location(city: Column, region: Column, country: Column) -> Column:
    """City, region and country without their category prefix, joined by commas."""
    parts = [F.nullif(F.replace(c, F.lit("Category:"), F.lit("")), F.lit("")) for c in (city, region, country)]
    return F.concat_ws(", ", *parts)


def with_lookup_acronym(events: DataFrame) -> DataFrame:
    """Add the acronym used for lookups."""
    event = F.col("event") if "event" in events.columns else F.lit(None).cast("string")
    return events.withColumn("lookupAcronym", lookup_acronym(F.col("acronym"), event, F.col("year")))
