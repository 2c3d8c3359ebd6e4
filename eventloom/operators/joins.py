"""Joins between sources, and between events and their series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import link, split_list
from eventloom.functions.titles import title_words
from eventloom.operators.series import dedup_by_title
from eventloom.operators.views import Corpus, common_view, restrict_to_ids, view_tables, with_source
from eventloom.session import spread, stage


def event_series_lookup(
    tables: Corpus, name: str, classifications: list[str] | None = None, reduce_sources: tuple[str, ...] = ()
) -> DataFrame:
    """All records of the events whose lookup acronym is ``name`` and more text.

    ``name`` goes into a LIKE pattern, so ``_`` and ``%`` in it are wildcards. Sources in
    ``reduce_sources`` keep only the best title of each year; with ``classifications``
    the source ``tibkat`` is filtered by them.
    """
    view = common_view({n: df.select("source", "eventId", "lookupAcronym") for n, df in view_tables(tables).items()})
    # few ids: written once, so that each source is read once for them and once for its records
    ids = stage(view.where(F.col("lookupAcronym").ilike(f"{name} %")).select("source", "eventId").distinct(), "found-ids")
    results: Corpus = {}
    for table, df in view_tables(tables).items():
        source = table.split("_", 1)[1]
        found = restrict_to_ids(df, ids)
        if classifications and source == "tibkat":
            found = found.where(classification_filter(F.col("bk"), classifications))
        if source in reduce_sources:
            found = dedup_by_title(stage(found, "found-records"), [])
        results[source] = found
    return with_source(results)


def classification_filter(codes: Column, allowed: list[str]) -> Column:
    """Keep a stored code list by main class (``54``), sub class (``54.72``) or ``null``."""
    main = [a for a in allowed if a.isnumeric()]
    sub = [a for a in allowed if len(a.split(".")) == 2 and all(p.isdigit() for p in a.split(".")) and
           len(a.split(".")[0]) in (1, 2) and len(a.split(".")[1]) == 2]
    parts = split_list(codes)
    heads = F.transform(parts, lambda c: F.substring_index(c, ".", 1))
    none = F.array().cast("array<string>")
    hit = F.arrays_overlap(heads, F.array(*map(F.lit, main)) if main else none) | F.arrays_overlap(
        parts, F.array(*map(F.lit, sub)) if sub else none
    )
    missing = F.lit(any(a.lower() in ("null", "none") for a in allowed))
    return F.when(codes.isNull(), missing).otherwise(F.coalesce(hit, F.lit(False)))


def link_series(events: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Events per foreign key and whether a series of that acronym exists.

    Events are counted per key before the join, so a huge series costs one row.
    """
    counts = events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("acronym")).agg(
        F.count("*").alias("eventCount")
    )
    known = series.select("acronym").distinct().withColumn("linked", F.lit(True))
    return counts.join(known, "acronym", "left").select(
        "acronym", "eventCount", F.coalesce("linked", F.lit(False)).alias("linked")
    )


def unmatched_series(events: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Foreign keys of events that name no known series."""
    return events.select(F.col(key).alias("acronym")).where("acronym IS NOT NULL").distinct().join(
        series.select("acronym"), "acronym", "left_anti"
    )


def events_in_series(events: DataFrame, key: str, acronym: str) -> DataFrame:
    return events.where(F.col(key) == acronym)


def doi_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of two sources with the same DOI, dates as text, newest first."""
    right = right.select(F.col("doi"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c != "doi"])
    dated = left.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("startDate", "endDate")})
    # the DOI as second key spreads a date with very many records over several ranges
    return dated.join(right, "doi").orderBy(F.desc("startDate"), "doi")


def place_and_date_match(left: DataFrame, right: DataFrame, city_prefix: str) -> DataFrame:
    """Events of two sources on the same days in the same city, labels cut for display.

    Both sides are made distinct before the join. Every column of a side comes out again, so
    no two pairs are alike and the pairs, which may be many, are never shuffled.
    """
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("startDate", "endDate")}
    l = left.where("startDate IS NOT NULL AND countryId IS NOT NULL AND cityId IS NOT NULL AND endDate IS NOT NULL").select(
        F.col("eventId").alias("leftId"), "cityId", *[d.alias(c) for c, d in days.items()], F.substring("title", 1, 40).alias("leftTitle")
    )
    r = right.where("country IS NOT NULL AND cityWikidataid IS NOT NULL AND startDate IS NOT NULL AND endDate IS NOT NULL").select(
        F.concat(F.lit(city_prefix), "cityWikidataid").alias("cityId"), *[d.alias(c) for c, d in days.items()],
        F.col("cityWikidataid"), "city", F.substring("title", 1, 40).alias("rightTitle"), "doi",
    )
    return l.distinct().join(r.distinct(), ["startDate", "endDate", "cityId"]).select(
        "leftId", F.col("cityWikidataid").alias("cityId"), "city", "startDate", "endDate", "leftTitle", "rightTitle", "doi"
    )


def series_events(series: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Series with each of their events."""
    return series.select(F.col("acronym").alias(key), F.col("title").alias("seriesTitle")).join(
        events.select(key, "eventId", F.col("acronym").alias("eventAcronym")), key
    )


def series_max_ordinal(events: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """Highest ordinal per known series, without those whose highest is zero."""
    highest = events.where("ordinal IS NOT NULL").groupBy(F.col(key).alias("acronym")).agg(
        F.max("ordinal").alias("maxOrdinal")
    )
    return highest.where("maxOrdinal <> 0").join(series.select("acronym", "title"), "acronym")


def cross_source_series(left_ids: DataFrame, right_ids: DataFrame, prefix: str) -> DataFrame:
    """How many series ids of the left source, without their prefix, the right one knows."""
    left = left_ids.withColumn("id", F.regexp_replace("id", f"^{prefix}", ""))
    right = right_ids.select("id").distinct().withColumn("known", F.lit(True))
    return left.join(right, "id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("known")).alias("found"),
        F.count_if(F.col("known").isNull()).alias("notFound"),
        F.round(F.avg(F.when(F.col("known"), 1.0).otherwise(0.0)), 6).alias("linkedShare"),
        F.round(F.avg(F.when(F.col("acronym").isNotNull(), 1.0).otherwise(0.0)), 6).alias("acronymShare"),
    )


def catalogue_to_wiki(catalogue: DataFrame, wiki: DataFrame) -> DataFrame:
    """Catalogue records ``ACR ; … ; ordinal`` matched to wiki pages, one row per page and id.

    ``idCount`` tells pages with one id from those with several; counting is a separate
    aggregate so that a page matched by very many records is never gathered in one row.
    """
    parts = F.split("event", ";")
    keyed = catalogue.where(F.col("event").isNotNull() & (F.size(parts) >= 2)).select(
        "ppn", F.trim(parts[0]).alias("series"), F.trim(F.element_at(parts, -1)).alias("ordinal")
    )
    pages = wiki.select("pageTitle", "series", F.col("ordinal").cast("string").alias("ordinal"))
    found = keyed.join(pages, ["series", "ordinal"]).select("pageTitle", "ppn")
    counts = found.groupBy("pageTitle").agg(F.count("ppn").alias("idCount"))
    return found.join(counts, "pageTitle").select(
        "pageTitle", "ppn", "idCount", (F.col("idCount") > 1).alias("ambiguous")
    )


def match_candidates(records: DataFrame, series: DataFrame, text_columns: list[str], id_column: str) -> DataFrame:
    """Records whose words contain a series acronym, compared in lower case.

    Words meet acronyms in an equi-join; identical (record, word) pairs are dropped first.
    """
    return match_records(records.select(id_column, *[c for c in text_columns if c != id_column]), series, text_columns).select(id_column, "seriesAcronym")


def match_records(records: DataFrame, series: DataFrame, text_columns: list[str]) -> DataFrame:
    """As :func:`match_candidates`, with the whole record carried along."""
    words = F.explode(F.array_distinct(F.concat(*[title_words(F.lower(c)) for c in text_columns]))).alias("_word")
    wanted = series.select(F.col("acronym").alias("seriesAcronym"), F.lower("acronym").alias("_word")).distinct()
    return records.select("*", words).where("_word <> ''").join(wanted, "_word").drop("_word")


def format_links(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Replace columns by the URL their link format gives."""
    return df.withColumns({column: link(F.col(column), name) for column, name in formats.items()})


def scholar_enrich(scholars: DataFrame, triples: DataFrame, properties: list[str], id_column: str) -> DataFrame:
    """Scholars with an id, completed by the joined values of optional properties.

    Triples are dealt out by subject once, to as many tasks as there is input for; distinct
    values, lists and the join with the scholars are found there, subjects that are no scholar go with the join.
    """
    wanted = spread(triples.where(F.col("p").isin(properties) & F.col("o").isNotNull()).select("s", "p", "o"), "s").distinct()
    columns = [
        F.nullif(
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("p") == name, F.col("o")))), "|"), F.lit("")
        ).alias(f"found_{name}")
        for name in properties
    ]
    found = wanted.groupBy(F.col("s").alias(id_column)).agg(*columns)
    kept = [c for c in scholars.columns if c not in properties]
    return scholars.where(F.col(id_column).isNotNull()).join(found, id_column, "left").select(
        *kept,
        *[
            (F.coalesce(f"found_{name}", name) if name in scholars.columns else F.col(f"found_{name}")).alias(name)
            for name in properties
        ],
    )
