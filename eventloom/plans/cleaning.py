"""Queries: record cleaning, on raw records rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.fixed_values import EVENT_TEMPLATE_PROPERTIES, MATCH_ID_COLUMNS
from eventloom.functions.text import link
from eventloom.operators import cleaning as c
from eventloom.operators import joins
from eventloom.plans import proxies as p
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


def text(column):
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def day_span(start, end, suffix=""):
    """``3-5 May 1995``: the days of both dates in the month of the first."""
    return F.concat(text(F.dayofmonth(start)), F.lit("-"), text(F.dayofmonth(end)), F.lit(suffix), F.date_format(start, " MMMM yyyy"))


def raw_dblp(t: Tables):
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")
    conf = F.lower("series")
    return e.select(
        F.when(n % 4 < 3, F.concat_ws("/", F.lit("conf"), conf, "eventId")).otherwise(F.concat(F.lit("journals/x/"), "eventId")).alias("key"),
        F.concat(F.lit("2nd Conference of "), "series", F.lit(", "), "nation", F.lit(", "), "country", F.lit(", "),
                 F.when(n % 3 == 0, text("year")).when(n % 3 == 1, day_span("startDate", "endDate")).otherwise("no date")).alias("title"),
        F.when(n % 10 == 0, "unknown").otherwise(text("year")).alias("year"),
        F.when(n % 6 != 0, F.col("series")).alias("booktitle"),
        F.concat(F.lit("db/"), "eventId", F.lit(".html")).alias("url"),
        F.when(n % 5 == 0, "https://x.org/a")
        .otherwise(F.concat(F.lit("https://doi.org/10.1/a,https://doi.org/10.1/"), "eventId", F.lit(",https://x.org"))).alias("ee"),
        F.lit(None).cast("string").alias("isbn"),
        text("startDate").alias("mdate"),
    )


@query(
    "p1_clean_dblp",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n, day(startDate) <= 30 AND day(endDate) <= least(30, day(last_day(startDate)))
    AS ok FROM event_orders),
  y AS (SELECT *, CASE WHEN n % 3 = 1 AND ok THEN year WHEN n % 10 <> 0 THEN year END AS cy FROM b)
SELECT CASE WHEN n % 4 < 3 THEN 'conf/' || lower(series) || '/' || eventId ELSE 'journals/x/' || eventId END AS "eventId",
  'dblp' AS source, CASE WHEN n % 4 < 3 THEN lower(series) END AS series, cy AS year, 2 AS ordinal,
  CASE WHEN n % 6 <> 0 AND cy IS NOT NULL THEN series || ' ' || cy END AS acronym,
  CASE WHEN n % 3 = 1 AND ok THEN startDate END AS "startDate", CASE WHEN n % 3 = 1 AND ok THEN make_date(year, month(startDate), day(endDate)) END AS "endDate",
  'https://dblp.org/db/' || eventId || '.html' AS url, CASE WHEN n % 5 <> 0 THEN '10.1/' || eventId END AS doi FROM y""",
    ),
)
def clean_dblp(t: Tables):
    return c.clean_dblp(raw_dblp(t)).select(
        "eventId", "source", "series", "year", "ordinal", "acronym", "startDate", "endDate", "url", "doi"
    )


def raw_crossref(t: Tables):
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")

    def parts(day):
        full = F.array(F.year(day), F.month(day), F.dayofmonth(day))
        return F.struct(F.array(F.when(n % 3 == 0, full).when(n % 3 == 1, F.slice(full, 1, 2)).otherwise(F.slice(full, 1, 1))).alias("date-parts"))

    return e.select(
        F.struct(
            F.concat(F.lit('Tagung M\\"unster '), "series").alias("name"),
            F.col("nation").alias("location"),
            "acronym",
            F.lit(None).cast("string").alias("number"),
            F.lit("a\\b&#x0D;").alias("theme"),
            parts("startDate").alias("start"),
            parts("endDate").alias("end"),
        ).alias("event"),
        F.array(F.concat(F.lit('Third K\\"oln Days of '), "series")).alias("title"),
        F.when(n % 2 == 0, F.array("country", "nation")).alias("sponsor"),
        F.concat(F.lit("10.1/"), "eventId").alias("DOI"),
    )


@query(
    "p2_clean_crossref",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n FROM event_orders)
SELECT '10.1/' || eventId AS "eventId", 'Tagung Münster ' || series AS name, 'a b' AS theme, 'Third Köln Days of ' || series AS title,
  3 AS ordinal, acronym, CASE WHEN n % 2 = 0 THEN country END AS sponsor, year, CASE WHEN n % 3 < 2 THEN CAST(month(startDate) AS INTEGER) END AS month,
  CASE WHEN n % 3 = 0 THEN startDate END AS "startDate", CASE WHEN n % 3 = 0 THEN endDate END AS "endDate",
  'https://api.crossref.org/v1/works/10.1/' || eventId AS url FROM b""",
    ),
)
def clean_crossref(t: Tables):
    return c.clean_crossref(raw_crossref(t)).select(
        "eventId", "name", "theme", "title", "ordinal", "acronym", "sponsor", "year", "month", "startDate", "endDate", "url"
    )


def raw_confref(t: Tables):
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")
    null = F.lit(None).cast("string")
    return e.select(
        F.col("eventId").alias("id"),
        F.concat("series", F.lit(" &amp; friends")).alias("name"),
        text("ordinal").alias("number"),
        "city",
        "country",
        text("year").alias("year"),
        F.when(n % 3 == 0, F.struct(F.lit("R&amp;D").alias("value"))).alias("area"),
        F.struct(
            F.lower("series").alias("id"), null.alias("issn"), null.alias("eissn"),
            F.when(n % 2 == 0, F.concat(F.lit("https://dblp.org/db/conf/"), F.lower("series"), F.lit("/"))).otherwise(F.col("series")).alias("dblpId"),
            F.lit("B&uuml;ro").alias("name"), null.alias("description"),
        ).alias("confSeries"),
    )


@query(
    "p3_clean_confref",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n FROM event_orders)
SELECT "eventId", 'http://portal.confref.org/list/' || eventId AS url, series || ' & friends' AS title, ordinal, year,
  CASE WHEN n % 3 = 0 THEN 'R&D' END AS area, CASE WHEN n % 2 = 0 THEN 'conf/' || lower(series) ELSE series END AS "dblpSeriesId",
  lower(series) AS "seriesId", 'Büro' AS "seriesTitle", city || ',' || country AS location FROM b""",
    ),
)
def clean_confref(t: Tables):
    return c.clean_confref(raw_confref(t)).select(
        "eventId", "url", "title", "ordinal", "year", "area", "dblpSeriesId", "seriesId", "seriesTitle", "location"
    )


def raw_wikicfp(t: Tables):
    n = F.col("event_id")
    return t.events.select(
        text(n).alias("eventId"),
        (n % 11 == 0).alias("deleted"),
        F.when(n % 13 == 0, "1 spam street").when(n % 17 != 0, F.col("event_type")).alias("locality"),
        F.when(n % 19 == 0, "WikiCFP : Call For Papers of Conferences, Workshops and Journals 2024")
        .when(n % 23 != 0, F.concat(F.lit("Call "), text(n))).alias("title"),
        F.when(n % 7 != 0, F.to_date("ts")).alias("startDate"),
        F.when(n % 7 == 0, 2023).cast("int").alias("year"),
    )


@query(
    "p4_clean_wikicfp",
    """SELECT CAST(event_id AS VARCHAR) AS "eventId", 'http://www.wikicfp.com/cfp/servlet/event.showcfp?eventid=' || event_id AS url,
  CASE WHEN event_id % 7 = 0 THEN 2023 ELSE CAST(year(ts) AS INTEGER) END AS year,
  CASE WHEN event_id % 23 <> 0 THEN 'Call ' || event_id END AS title,
  CASE WHEN event_id % 17 <> 0 THEN event_type END AS locality FROM events
WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 19 <> 0""",
)
def clean_wikicfp(t: Tables):
    return c.clean_wikicfp(raw_wikicfp(t)).select("eventId", "url", "year", "title", "locality")


@query(
    "p5_clean_wikicfp_series",
    """SELECT CAST(c_custkey AS VARCHAR) AS "eventSeriesId", CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey END AS acronym,
  CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey || ': ' || c_name || CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END ELSE c_name END AS title
FROM customer""",
)
def clean_wikicfp_series(t: Tables):
    n = F.col("c_custkey")
    title = F.when(
        n % 2 == 0,
        F.concat(F.lit("C"), text(n), F.lit(": "), "c_name", F.when(n % 4 == 0, " 2022 2021 2020 ...").otherwise("")),
    ).otherwise(F.col("c_name"))
    raw = t.customer.select(text(n).alias("seriesId"), title.alias("title"))
    return c.clean_wikicfp_series(raw).select("eventSeriesId", "acronym", "title")


@query(
    "p6_clean_wikidata",
    with_proxies(
        "event_orders",
        """SELECT 'Q' || eventId AS "eventId", nation AS "countryId", series AS "eventInSeriesId", year,
  CASE WHEN CAST(eventId AS BIGINT) % 3 > 0 THEN ordinal END AS ordinal FROM event_orders""",
    ),
)
def clean_wikidata(t: Tables):
    e = p.event_orders(t)
    entity = F.lit("http://www.wikidata.org/entity/")
    raw = e.select(
        F.concat(entity, F.lit("Q"), "eventId").alias("eventId"), F.concat(entity, "nation").alias("countryId"),
        F.concat(entity, "series").alias("eventInSeriesId"), "startDate",
        F.when(F.col("eventId").cast("long") % 3 == 0, "first").otherwise(text("ordinal")).alias("ordinal"),
    )
    return c.clean_wikidata(raw).select("eventId", "countryId", "eventInSeriesId", "year", "ordinal")


@query(
    "p7_clean_or",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n FROM event_orders)
SELECT series || ' ' || eventId || '/x' AS "eventId", 'http://wiki.example/index.php?title=' || series || '%20' || eventId || '/x' AS url,
  CASE WHEN n % 8 = 0 THEN 'in ' || year ELSE CAST(year AS VARCHAR) END AS "yearStr", CASE WHEN n % 8 <> 0 THEN year END AS year,
  CASE WHEN n % 5 < 3 THEN startDate END AS "startDate" FROM b""",
    ),
)
def clean_or(t: Tables):
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")
    start = (
        F.when(n % 5 == 0, F.date_format("startDate", "yyyy/MM/dd")).when(n % 5 == 1, F.date_format("startDate", "d MMMM yyyy"))
        .when(n % 5 == 2, text("startDate")).when(n % 5 == 3, "").otherwise("soon")
    )
    raw = e.select(
        F.concat("series", F.lit(" "), "eventId", F.lit("/x")).alias("pageTitle"), "title",
        F.when(n % 8 == 0, F.concat(F.lit("in "), text("year"))).otherwise(text("year")).alias("year"),
        start.alias("startDate"), start.alias("endDate"), text("ordinal").alias("ordinal"),
    )
    return c.clean_wiki_event(raw, "http://wiki.example").select("eventId", "url", "yearStr", "year", "startDate")


@query(
    "p8_clean_or_series",
    """SELECT 'C' || c_custkey AS "eventSeriesId", CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS INTEGER) END AS period FROM customer""",
)
def clean_or_series(t: Tables):
    n = F.col("c_custkey")
    raw = t.customer.select(
        F.concat(F.lit("C"), text(n)).alias("pageTitle"),
        F.when(n % 3 == 0, text("c_nationkey")).when(n % 3 == 1, "yearly").alias("period"),
    )
    return c.clean_wiki_series(raw).select("eventSeriesId", "period")


@query(
    "p9_clean_gnd",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n FROM event_orders)
SELECT "eventId", 'Days of ' || series AS title, CASE WHEN n % 3 = 0 THEN ordinal END AS ordinal, nation AS location,
  CASE WHEN n % 4 = 3 THEN year + 1 ELSE year END AS year, CASE WHEN n % 4 < 2 THEN startDate END AS "startDate",
  CASE WHEN n % 4 = 1 THEN endDate END AS "endDate", n % 4 = 3 AS "invalidDate" FROM b""",
    ),
)
def clean_gnd(t: Tables):
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")
    dotted = lambda d: F.date_format(d, "dd.MM.yyyy")
    head = F.when((n % 3 == 0) & F.col("ordinal").isNotNull(), F.concat(text("ordinal"), F.lit(". : "))).otherwise("")
    in_title = F.when(n % 4 == 3, F.col("year") + 1).otherwise(F.col("year"))
    raw = e.select(
        "eventId",
        F.concat(F.lit("Days of "), "series", F.lit(" ("), head, text(in_title), F.lit(" : "), "nation", F.lit(")")).alias("fulltitle"),
        F.when(n % 4 == 0, F.concat(dotted("startDate"), F.lit("-")))
        .when(n % 4 == 1, F.concat(dotted("startDate"), F.lit("-"), dotted("endDate")))
        .when(n % 4 == 3, "spring").alias("date"),
    )
    return c.clean_gnd(raw).select("eventId", "title", "ordinal", "location", "year", "startDate", "endDate", "invalidDate")


def raw_descriptions(t: Tables):
    """One or two descriptions per event; the second has a longer acronym."""
    e = p.event_orders(t)
    n = F.col("eventId").cast("long")
    until = F.when(F.month("startDate") == F.month("endDate"), F.date_format("endDate", "dd")).otherwise(F.date_format("endDate", "MM.dd"))
    place = F.concat(F.lit(" ; "), text("ordinal"), F.lit(" ("), "nation", F.lit(") : "), F.date_format("startDate", "yyyy.MM.dd"), F.lit("-"), until)
    first = F.concat(F.lit("Workshop on "), "nation", F.lit(" ("), "series", F.lit(")"), F.coalesce(place, F.lit(" ; none")))
    second = F.concat(F.lit("Long "), "series", F.coalesce(place, F.lit("")))
    return e.select("*", F.when(n % 2 == 0, F.array(first)).otherwise(F.array(second, first)).alias("description"))


@query(
    "p10_clean_tibkat",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n, year(startDate) = year(endDate) AND startDate <= endDate AS ok FROM event_orders)
SELECT "eventId", CASE WHEN n % 2 = 0 OR ordinal IS NOT NULL THEN series END AS acronym, ordinal,
  CASE WHEN ordinal IS NOT NULL THEN nation END AS location, CASE WHEN ordinal IS NOT NULL THEN year END AS year,
  CASE WHEN ordinal IS NOT NULL THEN startDate END AS "startDate",
  CASE WHEN ordinal IS NOT NULL THEN
    CASE WHEN month(startDate) = month(endDate) THEN endDate ELSE make_date(year(startDate), month(endDate), day(endDate)) END END AS "endDate"
FROM b""",
    ),
)
def clean_tibkat(t: Tables):
    raw = raw_descriptions(t).select(F.col("eventId").alias("ppn"), "description")
    return c.clean_tibkat(raw).select("eventId", "acronym", "ordinal", "location", "year", "startDate", "endDate")


@query("p11_bk_prefix_filter", with_proxies("proceedings", "SELECT ppn, bk FROM proceedings WHERE (bk LIKE '54%' OR bk LIKE '%⇹54%')"))
def bk_prefix_filter(t: Tables):
    from eventloom.functions.text import split_list

    return p.proceedings(t).where(c.wanted_classification(split_list(F.col("bk")), ["54"])).select("ppn", "bk")


@query(
    "p12_bk_filter",
    with_proxies(
        "proceedings",
        """SELECT ppn, bk FROM proceedings WHERE bk IS NULL OR list_has_any(list_transform(string_split(bk, '⇹'),
  lambda c: string_split(c, '.')[1]), ['51', '7']) OR list_has_any(string_split(bk, '⇹'), ['54.72'])""",
    ),
)
def bk_filter(t: Tables):
    return p.proceedings(t).where(joins.classification_filter(F.col("bk"), ["51", "7", "54.72", "null", "x1"])).select("ppn", "bk")


@query(
    "p13_rename_props",
    with_proxies("event_orders", 'SELECT acronym, series AS "inEventSeries", title, year, country, city FROM event_orders'),
)
def rename_props(t: Tables):
    raw = p.event_orders(t).select(
        F.col("acronym").alias("Acronym"), F.col("series").alias("Series"), F.col("title").alias("Title"),
        F.col("year").alias("Year"), F.col("country").alias("Country"), F.col("city").alias("City"), F.col("nation").alias("Unknown"),
    )
    return c.rename_properties(raw, EVENT_TEMPLATE_PROPERTIES)


_SOURCES = ["confref", "dblp", "tibkat", "wikicfp", "wikidata", "orclone"]


@query(
    "p14_normalize_ids",
    """WITH b AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS e, 'C' || o_custkey AS s, (['confref', 'dblp', 'tibkat', 'wikicfp',
    'wikidata', 'orclone'])[o_orderkey % 6 + 1] AS source, CASE WHEN o_custkey % 2 = 0 THEN 'conf/' ELSE '' END || o_custkey AS d FROM orders)
SELECT source, e AS "eventId", CASE WHEN source = 'confref' THEN e END AS "confrefId", CASE WHEN source = 'confref' THEN s END AS "confrefSeriesId",
  CASE source WHEN 'dblp' THEN e WHEN 'wikidata' THEN d WHEN 'orclone' THEN 'conf/' || o_custkey END AS "dblpConferenceId",
  CASE WHEN source = 'dblp' THEN 'conf/' || s END AS "dblpSeriesId", CASE WHEN source = 'tibkat' THEN e END AS "TibKatId",
  CASE WHEN source = 'tibkat' THEN 'g' || o_custkey END AS "gndId",
  CASE source WHEN 'wikicfp' THEN e WHEN 'wikidata' THEN 'w' || o_custkey END AS "wikicfpId",
  CASE WHEN source = 'wikicfp' THEN s END AS "seriesWikicfpId", CASE WHEN source = 'wikidata' THEN e END AS "wikidataId",
  CASE WHEN source = 'wikidata' THEN 'S' || o_custkey END AS "seriesWikidataId", CASE WHEN source = 'orclone' THEN e END AS "openresearchId",
  CASE WHEN source = 'orclone' THEN 'o' || o_custkey END AS "seriesOpenresearchId" FROM b""",
)
def normalize_ids(t: Tables):
    cust = text("o_custkey")
    records = t.orders.select(
        F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("source"),
        text("o_orderkey").alias("eventId"), F.concat(F.lit("C"), cust).alias("seriesId"),
        F.concat(F.when(F.col("o_custkey") % 2 == 0, "conf/").otherwise(""), cust).alias("dblpId"),
        F.concat(F.lit("g"), cust).alias("gndIds"), F.concat(F.lit("w"), cust).alias("wikiCfpId"),
        F.concat(F.lit("S"), cust).alias("eventInSeriesId"), F.concat(F.lit("o"), cust).alias("inEventSeries"),
    )
    return c.normalize_ids(records).select("source", "eventId", *MATCH_ID_COLUMNS)


@query(
    "p16_dblp_location",
    with_proxies("event_orders", "SELECT eventId, CASE WHEN CAST(eventId AS BIGINT) % 4 > 0 THEN nation || ', ' || country END AS location FROM event_orders"),
)
def dblp_location(t: Tables):
    short = F.col("eventId").cast("long") % 4 == 0
    title = F.concat(F.lit("Proceedings, "), "series", F.lit(", "), "nation", F.when(short, " ").otherwise(", "), "country")
    return p.event_orders(t).select("eventId", c.title_location(title).alias("location"))


@query(
    "p17_or_location",
    with_proxies("event_orders", "SELECT eventId, concat_ws(', ', city, nation, country) AS location FROM event_orders"),
)
def or_location(t: Tables):
    category = lambda column: F.concat(F.lit("Category:"), column)
    return p.event_orders(t).select("eventId", c.wiki_location(category(F.col("city")), F.col("nation"), category(F.col("country"))).alias("location"))


@query(
    "p18_link_format",
    with_proxies(
        "event_orders",
        """SELECT eventId, 'https://dblp.org/db/conf/' || series || '/index.html' AS series,
  CASE WHEN acronym IS NOT NULL THEN 'https://d-nb.info/standards/elementset/gnd#' || acronym END AS acronym FROM event_orders""",
    ),
)
def link_format(t: Tables):
    e = p.event_orders(t).select("eventId", "series", link(F.col("acronym"), "dblprec").alias("acronym"))
    raw = e.withColumn("acronym", F.replace("acronym", F.lit("https://dblp.org/rec/"), F.lit("https://d-nb.info/standards/elementset/gnd#")))
    return joins.format_links(raw, {"series": "dblpseries", "acronym": "dnbelement"})
