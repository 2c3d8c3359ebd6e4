"""Queries: common views, lookup across sources and joins between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.fixed_values import COMMON_COLUMNS, WIKIDATA_ENTITY_PREFIX, YEAR_ORDINAL_COLUMNS
from eventloom.functions.text import lookup_acronym
from eventloom.operators import joins, views
from eventloom.plans import proxies as p
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query

_DUCK_LOOKUP = """CASE WHEN year IS NOT NULL AND NOT regexp_matches(acronym, '[0-9]{4}')
  THEN acronym || ' ' || year ELSE acronym END"""

# every source with its lookup acronym: the order events and one table per event type
_DUCK_CORPUS = f""", corpus AS (
  SELECT source, eventId, year, startDate, series, title, ordinal, city, country, NULL AS number, {_DUCK_LOOKUP}
    AS lookupAcronym FROM event_orders
  UNION ALL SELECT source, eventId, year, startDate, NULL, NULL, NULL, NULL, NULL, number,
    seriesId || ' ' || year FROM event_stream)"""


def corpus(t: Tables) -> views.Corpus:
    orders = p.event_orders(t)
    tables = {
        "event_orders": orders.withColumn(
            "lookupAcronym", lookup_acronym(F.col("acronym"), F.lit(None).cast("string"), F.col("year"))
        )
    }
    for kind in p.EVENT_TYPES:
        tables[f"event_{kind}"] = p.event_of_type(t, kind).withColumn(
            "lookupAcronym", lookup_acronym(F.col("seriesId"), F.lit(None).cast("string"), F.col("year"))
        )
    tables["eventseries_orders"] = p.series_orders(t)
    return tables


_SCORE = """CASE WHEN title IS NULL THEN 0.0::DOUBLE ELSE (CASE WHEN lower(title) LIKE '%proceeding%' THEN 1.0 ELSE 0.0 END
  + CASE WHEN lower(title) LIKE '%conference%' THEN 1.0 ELSE 0.0 END
  + CASE WHEN title LIKE '%volume 1%' THEN 1.0 WHEN title LIKE '%vol. 2%' THEN 0.5 ELSE 0.0 END + 0.5)::DOUBLE END"""


@query(
    "j9_event_series_lookup",
    with_proxies(
        "event_orders event_stream",
        _DUCK_CORPUS
        + f""", found AS (SELECT *, {_SCORE} AS score FROM corpus WHERE lookupAcronym LIKE '_5 %'),
  best AS (SELECT *, max(score) OVER (PARTITION BY source, year) AS top FROM found)
SELECT source, eventId, year, startDate, series, title, lookupAcronym FROM best WHERE source <> 'orders' OR score = top""",
    ),
)
def event_series_lookup(t: Tables):
    found = joins.event_series_lookup(corpus(t), "_5", reduce_sources=("orders",))
    return found.select("source", "eventId", "year", "startDate", "series", "title", "lookupAcronym")


@query(
    "o3_common_view",
    with_proxies("event_orders event_stream", _DUCK_CORPUS + " SELECT source, eventId, year, title, number, lookupAcronym FROM corpus"),
)
def common_view(t: Tables):
    return views.common_view(corpus(t)).select("source", "eventId", "year", "title", "number", "lookupAcronym")


@query(
    "o3_strict_view",
    with_proxies("event_orders event_stream", _DUCK_CORPUS + " SELECT source, eventId, year, startDate, lookupAcronym FROM corpus"),
)
def strict_view(t: Tables):
    return views.strict_view(corpus(t))


@query(
    "c3_column_survey",
    with_proxies(
        "event_orders event_stream series_orders",
        _DUCK_CORPUS + """, cells AS (
  SELECT 'event_' || source AS tableName, count(title) AS title, count(year) AS year, count(ordinal) AS ordinal,
    count(CASE WHEN CAST(eventId AS BIGINT) % 7 <> 0 THEN 1 END) AS acronym, count(lookupAcronym) AS lookupAcronym,
    count(city) AS city, count(country) AS country FROM corpus GROUP BY source
  UNION ALL SELECT 'eventseries_orders', count(title), NULL, NULL, count(acronym), NULL, NULL, NULL FROM series_orders)
SELECT name, CASE WHEN name IN ('year', 'ordinal') THEN 'int' ELSE 'string' END AS type, tableName, filled
FROM (UNPIVOT cells ON title, year, ordinal, acronym, lookupAcronym, city, country INTO NAME name VALUE filled)
WHERE tableName IN ('event_orders', 'eventseries_orders') OR name IN ('year', 'lookupAcronym')""",
    ),
)
def column_survey(t: Tables):
    return views.column_survey(corpus(t), [*COMMON_COLUMNS, *YEAR_ORDINAL_COLUMNS])


@query(
    "c4_source_infos",
    with_proxies(
        "event_orders event_stream",
        """, counts AS (SELECT source, count(*) AS events FROM event_orders GROUP BY 1
    UNION ALL SELECT source, count(*) FROM event_stream GROUP BY 1)
SELECT source AS lookupId, source AS title, events,
  CASE WHEN source = 'orders' THEN (SELECT count(*) FROM customer) ELSE 0 END AS series FROM counts""",
    ),
)
def source_infos(t: Tables):
    sources = [(s, s, s, None, s, None) for s in ["orders", *p.EVENT_TYPES]]
    return views.source_infos(corpus(t), sources).select("lookupId", "title", "events", "series")


@query(
    "j8_multi_query",
    with_proxies("event_stream", "SELECT eventId, year, number, source FROM event_stream WHERE number > 50 AND year IS NOT NULL"),
)
def multi_query(t: Tables):
    # the order events have no number: the text cannot run there, so that source is left out
    results = views.multi_query("SELECT eventId, year, number FROM {event} WHERE number > 50 AND year IS NOT NULL", corpus(t))
    return views.with_source(results)


@query(
    "j7_id_restriction",
    with_proxies(
        "event_orders event_stream",
        _DUCK_CORPUS + """, ids AS (SELECT DISTINCT source, eventId FROM corpus WHERE ordinal >= 3 OR number < 20)
SELECT c.source, c.eventId, c.year, c.lookupAcronym FROM corpus c
  WHERE EXISTS (SELECT 1 FROM ids i WHERE i.source = c.source AND i.eventId = c.eventId)""",
    ),
)
def id_restriction(t: Tables):
    view = views.common_view(corpus(t))
    ids = view.where("ordinal >= 3 OR number < 20").select("source", "eventId").distinct()
    return views.restrict_to_ids(view, ids).select("source", "eventId", "year", "lookupAcronym")


@query(
    "p15_lookup_acronym",
    with_proxies("event_orders event_stream", _DUCK_CORPUS + " SELECT source, lookupAcronym, count(*) AS n FROM corpus GROUP BY ALL"),
)
def lookup_acronyms(t: Tables):
    return views.common_view(corpus(t)).groupBy("source", "lookupAcronym").agg(F.count("*").alias("n"))


@query(
    "j1_link_series",
    with_proxies(
        "event_orders event_stream series_orders",
        """, e AS (SELECT series AS acronym FROM event_orders UNION ALL SELECT seriesId FROM event_stream)
SELECT acronym, count(*) AS eventCount, bool_or(acronym IN (SELECT acronym FROM series_orders)) AS linked
FROM e GROUP BY acronym""",
    ),
)
def link_series(t: Tables):
    view = views.common_view(corpus(t)).withColumn("series", F.coalesce("series", "seriesId"))
    return joins.link_series(view, p.series_orders(t), "series")


@query(
    "j1_unmatched_series",
    with_proxies("event_stream", "SELECT DISTINCT seriesId AS acronym FROM event_stream WHERE seriesId NOT IN (SELECT 'C' || c_custkey FROM customer)"),
)
def unmatched_series(t: Tables):
    return joins.unmatched_series(p.event_stream(t), p.series_orders(t), "seriesId")


@query(
    "j2_events_in_series",
    with_proxies("event_orders", "SELECT eventId, series, year, ordinal FROM event_orders WHERE series = 'C7'"),
)
def events_in_series(t: Tables):
    return joins.events_in_series(p.event_orders(t), "series", "C7").select("eventId", "series", "year", "ordinal")


@query(
    "j3_doi_match",
    with_proxies(
        "event_orders proceedings",
        """SELECT '10.1/' || e.eventId AS doi, e.eventId, strftime(e.startDate, '%Y-%m-%d') AS startDate,
  strftime(e.endDate, '%Y-%m-%d') AS endDate, r.ppn AS right_ppn FROM event_orders e JOIN proceedings r ON r.orderId = e.eventId""",
    ),
)
def doi_match(t: Tables):
    left = p.event_orders(t).select(F.concat(F.lit("10.1/"), "eventId").alias("doi"), "eventId", "startDate", "endDate")
    return joins.doi_match(left, p.proceedings(t).select("doi", "ppn"))


@query(
    "j4_place_and_date_match",
    with_proxies(
        "event_orders",
        """SELECT DISTINCT l.eventId AS leftId, r.nation AS cityId, r.city, strftime(l.startDate, '%Y-%m-%d') AS startDate,
  strftime(l.endDate, '%Y-%m-%d') AS endDate, substr(l.title, 1, 40) AS leftTitle, substr(r.title, 1, 40) AS rightTitle,
  '10.1/' || r.eventId AS doi
FROM event_orders l JOIN event_orders r ON l.startDate = r.startDate AND l.endDate = r.endDate AND l.nation = r.nation
WHERE l.country IS NOT NULL AND r.country IS NOT NULL""",
    ),
)
def place_and_date_match(t: Tables):
    e = p.event_orders(t)
    left = e.select("eventId", "startDate", "endDate", "title", F.col("country").alias("countryId"),
                    F.concat(F.lit(WIKIDATA_ENTITY_PREFIX), "nation").alias("cityId"))
    right = e.select("startDate", "endDate", "title", "country", "city", F.col("nation").alias("cityWikidataid"),
                     F.concat(F.lit("10.1/"), "eventId").alias("doi"))
    return joins.place_and_date_match(left, right, WIKIDATA_ENTITY_PREFIX)


@query(
    "j5_series_events",
    with_proxies(
        "event_orders series_orders",
        """SELECT s.acronym AS series, s.title AS seriesTitle, e.eventId, e.acronym AS eventAcronym
FROM series_orders s JOIN event_orders e ON e.series = s.acronym""",
    ),
)
def series_events(t: Tables):
    return joins.series_events(p.series_orders(t), p.event_orders(t), "series")


@query(
    "j6_series_max_ordinal",
    with_proxies(
        "event_orders series_orders",
        """SELECT s.acronym, s.title, max(e.ordinal) AS maxOrdinal FROM event_orders e JOIN series_orders s
ON e.series = s.acronym WHERE e.ordinal IS NOT NULL GROUP BY s.acronym, s.title HAVING max(e.ordinal) <> 0""",
    ),
)
def series_max_ordinal(t: Tables):
    return joins.series_max_ordinal(p.event_orders(t), p.series_orders(t), "series")


@query(
    "j13_cross_source_series",
    """WITH l AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'U' || user_id END AS acronym,
    user_id AS id FROM events),
  j AS (SELECT l.acronym, id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AS known FROM l)
SELECT count(*) AS total, CAST(count_if(known) AS BIGINT) AS found, CAST(count_if(NOT known) AS BIGINT) AS notFound,
  round(avg(CASE WHEN known THEN 1.0 ELSE 0.0 END), 6) AS linkedShare,
  round(avg(CASE WHEN acronym IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS acronymShare FROM j""",
)
def cross_source_series(t: Tables):
    left = t.events.select(
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("acronym"),
        F.concat(F.lit("conf/"), F.col("user_id").cast("string")).alias("id"),
    ).distinct()
    right = t.customer.select(F.when(F.col("c_nationkey") < 20, F.col("c_custkey").cast("string")).alias("id"))
    return joins.cross_source_series(left, right, "conf/")


@query(
    "j14_catalogue_to_wiki",
    with_proxies(
        "event_orders",
        """, hit AS (SELECT w.eventId AS pageTitle, c.o_orderkey AS ppn FROM orders c JOIN event_orders w
  ON 'C' || c.o_custkey = w.series AND year(c.o_orderdate) - 1994 = w.ordinal)
SELECT pageTitle, CAST(ppn AS VARCHAR) AS ppn, count(*) OVER (PARTITION BY pageTitle) AS idCount,
  count(*) OVER (PARTITION BY pageTitle) > 1 AS ambiguous FROM hit""",
    ),
)
def catalogue_to_wiki(t: Tables):
    catalogue = t.orders.select(
        F.col("o_orderkey").cast("string").alias("ppn"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" ; meeting ; "),
                 (F.year("o_orderdate") - 1994).cast("string")).alias("event"),
    )
    return joins.catalogue_to_wiki(catalogue, p.event_orders(t).withColumnRenamed("eventId", "pageTitle"))


@query(
    "j16_scholar_enrich",
    """WITH v AS (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS o FROM lineitem),
  g AS (SELECT l_orderkey, string_agg(o, '|' ORDER BY o) AS dblpId FROM v GROUP BY 1)
SELECT 'Q' || o_orderkey AS wikiDataId, o_orderpriority AS name, coalesce(dblpId, 'none') AS "dblpId",
  CAST(o_custkey AS VARCHAR) AS "gndId", CASE WHEN o_orderstatus = 'F' THEN 'http://x/' || o_orderkey END AS homepage
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
)
def scholar_enrich(t: Tables):
    scholar = F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))
    scholars = t.orders.select(scholar.alias("wikiDataId"), F.col("o_orderpriority").alias("name"), F.lit("none").alias("dblpId"))
    facts = t.lineitem.select(
        F.concat(F.lit("Q"), F.col("l_orderkey").cast("string")).alias("s"), F.lit("dblpId").alias("p"),
        F.col("l_suppkey").cast("string").alias("o"),
    ).unionByName(
        t.orders.select(scholar.alias("s"), F.lit("gndId").alias("p"), F.col("o_custkey").cast("string").alias("o"))
    ).unionByName(
        t.orders.select(
            scholar.alias("s"), F.lit("homepage").alias("p"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("http://x/"), F.col("o_orderkey").cast("string"))).alias("o"))
    )
    return joins.scholar_enrich(scholars, facts, ["dblpId", "gndId", "homepage"], "wikiDataId")


@query(
    "j17_match_candidates",
    """WITH w AS (SELECT DISTINCT o_orderkey AS k, unnest(string_split(lower('C' || o_custkey || ' meeting, C' ||
    (o_orderkey % 1000)), ' ')) AS raw FROM orders),
  words AS (SELECT DISTINCT k, replace(raw, ',', '') AS word FROM w)
SELECT CAST(k AS VARCHAR) AS recordId, 'C' || c_custkey AS seriesAcronym FROM words JOIN customer
  ON word = lower('C' || c_custkey)""",
)
def match_candidates(t: Tables):
    key = F.col("o_orderkey")
    records = t.orders.select(
        key.cast("string").alias("recordId"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" meeting,")).alias("title"),
        F.concat(F.lit("C"), (key % 1000).cast("string")).alias("acronym"),
    )
    return joins.match_candidates(records, p.series_orders(t), ["title", "acronym"], "recordId")
