"""Queries: location texts to places."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import locations
from eventloom.plans import proxies as p
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family
from eventloom.session import stage

FAMILY = Family()
query = FAMILY.query


def cities(t: Tables):
    n = F.col("n_nationkey")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        n.alias("pos"),
        F.col("n_name").alias("city"),
        F.when(n % 3 == 0, None).otherwise(F.concat(F.lit("State "), n.cast("string"))).alias("region"),
        F.when(n % 3 == 0, None).otherwise(F.concat(F.lit("S"), n.cast("string"))).alias("regionCode"),
        F.col("r_name").alias("country"),
        F.substring("r_name", 1, 2).alias("countryCode"),
        F.concat(F.lit("Q"), n.cast("string")).alias("id"),
    )


def fixed_terms(t: Tables):
    """Bare names are known; one of five names no place."""
    n = F.col("n_nationkey")
    return t.nation.select(
        F.col("n_name").alias("text"), F.when(n % 5 != 0, F.concat(F.lit("Q"), n.cast("string"))).alias("id")
    )


_TERMS = """WITH c AS (SELECT n_nationkey AS n, n_name AS c, r_name AS y, substr(r_name, 1, 2) AS m, 'Q' || n_nationkey AS id,
    CASE WHEN n_nationkey % 3 > 0 THEN 'State ' || n_nationkey END AS r, CASE WHEN n_nationkey % 3 > 0 THEN 'S' || n_nationkey END AS k
    FROM nation JOIN region ON n_regionkey = r_regionkey),
  x AS (SELECT id, unnest([c || ', ' || y, c || ', ' || m, c || ', ' || r, c || ' ' || r, c || ', ' || k, c || ' ' || k,
    c || ', ' || r || ', ' || y, c || ' ' || r || ' ' || y || c || ', ' || r || ', ' || m, c || ' ' || r || ' ' || m,
    c || ', ' || k || ', ' || y, c || ' ' || k || ' ' || y, c || ', ' || k || ', ' || m, c || ' ' || k || ' ' || m]) AS text FROM c),
  terms AS (SELECT text, id FROM x WHERE text IS NOT NULL
    UNION ALL SELECT n_name, CASE WHEN n_nationkey % 5 <> 0 THEN 'Q' || n_nationkey END FROM nation)"""


@query("j11_gazetteer_terms", _TERMS + " SELECT text, id FROM terms")
def gazetteer_terms(t: Tables):
    return locations.gazetteer_terms(cities(t), fixed_terms(t))


def _resolver(t: Tables, wrong: int):
    """Answers for ``name region`` texts; every ``wrong``-th nation differs or is unknown."""
    n = F.col("n_nationkey")
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws(" ", "n_name", "r_name").alias("text"),
        F.when(n % wrong == 0, F.concat(F.lit("X"), n.cast("string")))
        .when(n % wrong != 1, F.concat(F.lit("Q"), n.cast("string"))).alias("id"),
    )


def _agreed(t: Tables):
    return locations.consensus(_resolver(t, 7), _resolver(t, 4))


_AGREED = """SELECT n_name || ' ' || r_name AS text, CASE WHEN n_nationkey % 7 = 1 THEN NULL
    WHEN n_nationkey % 4 = 1 THEN CASE WHEN n_nationkey % 7 = 0 THEN 'X' ELSE 'Q' END || n_nationkey
    WHEN (n_nationkey % 7 = 0) = (n_nationkey % 4 = 0) THEN CASE WHEN n_nationkey % 7 = 0 THEN 'X' ELSE 'Q' END || n_nationkey END AS id
  FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query("j12_lookup_consensus", _AGREED)
def lookup_consensus(t: Tables):
    return _agreed(t)


@query(
    "j10_location_enrich",
    _TERMS
    + f""", agreed AS ({_AGREED}), resolved AS (SELECT text, id FROM terms WHERE id IS NOT NULL
    UNION ALL SELECT text, id FROM agreed WHERE id IS NOT NULL AND text NOT IN (SELECT text FROM terms)),
  {p.SQL["event_orders"]}, {p.SQL["location_text"]}
SELECT e.eventId, e.location, c.id AS "cityWikidataid", c.c AS city, c.r AS region, c.y AS country, c.m AS "countryIso"
FROM location_text e LEFT JOIN (resolved t JOIN c USING (id)) ON t.text = e.location""",
)
def location_enrich(t: Tables):
    terms = stage(locations.resolve_terms(locations.gazetteer_terms(cities(t), fixed_terms(t)), _agreed(t)), "terms")
    places = cities(t).select("id", "city", "region", "country", F.col("countryCode").alias("countryIso"))
    return locations.enrich(p.location_text(t).select("eventId", "location"), "location", terms, places)


@query(
    "a2_location_counts",
    with_proxies("location_text", "SELECT location, count(*) AS count FROM location_text GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"),
)
def location_counts(t: Tables):
    from eventloom.operators.stats import most_common

    return most_common(p.location_text(t), "location", 50)
