"""Queries: numbering, coverage, sampling and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import ranking
from eventloom.plans import proxies as p
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


@query(
    "w1_row_number",
    with_proxies(
        "event_orders",
        """SELECT row_number() OVER (ORDER BY ordinal, acronym, eventId) AS "rowNumber", ordinal, acronym, eventId, year
FROM event_orders WHERE acronym IS NOT NULL AND ordinal IS NOT NULL AND acronym ILIKE 'c1%'""",
    ),
)
def row_number(t: Tables):
    wanted = p.event_orders(t).where("acronym IS NOT NULL AND ordinal IS NOT NULL AND acronym ILIKE 'c1%'")
    order = [F.asc("ordinal"), F.asc("acronym"), F.asc("eventId")]
    return ranking.global_running(wanted.select("ordinal", "acronym", "eventId", "year"), order)


@query(
    "w2_row_number_over_agg",
    with_proxies(
        "proceedings",
        """SELECT row_number() OVER (ORDER BY count(*) DESC, substr(bk, 1, 2) NULLS FIRST) AS "rowNumber", count(*) AS n,
  substr(bk, 1, 2) AS bk2 FROM proceedings GROUP BY substr(bk, 1, 2) HAVING count(*) >= 100""",
    ),
)
def row_number_over_agg(t: Tables):
    counts = (
        p.proceedings(t).groupBy(F.substring("bk", 1, 2).alias("bk2")).agg(F.count("*").alias("n"))
    )
    return ranking.global_running(counts.where("n >= 100"), [F.desc("n"), F.asc("bk2")])


@query(
    "w3_coverage_cut",
    with_proxies(
        "location_text",
        """, c AS (SELECT location, count(*) AS n FROM location_text GROUP BY 1),
  r AS (SELECT *, row_number() OVER o AS i, sum(n) OVER o AS upto, sum(n) OVER () AS total FROM c
    WINDOW o AS (ORDER BY n DESC, location))
SELECT i AS "rowNumber", location, n, round(upto * 100.0 / total, 6) AS "coveredPercent" FROM r
WHERE (upto - n) * 100.0 <= 60 * total""",
    ),
)
def coverage_cut(t: Tables):
    return ranking.coverage_cut(p.location_text(t), "location", 60.0)


@query(
    "w4_sample_per_kind",
    """WITH k AS (SELECT event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'conf/' ELSE 'journals/' END ||
    lpad(CAST(event_id AS VARCHAR), 12, '0') AS key FROM events),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY key) AS INTEGER) AS number FROM k
    WHERE kind IN ('click', 'error') OR (kind IN ('view', 'signup') AND key LIKE 'conf/%'))
SELECT kind, key, number FROM n WHERE number <= 25""",
)
def sample_per_kind(t: Tables):
    key = F.concat(
        F.when(F.col("event_id") % 2 == 0, "conf/").otherwise("journals/"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    )
    records = t.events.select(F.col("event_type").alias("kind"), key.alias("key"))
    return ranking.sample_per_kind(records, "kind", "key", 25, ["view", "signup"], ["click", "error"], "conf/")


@query(
    "o1_order_limit",
    with_proxies("event_orders", "SELECT eventId, series, startDate FROM event_orders ORDER BY startDate DESC, CAST(eventId AS BIGINT) LIMIT 50"),
)
def order_limit(t: Tables):
    newest = p.event_orders(t).orderBy(F.desc("startDate"), F.col("eventId").cast("long"))
    return newest.limit(50).select("eventId", "series", "startDate")


@query(
    "p20_predicates",
    with_proxies(
        "event_orders",
        """SELECT eventId, title, year, ordinal FROM event_orders WHERE title ILIKE '%PROCEEDINGS%' AND ordinal > 2
  AND ordinal < 7 AND series <> 'C3' AND year IN (1996, 1997, 1999) AND acronym IS NOT NULL""",
    ),
)
def predicates(t: Tables):
    # LIKE of the queries ignores case; parameters are bound, not pasted into the text
    return t.spark.sql(
        """SELECT eventId, title, year, ordinal FROM {events} WHERE title ILIKE :title AND ordinal > :low
  AND ordinal < :high AND series <> :series AND year IN (1996, 1997, 1999) AND acronym IS NOT NULL""",
        args={"title": "%PROCEEDINGS%", "low": 2, "high": 7, "series": "C3"},
        events=p.event_orders(t),
    )
