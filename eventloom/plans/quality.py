"""Queries: ratings, checks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.fixed_values import SIGNATURE
from eventloom.operators import quality as q
from eventloom.plans import proxies as p
from eventloom.plans.cleaning import text
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


@query(
    "r1_rate_all",
    with_proxies(
        "event_orders",
        """, h AS (SELECT *, CASE WHEN acronym IS NULL THEN 'acronym' WHEN city IS NULL THEN 'city' WHEN ordinal IS NULL THEN 'ordinal'
    WHEN title IS NULL THEN 'title' END AS gap, CASE WHEN ordinal < 1 THEN 'ordinal' END AS bad FROM event_orders)
SELECT CASE WHEN gap IS NOT NULL THEN 7 WHEN bad IS NOT NULL THEN 5 ELSE 0 END AS pain,
  CASE WHEN gap IS NOT NULL THEN 'missing' WHEN bad IS NOT NULL THEN 'invalid' ELSE 'ok' END AS reason, coalesce(gap, bad, '') AS hint,
  'event' AS "entityType", eventId AS "entityId", source FROM h""",
    ),
)
def rate_all(t: Tables):
    return q.rate(p.event_orders(t), SIGNATURE, "event", "eventId")


@query(
    "r2_title_check",
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '' END AS title, CASE WHEN o_orderkey % 5 = 4 THEN 'missing' ELSE 'empty' END AS reason
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 IN (3, 4)""",
)
def title_check(t: Tables):
    n = F.col("o_orderkey")
    rows = t.orders.select(
        n.alias("key"),
        F.when(n % 2 == 0, "proceedings").otherwise("article").alias("kind"),
        F.when(n % 5 == 3, "").when(n % 5 != 4, F.concat(F.lit("Days "), text(n))).alias("title"),
    )
    return q.title_check(rows, "proceedings").select("key", "title", "reason")


@query(
    "u1_upsert",
    """WITH up AS (SELECT CASE WHEN event_id % 10 = 9 THEN NULL ELSE 'C' || (user_id * 2) END AS acronym, event_id AS pos,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS segment, CAST(year(ts) AS INTEGER) AS year, event_id % 3 > 0 AS has_year FROM events),
  u AS (SELECT acronym, arg_max(struct_pack(v := segment), pos) AS seg,
    arg_max(struct_pack(v := year), pos) FILTER (WHERE has_year) AS yr FROM up WHERE acronym IS NOT NULL GROUP BY 1),
  s AS (SELECT 'C' || c_custkey AS acronym, c_name AS title, c_mktsegment AS segment FROM customer)
SELECT coalesce(s.acronym, u.acronym) AS acronym, s.title, CASE WHEN u.acronym IS NOT NULL THEN u.seg.v ELSE s.segment END AS segment, u.yr.v AS year
FROM s FULL JOIN u ON s.acronym = u.acronym""",
)
def upsert(t: Tables):
    n = F.col("event_id")
    updates = t.events.select(
        F.when(n % 10 != 9, F.concat(F.lit("C"), text(F.col("user_id") * 2))).alias("acronym"),
        n.alias("position"),
        F.when(n % 4 != 0, F.col("event_type")).alias("segment"),
        F.year("ts").alias("year"),
        F.when(n % 3 > 0, F.array(F.lit("segment"), F.lit("year"))).otherwise(F.array(F.lit("segment"))).alias("present"),
    )
    return q.upsert(p.series_orders(t), updates, "acronym", "position", "present")


@query(
    "u2_ids_lookup",
    with_proxies("event_orders", "SELECT eventId, title, count(*) OVER (PARTITION BY title) AS duplicates FROM event_orders"),
)
def ids_lookup(t: Tables):
    return q.with_duplicate_count(p.event_orders(t).select("eventId", "title"), "title")


@query(
    "u2_first_by_key",
    "SELECT 'U' || user_id AS series, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def first_by_key(t: Tables):
    rows = t.events.select(F.concat(F.lit("U"), text("user_id")).alias("series"), "event_id", "event_type")
    return q.first_by_key(rows, "series", "event_id")
