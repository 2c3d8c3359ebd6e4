"""Queries: duplicates in and completion of event series."""

from __future__ import annotations

from eventloom.operators import series as s
from eventloom.plans import proxies as p
from eventloom.plans.lookup import _SCORE
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query

_PAIRS = """, pairs AS (SELECT DISTINCT series, year, ordinal FROM event_orders WHERE year IS NOT NULL AND ordinal IS NOT NULL),
  rising AS (SELECT * FROM (SELECT *, max(ordinal) OVER (PARTITION BY series ORDER BY year, ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pairs) WHERE top IS NULL OR ordinal > top),
  steps AS (SELECT *, year - lag(year) OVER w AS dy, ordinal - lag(ordinal) OVER w AS dn FROM rising
    WINDOW w AS (PARTITION BY series ORDER BY year, ordinal)),
  sums AS (SELECT series, count(*) AS n, min(dy) AS gap, min(dy / dn) AS lo, max(dy / dn) AS hi, max(year) AS last_year,
    arg_max(ordinal, year) AS last_ordinal FROM steps GROUP BY 1),
  done AS (SELECT series, CAST(last_year - lo * (last_ordinal - i) AS INTEGER) AS year, CAST(i AS INTEGER) AS ordinal FROM
    (SELECT *, unnest(generate_series(1, last_ordinal)) AS i FROM sums WHERE n > 1 AND gap > 0 AND lo = hi AND lo = floor(lo)))"""


@query(
    "d1_dedup_by_title",
    with_proxies(
        "event_orders",
        f""", sc AS (SELECT *, {_SCORE} AS score FROM event_orders),
  b AS (SELECT *, max(score) OVER (PARTITION BY series, year) AS top FROM sc)
SELECT eventId, series, year, title FROM b WHERE score = top""",
    ),
)
def dedup_by_title(t: Tables):
    return s.dedup_by_title(p.event_orders(t), ["series"]).select("eventId", "series", "year", "title")


@query(
    "d1_dedup_whole_source",
    with_proxies(
        "event_orders",
        f""", sc AS (SELECT *, {_SCORE} AS score FROM event_orders),
  b AS (SELECT *, max(score) OVER (PARTITION BY year) AS top FROM sc) SELECT eventId, year, title FROM b WHERE score = top""",
    ),
)
def dedup_whole_source(t: Tables):
    return s.dedup_by_title(p.event_orders(t), []).select("eventId", "year", "title")


@query("d2_complete_series", with_proxies("event_orders", _PAIRS + " SELECT series, year, ordinal FROM done"))
def complete_series(t: Tables):
    return s.complete_series(p.event_orders(t), ["series"])


@query(
    "d3_series_frequency",
    with_proxies(
        "event_orders",
        _PAIRS
        + """, st AS (SELECT *, year - lag(year) OVER w AS dy, ordinal - lag(ordinal) OVER w AS dn FROM pairs
    WINDOW w AS (PARTITION BY series ORDER BY year, ordinal))
SELECT series, CAST(CASE WHEN count(*) > 1 AND min(dn) > 0 AND min(dy / nullif(dn, 0)) = max(dy / nullif(dn, 0))
  AND min(dy / nullif(dn, 0)) = floor(min(dy / nullif(dn, 0))) THEN min(dy / nullif(dn, 0)) ELSE 0 END AS INTEGER) AS frequency
FROM st GROUP BY 1""",
    ),
)
def series_frequency(t: Tables):
    return s.series_frequency(s.year_ordinal_pairs(p.event_orders(t), ["series"]), ["series"])


@query(
    "d4_event_sheet",
    with_proxies(
        "event_orders",
        _PAIRS
        + " SELECT "
        + ", ".join(
            {"Ordinal": "d.ordinal", "Year": "d.year", "Series": "g.series"}.get(c, "NULL") + f' AS "{c}"' for c in s.EVENT_SHEET
        )
        + " FROM (SELECT DISTINCT series FROM event_orders) g LEFT JOIN done d ON d.series = g.series",
    ),
)
def event_sheet(t: Tables):
    return s.event_sheet(p.event_orders(t), ["series"])


@query(
    "d4_proceedings_sheet",
    with_proxies(
        "event_orders",
        _PAIRS
        + " SELECT "
        + ", ".join(("d.ordinal" if c == "ordinal" else "NULL") + f' AS "{c}"' for c in s.PROCEEDINGS_SHEET)
        + " FROM (SELECT DISTINCT series FROM event_orders) g LEFT JOIN done d ON d.series = g.series",
    ),
)
def proceedings_sheet(t: Tables):
    return s.proceedings_sheet(p.event_orders(t), ["series"])


@query(
    "d4_source_sheet",
    with_proxies("event_orders", "SELECT eventId, series, year, ordinal, title FROM event_orders"),
)
def source_sheet(t: Tables):
    return s.source_sheet(p.event_orders(t).select("eventId", "series", "year", "ordinal", "title"))


@query(
    "d5_dup_profile",
    with_proxies(
        "event_orders",
        f""", sc AS (SELECT *, {_SCORE} AS score FROM event_orders),
  b AS (SELECT *, max(score) OVER (PARTITION BY series, year) AS top,
    count(*) OVER (PARTITION BY series, ordinal) AS same FROM sc)
SELECT series, count(*) AS records, count(DISTINCT ordinal) AS ordinals,
  count(DISTINCT CASE WHEN same > 1 THEN ordinal END) AS "repeatedOrdinals", count(DISTINCT year) AS years,
  count(*) FILTER (WHERE lower(title) LIKE '%proceeding%') AS "proceedingsCount",
  count(*) FILTER (WHERE title LIKE '%volume 1%' OR title LIKE '%vol. 2%') AS "volumeCount",
  count(*) FILTER (WHERE score = top) AS "afterDedup" FROM b GROUP BY 1""",
    ),
)
def dup_profile(t: Tables):
    return s.duplicate_profile(p.event_orders(t), ["series"])
