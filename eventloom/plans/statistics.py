"""Queries: counts, profiles, distributions and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.fixed_values import SIGNATURE
from eventloom.functions.text import leading_int
from eventloom.functions.titles import fulltitle
from eventloom.operators import stats, views
from eventloom.plans import proxies as p
from eventloom.plans.lookup import _DUCK_CORPUS, corpus
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


def _corpus_sql(body: str) -> str:
    return with_proxies("event_orders event_stream", _DUCK_CORPUS + body)


def _orders_sql(body: str) -> str:
    return with_proxies("event_orders", body)


@query("a1_source_counts", _corpus_sql(" SELECT source, count(*) AS count FROM corpus GROUP BY 1 UNION SELECT 'TOTAL', count(*) FROM corpus"))
def source_counts(t: Tables):
    return stats.source_counts(views.common_view(corpus(t)))


@query("a2_value_counts_country_year", _orders_sql("SELECT country, year, count(*) AS count FROM event_orders GROUP BY ALL"))
def country_year(t: Tables):
    return stats.value_counts(p.event_orders(t), "country", "year")


@query("a2_value_counts_codes", with_proxies("proceedings", "SELECT genreCode, typeCode, count(*) AS count FROM proceedings GROUP BY ALL"))
def codes(t: Tables):
    return stats.value_counts(p.proceedings(t), "genreCode", "typeCode")


@query(
    "a2_value_counts_first_of_list",
    with_proxies("proceedings", "SELECT substr(bk, 1, greatest(instr(bk, '⇹') - 1, 0)) AS firstCode, count(*) AS count FROM proceedings GROUP BY 1"),
)
def first_of_list(t: Tables):
    # text before the first separator, empty where the list has one entry
    first = F.when(F.instr("bk", "⇹") > 0, F.substring_index("bk", "⇹", 1)).when(F.col("bk").isNotNull(), "")
    return stats.value_counts(p.proceedings(t), first.alias("firstCode"))


@query("a2_value_counts_number", with_proxies("event_stream", "SELECT number, count(*) AS count FROM event_stream GROUP BY 1"))
def numbers(t: Tables):
    return stats.value_counts(p.event_stream(t), "number")


@query("a3_having_duplicates", _orders_sql("SELECT title, count(*) AS count FROM event_orders WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
def duplicates(t: Tables):
    return stats.repeated_values(p.event_orders(t), "title")


@query(
    "a3_number_usage",
    with_proxies(
        "event_stream",
        """, n AS (SELECT CASE WHEN number % 3 = 0 THEN 'x' ELSE '' END || number || CASE WHEN number % 2 = 0 THEN 'a' ELSE '' END AS number FROM event_stream)
SELECT number, coalesce(try_cast(nullif(regexp_extract(number, '^[0-9]+'), '') AS INTEGER), 0) AS enum, count(*) AS count
FROM n WHERE number IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def number_usage(t: Tables):
    # texts such as 44a count as 44, texts without a leading number as 0
    n = F.col("number")
    number = F.concat(F.when(n % 3 == 0, "x").otherwise(""), n.cast("string"), F.when(n % 2 == 0, "a").otherwise(""))
    repeated = stats.repeated_values(p.event_stream(t).select(number.alias("number")), "number")
    return repeated.withColumn("enum", leading_int(F.col("number")))


@query(
    "a4_series_span",
    _orders_sql("SELECT series, count(*) AS count, min(year) AS minYear, max(year) AS maxYear, min(title) AS title FROM event_orders GROUP BY 1"),
)
def series_span(t: Tables):
    return stats.series_span(p.event_orders(t), "series")


@query(
    "a5_non_null_profile",
    _corpus_sql(
        """ SELECT source, count(*) AS total, """
        + ", ".join(
            f'count({c}) AS "{c}Count", count({c}) * 100 // count(*) AS "{c}Percent"'
            for c in ["year", "ordinal", "city", "country", "title", "number"]
        )
        + " FROM corpus GROUP BY 1"
    ),
)
def non_null_profile(t: Tables):
    return stats.non_null_profile(views.common_view(corpus(t)), ["year", "ordinal", "city", "country", "title", "number"])


@query(
    "a6_signature_completeness",
    _orders_sql(
        "SELECT source, round(avg(CASE WHEN "
        + " AND ".join(f"{c} IS NOT NULL" for c in SIGNATURE)
        + " THEN 1.0 ELSE 0.0 END), 2) AS complete, "
        + ", ".join(f'round(avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END), 2) AS "{c}Share"' for c in SIGNATURE)
        + " FROM event_orders GROUP BY 1"
    ),
)
def signature_completeness(t: Tables):
    return stats.signature_completeness(p.event_orders(t))


_COMPLETENESS = """, c AS (SELECT series, min(ordinal) AS minOrdinal, max(ordinal) AS maxOrdinal,
    round(avg(ordinal), 6) AS avgOrdinal, max(ordinal) - min(ordinal) AS ordinalRange,
    round((max(ordinal) - min(ordinal)) / nullif(max(ordinal) - 1.0::DOUBLE, 0), 6) AS completeness
  FROM event_orders WHERE ordinal IS NOT NULL GROUP BY 1)"""


@query("a7_series_completeness", _orders_sql(_COMPLETENESS + " SELECT * FROM c"))
def series_completeness(t: Tables):
    return stats.series_completeness(p.event_orders(t), "series")


@query(
    "a7_median_threshold",
    _orders_sql(
        _COMPLETENESS
        + """, r AS (SELECT round(completeness, 2) AS v, row_number() OVER (ORDER BY round(completeness, 2)) AS i,
    count(*) OVER () AS n FROM c WHERE completeness IS NOT NULL)
SELECT v AS threshold FROM r WHERE i = n // 2 + 1"""
    ),
)
def median_threshold(t: Tables):
    return stats.median_threshold(stats.series_completeness(p.event_orders(t), "series"), "completeness")


@query(
    "a8_acronym_completeness",
    """WITH e AS (SELECT replace(p_type, ' ', '') AS series, p_size AS ordinal FROM part WHERE p_size <> 0
    AND regexp_matches(p_type, '^[A-Z]+$'))
SELECT series, min(ordinal) AS minOrdinal, max(ordinal) AS maxOrdinal, round(avg(ordinal), 6) AS avgOrdinal,
  round(CASE WHEN max(ordinal) > 1 THEN count(DISTINCT ordinal) / max(ordinal) ELSE 1.0 END, 6) AS completeness
FROM e GROUP BY 1""",
)
def acronym_completeness(t: Tables):
    acronym = F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string"))
    return stats.acronym_completeness(t.part.select(acronym.alias("acronym"), F.col("p_size").alias("ordinal")))


@query(
    "a9_create_lookup",
    """WITH u AS (SELECT 0 AS pos, 'orders' AS tab, n_name AS name, CASE WHEN o_orderkey % 4 > 0 THEN
      'Q' || n_nationkey || '-' || (o_orderkey % 3) END AS id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 1, 'suppliers', n_name, CASE WHEN s_suppkey % 5 > 0 THEN 'Q' || n_nationkey END
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  g AS (SELECT pos, tab, name, id, count(*) AS n FROM u GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos, n DESC, id) AS r FROM g WHERE id IS NOT NULL)
SELECT name, CAST(sum(n) AS BIGINT) AS count, max(CASE WHEN r = 1 THEN id END) AS qid,
  CAST(sum(CASE WHEN tab = 'orders' THEN n END) AS BIGINT) AS "ordersCount",
  CAST(sum(CASE WHEN tab = 'suppliers' THEN n END) AS BIGINT) AS "suppliersCount",
  round(sum(n) * 100 / (SELECT count(*) FROM u), 3) AS frequency FROM k GROUP BY 1""",
)
def create_lookup(t: Tables):
    nation = F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))
    by_nation = t.nation.select("n_name", "n_nationkey")
    orders = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("city"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(
            nation, F.lit("-"), (F.col("o_orderkey") % 3).cast("string"))).alias("cityWikidataid"))
    )
    suppliers = t.supplier.join(by_nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("city"), F.when(F.col("s_suppkey") % 5 > 0, nation).alias("cityWikidataid")
    )
    return stats.create_lookup({"orders": orders, "suppliers": suppliers}, "city", "cityWikidataid")


@query(
    "a10_signature_complete_series",
    """SELECT 'U' || user_id AS series, count(*) AS events FROM events GROUP BY user_id
HAVING count(*) > 4 AND min(value) >= 0.2""",
)
def signature_complete_series(t: Tables):
    e = p.event_stream(t).select(
        F.col("seriesId").alias("series"), "year", "startDate", F.col("startDate").alias("endDate"),
        F.col("number").alias("ordinal"), F.col("seriesId").alias("acronym"), F.col("source").alias("title"),
        F.when(F.col("value") >= 0.2, "somewhere").alias("location"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("country"),
    )
    return stats.signature_complete_series(e, "series", 4)


@query("a11_counter", _orders_sql("SELECT city, count(*) AS count FROM event_orders WHERE city IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def counter(t: Tables):
    return stats.most_common(p.event_orders(t), "city", 10)


@query(
    "a12_extract_stats",
    """SELECT * FROM (SELECT count_if(o_orderkey % 6 = 0) AS parts1, count_if(o_orderkey % 6 = 1) AS parts2,
  count_if(o_orderkey % 6 = 2) AS parts3, count_if(o_orderkey % 6 = 3) AS parts4, 0 AS "partsMore",
  count_if(o_orderkey % 6 >= 4) AS "invalidTitle", count_if(o_orderkey % 6 = 2 AND o_custkey % 2 = 1) AS "invalidOrdinal",
  count_if(o_orderkey % 6 = 1 AND o_custkey % 2 = 0) AS "invalidYear", count_if(o_orderkey % 6 = 0) AS "yearRange",
  count_if(o_orderkey % 10 = 0) AS "invalidDate" FROM orders)
UNPIVOT (value FOR key IN (parts1, parts2, parts3, parts4, "partsMore", "invalidTitle", "invalidOrdinal", "invalidYear",
  "yearRange", "invalidDate"))""",
)
def extract_stats(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    odd = F.col("o_custkey") % 2 == 1
    year = F.year("o_orderdate").cast("string")
    title = (
        F.when(key % 6 == 0, F.concat(F.lit("Days ("), year, F.lit(" - 2002)")))
        .when(key % 6 == 1, F.concat(F.lit("Days ("), F.when(odd, year).otherwise("x"), F.lit(" : Town "), cust, F.lit(")")))
        .when(key % 6 == 2, F.concat(F.lit("Days ("), F.when(odd, "II").otherwise("2."), F.lit(" : "), year, F.lit(" : Town)")))
        .when(key % 6 == 3, F.concat(F.lit("Days (Club : "), cust, F.lit(" : "), year, F.lit(" : Town)")))
        .otherwise(F.concat(F.lit("Days "), cust))
    )
    rows = t.orders.select(fulltitle(title).alias("x"), (key % 10 == 0).alias("invalidDate"))
    return stats.extract_stats(rows, "x")


@query("a13_durations", _orders_sql("SELECT CAST(endDate - startDate + 1 AS INTEGER) AS duration, count(*) AS count FROM event_orders GROUP BY 1"))
def durations(t: Tables):
    return stats.durations(p.event_orders(t))


@query(
    "a13_negative_durations",
    with_proxies(
        "event_orders proceedings",
        """SELECT r.ppn, e.eventId, CAST(r.endDate - e.startDate - 30 + 1 AS INTEGER) AS duration FROM proceedings r
JOIN event_orders e ON r.orderId = e.eventId WHERE r.endDate - e.startDate - 30 + 1 < 0""",
    ),
)
def negative_durations(t: Tables):
    e = p.event_orders(t).select("eventId", F.date_add("startDate", 30).alias("startDate"))
    r = p.proceedings(t).select("ppn", "orderId", "endDate")
    return stats.negative_durations(r.join(e, F.col("orderId") == F.col("eventId"))).select("ppn", "eventId", "duration")


@query(
    "a14_histogram_unit",
    _orders_sql(
        """, c AS (SELECT country AS label, ordinal::DOUBLE AS x FROM event_orders WHERE ordinal IS NOT NULL),
  r AS (SELECT label, min(x) AS lo, max(x) AS hi, count(*) AS total FROM c GROUP BY 1),
  b AS (SELECT label, unnest(generate_series(0, CAST(hi - lo AS BIGINT))) AS bin, lo, total FROM r)
SELECT b.label, CAST(b.bin AS INTEGER) AS bin, b.lo - 0.5 + b.bin AS lower, b.lo + 0.5 + b.bin AS upper,
  count(c.x) AS count, round(count(c.x) / b.total, 6) AS density
FROM b LEFT JOIN c ON c.label = b.label AND c.x = b.lo + b.bin GROUP BY b.label, b.bin, b.lo, b.total"""
    ),
)
def histogram_unit(t: Tables):
    return stats.histogram(p.event_orders(t), "ordinal", F.col("country"))


@query(
    "a14_histogram_bins",
    """WITH c AS (SELECT o_orderpriority AS label, o_totalprice AS x FROM orders),
  r AS (SELECT label, min(x) AS lo, (max(x) - min(x)) / 10 AS w, count(*) AS total FROM c GROUP BY 1),
  h AS (SELECT c.label, CAST(least(floor((x - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM c JOIN r USING (label) GROUP BY 1, 2),
  b AS (SELECT *, unnest(range(10)) AS bin FROM r)
SELECT b.label, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper,
  coalesce(n, 0) AS count, round(coalesce(n, 0) / (total * w), 6) AS density
FROM b LEFT JOIN h ON h.label = b.label AND h.bin = b.bin""",
)
def histogram_bins(t: Tables):
    return stats.histogram(t.orders, "o_totalprice", F.col("o_orderpriority"), bins=10)


@query(
    "a15_day_of_year_hist",
    """WITH d AS (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2020-12-31', INTERVAL 1 DAY)) AS day),
  c AS (SELECT month(o_orderdate) * 100 + day(o_orderdate) AS md, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(month(day) * 100 + day(day) AS INTEGER) AS "monthDay", coalesce(n, 0) AS count FROM d
LEFT JOIN c ON md = month(day) * 100 + day(day)""",
)
def day_of_year_hist(t: Tables):
    return stats.day_of_year_histogram(p.event_orders(t), "startDate")


_ZIPF = """WITH c AS (SELECT p_size AS x, count(*) AS f FROM part GROUP BY 1 ORDER BY 1 OFFSET 1)"""


@query(
    "a16_zipf_summary",
    _ZIPF + ' SELECT count(*) AS values, round(avg(f), 6) AS mean, round(avg(ln(f)), 6) AS "meanLog" FROM c',
)
def zipf_summary(t: Tables):
    return stats.zipf_summary(stats.zipf_counts(t.part, "p_size", skip=1))


@query(
    "a16_zipf_fit",
    _ZIPF
    + """, s AS (SELECT sum(f * ln(x)) AS logs, sum(f) AS total FROM c),
  g AS (SELECT round(unnest(range(-10000, 10001)) / 1000, 3) AS b),
  l AS (SELECT b, (SELECT sum(power(x::DOUBLE, -b)) FROM c) AS norm FROM g)
SELECT arg_max(b, -b * logs - total * ln(norm)) AS b FROM l, s""",
)
def zipf_fit(t: Tables):
    return stats.zipf_fit(stats.zipf_counts(t.part, "p_size", skip=1))


@query(
    "a17_column_fill",
    _corpus_sql(
        """ SELECT 'event_' || source AS "tableName", count(number) AS filled, count(*) AS total,
  round(count(number) * 100.0 / count(*), 6) AS percent FROM corpus WHERE source <> 'orders' GROUP BY source"""
    ),
)
def column_fill(t: Tables):
    return stats.column_fill(views.view_tables(corpus(t)), "number")


@query("a18_volume_dist", _orders_sql("SELECT '2' AS volume, count(*) AS count FROM event_orders WHERE title LIKE '%vol. 2%'"))
def volume_dist(t: Tables):
    return stats.volume_distribution(p.event_orders(t), "title")


_ACRONYMS = """WITH a AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || '@' || upper(p_name)
    WHEN 2 THEN '(' || p_type || ') ' || p_size ELSE p_name || ' of ' || p_brand END AS acronym FROM part)"""


def _acronyms(t: Tables):
    key = F.col("p_partkey")
    acronym = (
        F.when(key % 4 == 0, F.col("p_type"))
        .when(key % 4 == 1, F.concat("p_type", F.lit("@"), F.upper("p_name")))
        .when(key % 4 == 2, F.concat(F.lit("("), "p_type", F.lit(") "), F.col("p_size").cast("string")))
        .otherwise(F.concat("p_name", F.lit(" of "), "p_brand"))
    )
    return t.part.select(acronym.alias("acronym"), F.lit("parts").alias("source"))


@query(
    "a19_acronym_structure",
    _ACRONYMS
    + """, w AS (SELECT acronym, length(trim(acronym)) - length(replace(trim(acronym), ' ', '')) AS blanks,
    length(acronym) - length(replace(acronym, ' ', '')) <= 1 AS short, trim(string_split(acronym, ' ')[1], ' ()#') AS word FROM a),
  m AS (SELECT 'length' AS measure, length(acronym) AS value FROM w UNION ALL SELECT 'blanks', blanks FROM w
  UNION ALL SELECT 'firstWordLength', length(word) FROM w WHERE short
  UNION ALL SELECT 'capitals', length(regexp_replace(word, '[^A-Z]', '', 'g')) FROM w WHERE short)
SELECT measure, CAST(value AS INTEGER) AS value, count(*) AS count FROM m GROUP BY ALL""",
)
def acronym_structure(t: Tables):
    return stats.acronym_structure(_acronyms(t), "acronym")


@query(
    "a20_acronym_dictionary",
    _ACRONYMS
    + """, s AS (SELECT unnest(string_split(acronym, '@')) AS a FROM a),
  w AS (SELECT DISTINCT trim(string_split(a, ' ')[1], ' ()#') AS acronym FROM s WHERE length(a) - length(replace(a, ' ', '')) <= 1)
SELECT acronym FROM w WHERE length(acronym) BETWEEN 3 AND 10 AND length(regexp_replace(acronym, '[^A-Z]', '', 'g')) > 1""",
)
def acronym_dictionary(t: Tables):
    other = t.customer.select(F.col("c_mktsegment").alias("acronym"), F.lit("excluded").alias("source"))
    return stats.acronym_dictionary(_acronyms(t).unionByName(other), ["excluded"])


_YEARED = """WITH e AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE
    'CONF ' || (year(o_orderdate) + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) END AS acronym,
    CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"""


def _yeared(t: Tables):
    key = F.col("o_orderkey")
    year = F.year("o_orderdate")
    shifted = (year + F.when(key % 9 == 0, 1).otherwise(0)).cast("string")
    acronym = F.when(key % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("CONF "), shifted))
    return t.orders.select(acronym.alias("acronym"), year.alias("year"), F.to_date("o_orderdate").alias("startDate"))


@query(
    "a21_acronym_year_check",
    _YEARED + """ SELECT count(*) AS matched, count_if(right(acronym, 4) <> CAST(year AS VARCHAR)) AS "yearDiffers"
FROM e WHERE acronym LIKE 'CONF %'""",
)
def acronym_year_check(t: Tables):
    return stats.acronym_year_check(_yeared(t))


@query(
    "a21_acronym_match_share",
    _YEARED + """ SELECT year, count(*) AS total, round(avg(CASE WHEN acronym LIKE 'CONF %' THEN 1.0 ELSE 0.0 END), 6)
  AS "matchShare" FROM e GROUP BY 1""",
)
def acronym_match_share(t: Tables):
    return stats.acronym_match_share(_yeared(t))


@query(
    "a23_location_parts",
    with_proxies("location_text", "SELECT CAST(len(string_split(location, ',')) AS INTEGER) AS parts, count(*) AS count FROM location_text GROUP BY 1"),
)
def location_parts(t: Tables):
    return stats.location_parts(p.location_text(t), "location")
