"""The given tables seen as event sources.

Every proxy is a projection of whole tables. ``Tables`` reads them, the functions below
shape them, and ``SQL`` states the same shape for the DuckDB side of the check. Nulls are
put into some columns because the tables have none; no row is ever left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


class Tables:
    """Reads the given parquet tables by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def event_orders(t: Tables) -> DataFrame:
    """One event per order: series per customer, city and country from the nation."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    series = F.concat(F.lit("C"), _text(cust))
    year = F.year("o_orderdate")
    start = F.to_date("o_orderdate")
    joined = t.orders.join(places, cust == F.col("c_custkey"))
    return joined.select(
        _text(key).alias("eventId"),
        F.lit("orders").alias("source"),
        series.alias("series"),
        year.alias("year"),
        start.alias("startDate"),
        F.date_add(start, (key % 6 - 1).cast("int")).alias("endDate"),
        F.when(key % 7 == 0, None)
        .when(key % 7 == 1, F.concat(series, F.lit(" "), _text(year)))
        .otherwise(series)
        .alias("acronym"),
        F.when(key % 5 == 0, F.concat(F.lit("Proceedings of the Conference "), series))
        .when(key % 5 == 1, F.concat(series, F.lit(" Conference")))
        .when(key % 5 == 2, F.concat(F.lit("Proceedings of "), series, F.lit(" volume 1")))
        .when(key % 5 == 3, F.concat(series, F.lit(" workshop vol. 2")))
        .alias("title"),
        F.when(key % 5 != 0, F.col("n_name")).alias("city"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("country"),
        F.when((cust % 4 == 2) & (year % 2 == 1), ((year - 1993) / 2).cast("int"))
        .when(cust % 4 == 2, None)
        .when(cust % 4 == 3, (year - 1994 + key % 2).cast("int"))
        .otherwise(year - 1994)
        .alias("ordinal"),
    )


def event_of_type(t: Tables, kind: str) -> DataFrame:
    """One event per row of the given type; its columns differ from ``event_orders``."""
    return t.events.where(F.col("event_type") == kind).select(*_event_columns())


def event_stream(t: Tables) -> DataFrame:
    """All event types together."""
    return t.events.select(*_event_columns())


def _event_columns() -> list[Column]:
    return [
        _text("event_id").alias("eventId"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("U"), _text("user_id")).alias("seriesId"),
        F.to_date("ts").alias("startDate"),
        F.year("ts").alias("year"),
        F.get_json_object("props", "$.k").cast("int").alias("number"),
        F.col("value"),
    ]


def series_orders(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("C"), _text("c_custkey")).alias("acronym"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("segment"),
    )


def proceedings(t: Tables) -> DataFrame:
    """One volume per line item, with a stored list of one to three classification codes."""
    part = F.col("l_partkey")
    code = F.concat(_text(part % 60), F.lit("."), _text(part % 90 + 10))
    more = F.concat(F.lit("⇹"), _text(part % 7 + 50), F.lit(".10"))
    return t.lineitem.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey")).alias(
            "ppn"
        ),
        F.concat(F.lit("10.1/"), _text("l_orderkey")).alias("doi"),
        _text("l_orderkey").alias("orderId"),
        _text("l_suppkey").alias("publisher"),
        F.to_date("l_shipdate").alias("endDate"),
        F.when(part % 11 == 0, None)
        .when(part % 3 == 0, code)
        .when(part % 3 == 1, F.concat(code, more))
        .otherwise(F.concat(code, more, F.lit("⇹54.72")))
        .alias("bk"),
        F.col("l_returnflag").alias("genreCode"),
        F.col("l_linestatus").alias("typeCode"),
    )


def location_text(t: Tables) -> DataFrame:
    """Events with a location written in one of three ways; every fifth nation is unknown."""
    e = event_orders(t)
    key = F.col("eventId").cast("long")
    return e.withColumn(
        "location",
        F.when(key % 3 == 0, F.col("nation"))
        .when(key % 3 == 1, F.concat_ws(", ", "nation", "country"))
        .otherwise(F.concat_ws(" ", "nation", "country")),
    )


def triples(t: Tables) -> DataFrame:
    """(s, p, o, lang) rows about parts; ``supplier`` has many values."""
    subject = F.concat(F.lit("part"), _text("p_partkey"))
    literals = F.explode(
        F.array(
            F.struct(F.lit("type").alias("p"), F.col("p_type").alias("o"), F.lit(None).cast("string").alias("lang")),
            F.struct(F.lit("brand").alias("p"), F.col("p_brand").alias("o"), F.lit(None).cast("string").alias("lang")),
            F.struct(F.lit("size").alias("p"), _text("p_size").alias("o"), F.lit(None).cast("string").alias("lang")),
            F.struct(F.lit("label").alias("p"), F.col("p_name").alias("o"), F.lit("en").alias("lang")),
            F.struct(F.lit("label").alias("p"), F.upper("p_name").alias("o"), F.lit("de").alias("lang")),
        )
    )
    facts = t.part.select(subject.alias("s"), literals.alias("f")).select("s", "f.p", "f.o", "f.lang")
    # made distinct as numbers: a task's table of pairs is a fraction of that of their texts
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    links = pairs.select(
        F.concat(F.lit("part"), _text("l_partkey")).alias("s"),
        F.lit("supplier").alias("p"),
        F.concat(F.lit("supplier"), _text("l_suppkey")).alias("o"),
        F.lit(None).cast("string").alias("lang"),
    )
    makers = t.supplier.select(
        F.concat(F.lit("supplier"), _text("s_suppkey")).alias("s"),
        F.lit("label").alias("p"),
        F.col("s_name").alias("o"),
        F.lit("en").alias("lang"),
    )
    return facts.unionByName(links).unionByName(makers)


def located_in(t: Tables) -> DataFrame:
    """Edges customer → nation → region → world."""
    return (
        t.customer.select(
            F.concat(F.lit("customer"), _text("c_custkey")).alias("child"),
            F.concat(F.lit("nation"), _text("c_nationkey")).alias("parent"),
        )
        .unionByName(
            t.nation.select(
                F.concat(F.lit("nation"), _text("n_nationkey")).alias("child"),
                F.concat(F.lit("region"), _text("n_regionkey")).alias("parent"),
            )
        )
        .unionByName(
            t.region.select(
                F.concat(F.lit("region"), _text("r_regionkey")).alias("child"), F.lit("world").alias("parent")
            )
        )
    )


# The same shapes for DuckDB, as common table expressions.
SQL = {
    "event_orders": """event_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS eventId, 'orders' AS source, 'C' || o_custkey AS series,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS startDate,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 - 1 AS INTEGER) AS endDate,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'C' || o_custkey || ' ' || year(o_orderdate)
      ELSE 'C' || o_custkey END AS acronym,
    CASE o_orderkey % 5 WHEN 0 THEN 'Proceedings of the Conference C' || o_custkey
      WHEN 1 THEN 'C' || o_custkey || ' Conference' WHEN 2 THEN 'Proceedings of C' || o_custkey || ' volume 1'
      WHEN 3 THEN 'C' || o_custkey || ' workshop vol. 2' END AS title,
    CASE WHEN o_orderkey % 5 <> 0 THEN n_name END AS city, n_name AS nation, r_name AS country,
    CAST(CASE WHEN o_custkey % 4 = 2 THEN CASE WHEN year(o_orderdate) % 2 = 1 THEN (year(o_orderdate) - 1993) // 2 END
      WHEN o_custkey % 4 = 3 THEN year(o_orderdate) - 1994 + o_orderkey % 2
      ELSE year(o_orderdate) - 1994 END AS INTEGER) AS ordinal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)""",
    "event_stream": """event_stream AS (
  SELECT CAST(event_id AS VARCHAR) AS eventId, event_type AS source, 'U' || user_id AS seriesId,
    CAST(ts AS DATE) AS startDate, CAST(year(ts) AS INTEGER) AS year,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS number, value
  FROM events)""",
    "series_orders": """series_orders AS (
  SELECT 'C' || c_custkey AS acronym, c_name AS title, c_mktsegment AS segment FROM customer)""",
    "proceedings": """proceedings AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ppn, '10.1/' || l_orderkey AS doi,
    CAST(l_orderkey AS VARCHAR) AS orderId, CAST(l_suppkey AS VARCHAR) AS publisher,
    CAST(l_shipdate AS DATE) AS endDate,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey % 60) || '.' || (l_partkey % 90 + 10) ||
      CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '⇹' || (l_partkey % 7 + 50) || '.10'
        ELSE '⇹' || (l_partkey % 7 + 50) || '.10⇹54.72' END END AS bk,
    l_returnflag AS genreCode, l_linestatus AS typeCode
  FROM lineitem)""",
    "location_text": """location_text AS (
  SELECT *, CASE CAST(eventId AS BIGINT) % 3 WHEN 0 THEN nation WHEN 1 THEN nation || ', ' || country
    ELSE nation || ' ' || country END AS location FROM event_orders)""",
    "triples": """triples AS (
  SELECT 'part' || p_partkey AS s, 'type' AS p, p_type AS o, CAST(NULL AS VARCHAR) AS lang FROM part
  UNION ALL SELECT 'part' || p_partkey, 'brand', p_brand, NULL FROM part
  UNION ALL SELECT 'part' || p_partkey, 'size', CAST(p_size AS VARCHAR), NULL FROM part
  UNION ALL SELECT 'part' || p_partkey, 'label', p_name, 'en' FROM part
  UNION ALL SELECT 'part' || p_partkey, 'label', upper(p_name), 'de' FROM part
  UNION ALL (SELECT DISTINCT 'part' || l_partkey, 'supplier', 'supplier' || l_suppkey, NULL FROM lineitem)
  UNION ALL SELECT 'supplier' || s_suppkey, 'label', s_name, 'en' FROM supplier)""",
    "located_in": """located_in AS (
  SELECT 'customer' || c_custkey AS child, 'nation' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation
  UNION ALL SELECT 'region' || r_regionkey, 'world' FROM region)""",
}
_NEEDS = {"location_text": ["event_orders"]}


def with_proxies(names: str, body: str) -> str:
    """``WITH`` the named proxies, then ``body`` (more CTEs start with a comma)."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + "\n" + body
