"""Queries: triples to records."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import triples as g
from eventloom.plans import proxies as p
from eventloom.plans.cleaning import text
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query


@query("g1_property_usage", with_proxies("triples", "SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects FROM triples GROUP BY 1 HAVING count(*) > 100"))
def property_usage(t: Tables):
    return g.property_usage(p.triples(t), 100)


@query("g1_class_usage", with_proxies("triples", "SELECT o AS class, count(*) AS count FROM triples WHERE p = 'type' GROUP BY 1 HAVING count(*) > 10"))
def class_usage(t: Tables):
    return g.class_usage(p.triples(t), "type", 10)


@query(
    "g2_entity_flatten_agg",
    with_proxies(
        "triples",
        """, e AS (SELECT s FROM triples WHERE p = 'type' AND o = 'ECONOMY'),
  d AS (SELECT DISTINCT s, p, o FROM triples WHERE s IN (SELECT s FROM e))
SELECT s, min(CASE WHEN p = 'label' THEN o END) AS label, count(CASE WHEN p = 'label' THEN 1 END) AS "labelCount",
  string_agg(CASE WHEN p = 'label' THEN o END, '| ' ORDER BY o) AS labels,
  min(CASE WHEN p = 'supplier' THEN o END) AS supplier, count(CASE WHEN p = 'supplier' THEN 1 END) AS "supplierCount",
  string_agg(CASE WHEN p = 'supplier' THEN o END, '| ' ORDER BY o) AS suppliers FROM d GROUP BY 1""",
    ),
)
def entity_flatten_agg(t: Tables):
    return g.flatten_aggregated(p.triples(t), "type", "ECONOMY", ["label"], ["supplier"])


@query(
    "g2_value_pages",
    with_proxies(
        "triples",
        """, d AS (SELECT DISTINCT s, p, o FROM triples WHERE p IN ('label', 'supplier')),
  n AS (SELECT *, (row_number() OVER (PARTITION BY s, p ORDER BY o) - 1) // 3 AS page FROM d)
SELECT s, p, CAST(page AS BIGINT) AS page, string_agg(o, '| ' ORDER BY o) AS "values" FROM n GROUP BY s, p, page""",
    ),
)
def value_pages(t: Tables):
    """Lists of labels and suppliers, three values a page."""
    return g.value_pages(p.triples(t), ["label", "supplier"], 3).withColumn("values", F.array_join("values", "| "))


@query(
    "g2_entity_figures",
    with_proxies(
        "triples",
        """, e AS (SELECT s FROM triples WHERE p = 'type' AND o = 'ECONOMY'), d AS (SELECT DISTINCT s, p, o FROM triples WHERE s IN (SELECT s FROM e))
SELECT s, min(CASE WHEN p = 'label' THEN o END) AS label, count(CASE WHEN p = 'label' THEN 1 END) AS "labelCount",
  min(CASE WHEN p = 'supplier' THEN o END) AS supplier, count(CASE WHEN p = 'supplier' THEN 1 END) AS "supplierCount" FROM d GROUP BY 1""",
    ),
)
def entity_figures(t: Tables):
    return g.flatten_figures(p.triples(t), "type", "ECONOMY", ["label"], ["supplier"])


@query(
    "g3_entity_flatten_rows",
    with_proxies(
        "triples",
        """SELECT DISTINCT e.s, l.o AS title, b.o AS brand, v.o AS supplier, n.o AS "supplierName" FROM triples e
JOIN triples l ON l.s = e.s AND l.p = 'label' AND l.lang = 'en' LEFT JOIN triples b ON b.s = e.s AND b.p = 'brand'
LEFT JOIN triples v ON v.s = e.s AND v.p = 'supplier' LEFT JOIN triples n ON n.s = v.o AND n.p = 'label' AND n.lang = 'en'
WHERE e.p = 'type' AND e.o = 'STANDARD'""",
    ),
)
def entity_flatten_rows(t: Tables):
    facts = p.triples(t)
    names = g.values(facts, "label", "supplierName", "en").withColumnRenamed("s", "supplier")
    suppliers = g.values(facts, "supplier", "supplier").join(names, "supplier", "left").select("s", "supplier", "supplierName")
    return g.flatten_rows(
        g.entities_of(facts, "type", "STANDARD"), [g.values(facts, "label", "title", "en")], [g.values(facts, "brand", "brand"), suppliers]
    ).select("s", "title", "brand", "supplier", "supplierName")


@query(
    "g3_inverse_property",
    with_proxies(
        "triples",
        """SELECT DISTINCT l.s, l.o AS label, i.s AS part, b.o AS brand FROM triples l JOIN triples i ON i.o = l.s AND i.p = 'supplier'
LEFT JOIN triples b ON b.s = i.s AND b.p = 'brand' WHERE l.p = 'label' AND l.lang = 'en'""",
    ),
)
def inverse_property(t: Tables):
    facts = p.triples(t)
    parts = g.inverse_values(facts, "supplier", "part").join(g.values(facts, "brand", "brand").withColumnRenamed("s", "part"), "part", "left")
    return g.flatten_rows(g.values(facts, "label", "label", "en"), [parts], []).select("s", "label", "part", "brand")


@query(
    "g4_series_flatten",
    """SELECT 'C' || c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS acronym, c_name AS label,
  CASE WHEN c_custkey % 2 = 0 THEN 'conf/' || c_custkey END AS "dblpId", CAST(c_nationkey AS VARCHAR) AS "gndId" FROM customer""",
)
def series_flatten(t: Tables):
    n = F.col("c_custkey")
    null = F.lit(None).cast("string")

    def fact(name, value, lang=null):
        return F.struct(F.lit(name).alias("p"), value.alias("o"), lang.alias("lang"))

    cells = F.array(
        fact("type", F.lit("series")), fact("label", F.col("c_name"), F.lit("en")), fact("label", F.upper("c_name"), F.lit("de")),
        fact("short", F.when(n % 3 == 0, F.col("c_mktsegment"))), fact("dblpId", F.when(n % 2 == 0, F.concat(F.lit("conf/"), text(n)))),
        fact("gndId", text("c_nationkey")),
    )
    facts = t.customer.select(F.concat(F.lit("C"), text(n)).alias("s"), F.inline(cells)).where("o IS NOT NULL")
    return g.series_flatten(facts, g.entities_of(facts, "type", "series"), "short", "label", ["dblpId", "gndId"], "en")


@query(
    "g5_iri_group",
    with_proxies(
        "event_orders",
        """SELECT lower(series) AS conf, count(*) AS count, min(year) AS "minYear", max(year) AS "maxYear",
  'https://dblp.org/db/conf/' || lower(series) || '/index.html' AS series FROM event_orders WHERE CAST(eventId AS BIGINT) % 3 > 0 GROUP BY lower(event_orders.series)""",
    ),
)
def iri_group(t: Tables):
    prefix = "https://dblp.org/rec/conf/"
    base = F.when(F.col("eventId").cast("long") % 3 > 0, prefix).otherwise("https://dblp.org/rec/journals/")
    rows = p.event_orders(t).select(F.concat(base, F.lower("series"), F.lit("/"), "eventId").alias("iri"), "year")
    return g.iri_group(rows, "iri", prefix, "https://dblp.org/db/conf/{value}/index.html")


@query(
    "g6_closure",
    "WITH RECURSIVE " + p.SQL["located_in"] + """, up AS (SELECT child, parent AS ancestor FROM located_in
  UNION SELECT u.child, e.parent FROM up u JOIN located_in e ON u.ancestor = e.child) SELECT child, ancestor FROM up""",
)
def closure(t: Tables):
    return g.closure(p.located_in(t))


@query(
    "g6_instances_of",
    """SELECT DISTINCT 'order' || o_orderkey AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 2""",
)
def instances_of(t: Tables):
    # orders are typed by their customer, whose class lies below nation, region and world
    types = t.orders.select(F.concat(F.lit("order"), text("o_orderkey")).alias("s"), F.concat(F.lit("customer"), text("o_custkey")).alias("o"))
    return g.instances_of(types, p.located_in(t), "region2")


@query(
    "g7_property_count",
    with_proxies(
        "triples",
        """, e AS (SELECT DISTINCT s FROM triples WHERE p = 'type' AND o = 'PROMO')
SELECT p, count(DISTINCT s) AS items FROM triples WHERE s IN (SELECT s FROM e) AND p IN ('brand', 'supplier', 'label') GROUP BY 1""",
    ),
)
def property_count(t: Tables):
    return g.property_count(p.triples(t), "type", "PROMO", ["brand", "supplier", "label"])


@query(
    "g8_in_list_lookup",
    with_proxies(
        "triples",
        """SELECT DISTINCT b.s, b.o AS brand, t.o AS kind, z.o AS size FROM triples b LEFT JOIN triples t ON t.s = b.s AND t.p = 'type'
LEFT JOIN triples z ON z.s = b.s AND z.p = 'size' WHERE b.p = 'brand' AND b.o IN ('Brand#2', 'Brand#17')""",
    ),
)
def in_list_lookup(t: Tables):
    return g.in_list(p.triples(t), "brand", ["Brand#2", "Brand#17"], {"type": "kind", "size": "size"})
