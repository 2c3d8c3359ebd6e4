"""Queries: matching truth, evaluation and the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import matching as m
from eventloom.plans import proxies as p
from eventloom.plans.cleaning import text
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family

FAMILY = Family()
query = FAMILY.query

NAMES = ["A", "B", "seriesC"]


def _volumes(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ppn")
    )


def truth(t: Tables, volumes: DataFrame | None = None):
    """An order, its volumes and its customer belong together; a volume may have several rows."""
    label, pos = F.concat(F.lit("o"), text("o_orderkey")), F.col("o_orderkey")
    cells = F.array(
        F.struct(F.lit("A").alias("name"), text("o_orderkey").alias("id")),
        F.struct(F.lit("seriesC").alias("name"), text("o_custkey").alias("id")),
    )
    volumes = (_volumes(t) if volumes is None else volumes).select(F.concat(F.lit("o"), text("k")).alias("label"), F.col("k").alias("pos"), F.lit("B").alias("name"), F.col("ppn").alias("id"))
    return t.orders.select(label.alias("label"), pos.alias("pos"), F.inline(cells)).unionByName(volumes)


def records(t: Tables):
    """The truth with the wrong order number on every sixth record, as distinct rows."""
    wrong = F.when((F.col("name") == "A") & (F.col("pos") % 6 == 0), text(F.col("pos") + 1)).otherwise(F.col("id"))
    return truth(t, _volumes(t).distinct()).select(F.col("label").alias("record"), "name", wrong.alias("id"))


_TRUTH = """WITH v AS (SELECT DISTINCT l_orderkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ppn FROM lineitem),
  truth AS (SELECT o_orderkey AS pos, 'A' AS name, CAST(o_orderkey AS VARCHAR) AS id FROM orders
    UNION ALL SELECT o_orderkey, 'seriesC', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT k, 'B', ppn FROM v),
  rec AS (SELECT pos AS record, name, CASE WHEN name = 'A' AND pos % 6 = 0 THEN CAST(pos + 1 AS VARCHAR) ELSE id END AS id FROM truth),
  lut AS (SELECT name, id, max(pos) AS label FROM truth GROUP BY ALL)"""
_PAIRS = """, pairs AS (SELECT a.record, a.name AS name1, a.id AS id1, b.name AS name2, b.id AS id2 FROM rec a JOIN rec b
    ON a.record = b.record AND a.name < b.name),
  checked AS (SELECT q.*, EXISTS (SELECT 1 FROM lut l JOIN truth x ON x.pos = l.label WHERE l.name = name1 AND l.id = id1 AND x.name = name2 AND x.id = id2)
    OR EXISTS (SELECT 1 FROM lut l JOIN truth x ON x.pos = l.label WHERE l.name = name2 AND l.id = id2 AND x.name = name1 AND x.id = id1) AS actual FROM pairs q),
  missed AS (SELECT DISTINCT r.record, r.name AS name1, r.id AS id1, x.name AS name2, x.id AS id2 FROM rec r JOIN lut l ON l.name = r.name AND l.id = r.id
      JOIN truth x ON x.pos = l.label AND x.name > r.name
    UNION SELECT DISTINCT r.record, r.name, r.id, l.name, l.id FROM rec r JOIN truth x ON x.name = r.name AND x.id = r.id
      JOIN lut l ON l.label = x.pos AND l.name > r.name),
  fn AS (SELECT * FROM missed q WHERE name1 <> 'seriesC' AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.record = q.record AND r.name = q.name2 AND r.id = q.id2))"""


@query("m1_truth_lookup", _TRUTH + " SELECT name, id, 'o' || label AS label FROM lut")
def truth_lookup(t: Tables):
    return m.truth_lookup(truth(t))


@query(
    "m2_evaluate_matches",
    _TRUTH + _PAIRS + """ SELECT 'o' || record AS record, name1, id1, name2, id2, CASE WHEN actual THEN 'TP' ELSE 'FP' END AS label,
  CASE WHEN actual THEN 'TP' ELSE 'TN' END AS "refLabel" FROM checked
UNION ALL SELECT 'o' || record, name1, id1, name2, id2, 'FN', 'FN' FROM fn""",
)
def evaluate_matches(t: Tables):
    return m.evaluate(records(t), truth(t), NAMES)


@query("m3_check_match", _TRUTH + _PAIRS + " SELECT 'o' || record AS record, name1, id1, name2, id2, actual FROM checked")
def check_match(t: Tables):
    return m.check_records(records(t), truth(t), NAMES)


_CONFUSION = """, neg AS (SELECT a.name AS name1, b.name AS name2, CAST(sum((b.truth_ids - coalesce(k.n, 0)) * a.n) AS BIGINT) AS n
    FROM (SELECT record, name, count(*) AS n FROM rec GROUP BY ALL) a
    JOIN (SELECT name, count(*) AS truth_ids FROM lut GROUP BY 1) b ON a.name < b.name
    LEFT JOIN (SELECT record, r.name, count(*) AS n FROM rec r JOIN lut USING (name, id) GROUP BY ALL) k ON k.record = a.record AND k.name = b.name
    GROUP BY ALL),
  conf AS (SELECT n.name1, n.name2, (SELECT count(*) FROM checked c WHERE c.name1 = n.name1 AND c.name2 = n.name2 AND actual) AS tp,
    (SELECT count(*) FROM checked c WHERE c.name1 = n.name1 AND c.name2 = n.name2 AND NOT actual) AS fp,
    (SELECT count(*) FROM fn c WHERE c.name1 = n.name1 AND c.name2 = n.name2) AS fn, n.n AS neg FROM neg n)"""


@query("m4_confusion", _TRUTH + _PAIRS + _CONFUSION + ' SELECT name1, name2, tp AS "TP", fp AS "FP", fn AS "FN", neg - fn AS "TN" FROM conf')
def confusion(t: Tables):
    return m.confusion(records(t), truth(t), NAMES)


@query(
    "m4_scores",
    _TRUTH + _PAIRS + _CONFUSION + """, s AS (SELECT CAST(sum(tp) AS BIGINT) AS "TP", CAST(sum(fp) AS BIGINT) AS "FP", CAST(sum(fn) AS BIGINT) AS "FN",
  CAST(sum(neg - fn) AS BIGINT) AS "TN" FROM conf)
SELECT *, round("TP" / ("TP" + "FP"), 6) AS precision, round("TP" / ("TP" + "FN"), 6) AS recall,
  round(("TP" + "TN") / ("TP" + "FP" + "FN" + "TN"), 9) AS accuracy FROM s""",
)
def scores(t: Tables):
    return m.scores(m.confusion(records(t), truth(t), NAMES))


@query(
    "m5_match_edges",
    _TRUTH + _PAIRS + """ SELECT DISTINCT name1 || ':' || id1 AS "from", name2 || ':' || id2 AS "to", 'FP' AS label, 'red' AS color FROM checked WHERE NOT actual
UNION ALL SELECT DISTINCT name1 || ':' || id1, name2 || ':' || id2, 'FN', 'orange' FROM fn""",
)
def match_edges(t: Tables):
    return m.match_edges(m.evaluate(records(t), truth(t), NAMES), ["FP", "FN"])


@query(
    "a24_ids_by_source",
    """SELECT 'orderId' AS name, CAST(o_orderkey AS VARCHAR) AS id FROM orders
UNION SELECT 'customers', 'C' || o_custkey FROM orders UNION SELECT 'customers', 'D' || (o_custkey % 50) FROM orders""",
)
def ids_by_source(t: Tables):
    cust = F.col("o_custkey")
    rows = t.orders.select(
        text("o_orderkey").alias("orderId"),
        F.concat(F.lit("C"), text(cust), F.lit("⇹D"), text(cust % 50)).alias("customers"),
    )
    return m.ids_by_source(rows, "orderId", ["orderId", "customers"])


@query(
    "m6_training_set",
    with_proxies(
        "event_orders",
        """, wanted AS (SELECT 'C' || c_custkey AS acronym FROM customer WHERE c_mktsegment = 'MACHINERY'),
  sc AS (SELECT *, CASE WHEN title IS NULL THEN 0.0 ELSE (CASE WHEN lower(title) LIKE '%proceeding%' THEN 1.0 ELSE 0.0 END
    + CASE WHEN lower(title) LIKE '%conference%' THEN 1.0 ELSE 0.0 END
    + CASE WHEN title LIKE '%volume 1%' THEN 1.0 WHEN title LIKE '%vol. 2%' THEN 0.5 ELSE 0.0 END + 0.5) END AS score
    FROM event_orders WHERE series IN (SELECT acronym FROM wanted)),
  best AS (SELECT *, max(score) OVER (PARTITION BY series, year) AS top FROM sc),
  ac AS (SELECT *, max(score) OVER (PARTITION BY series, year) AS top FROM sc WHERE acronym IS NOT NULL)
SELECT 'orclone' AS source, eventId, series AS "seriesAcronym" FROM sc
UNION ALL SELECT 'dblp', eventId, lower(series) FROM best WHERE score = top
UNION ALL SELECT 'tibkat', eventId, series FROM ac WHERE score = top
UNION ALL SELECT 'gnd', eventId, series FROM ac""",
    ),
)
def training_set(t: Tables):
    e = p.event_orders(t).drop("source")
    wanted = p.series_orders(t).where("segment = 'MACHINERY'")
    words = e.withColumn("series", F.lit(None).cast("string"))
    found = m.training_set(
        e.withColumn("source", F.lit("orclone")),
        wanted,
        e.withColumns({"source": F.lit("dblp"), "series": F.lower("series")}),
        {"tibkat": (words.withColumn("source", F.lit("tibkat")), ["series", "acronym"]),
         "gnd": (words.withColumn("source", F.lit("gnd")), ["acronym"])},
        dedup=("tibkat",),
    )
    return found.select("source", "eventId", "seriesAcronym")
