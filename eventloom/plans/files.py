"""Queries: file sources and sinks, on files that Spark renders from the given tables.

Files go to the staging folder; every query reads back what was written as its source would
find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.cleaning import clean_confref, clean_crossref, rename_properties
from eventloom.fixed_values import EVENT_TEMPLATE_PROPERTIES
from eventloom.operators.joins import event_series_lookup
from eventloom.plans import proxies as p
from eventloom.plans.cleaning import raw_confref, raw_crossref, text
from eventloom.plans.lookup import _DUCK_CORPUS, corpus
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family
from eventloom.session import staging_path
from eventloom.sources import files
from eventloom.streaming import crawl

FAMILY = Family()
query = FAMILY.query


def tag(name: str, value, attributes: str = ""):
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>")), F.lit(""))


def _write_lines(lines: DataFrame, name: str) -> str:
    path = staging_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


#: Lines of a compressed file: it is read by one task, so it holds less text than a usual split.
PACKED_LINES = 50_000


def _write_packed(lines: DataFrame, name: str) -> str:
    """As :func:`_write_lines`, in many compressed files."""
    path = staging_path(lines.sparkSession, name)
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", PACKED_LINES).text(path)
    return path


def _bibliography(t: Tables) -> str:
    """Proceedings per order and articles per supplier, mixed in the same files."""
    n = F.col("o_orderkey")
    proceedings = t.orders.select(
        F.concat(
            F.lit('<proceedings key="conf/c'), text("o_custkey"), F.lit("/"), text(n), F.lit('" mdate="'), text(F.to_date("o_orderdate")),
            F.when(n % 3 == 0, '" publtype="informal').otherwise(""), F.lit('">'),
            tag("editor", F.lit("A &amp; M&uuml;ller")), F.when(n % 2 == 0, tag("editor", F.col("o_orderpriority"))).otherwise(""),
            F.when(n % 5 != 0, tag("title", F.concat(F.lit("Days "), text(n), F.when(n % 3 == 0, "<sub>2</sub> and more").otherwise("")))).otherwise(""),
            tag("year", text(F.year("o_orderdate"))), tag("ee", F.concat(F.lit("https://doi.org/10.1/"), text(n)), ' type="oa"'),
            tag("ee", F.lit("https://x.org")), tag("series", F.lit("LN"), ' href="db/x.html"'), F.lit("</proceedings>"),
        ).alias("value")
    )
    articles = t.supplier.select(
        F.concat(F.lit('<article key="journals/'), text("s_suppkey"), F.lit('" mdate="2020-01-01">'), tag("title", F.col("s_name")), F.lit("</article>")).alias("value")
    )
    # no key; a comment with a tag; and records longer than a split may be
    homes = t.nation.select(
        F.concat(F.lit('<www mdate="2020-02-02">'), tag("title", F.col("n_name")), F.lit("<!-- <title>no</title> -->"),
                 tag("note", F.repeat(F.concat("n_name", F.lit(" > ")), 5000)), F.lit("</www>")).alias("value")
    )
    return _write_lines(proceedings.unionByName(articles).unionByName(homes), "bibliography")


@query(
    "s1_xml_kinds",
    """SELECT 'proceedings' AS kind, 'conf/c' || o_custkey || '/' || o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS mdate,
  'A & Müller' || CASE WHEN o_orderkey % 2 = 0 THEN ',' || o_orderpriority ELSE '' END AS editor, CASE WHEN o_orderkey % 5 <> 0 THEN 'Days ' || o_orderkey END AS title,
  CAST(year(o_orderdate) AS VARCHAR) AS year, 'https://doi.org/10.1/' || o_orderkey || ',https://x.org' AS ee, 'LN' AS series,
  CASE WHEN o_orderkey % 3 = 0 THEN 'informal' END AS publtype, NULL AS note FROM orders
UNION ALL SELECT 'article', 'journals/' || s_suppkey, '2020-01-01', NULL, s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'www', NULL, '2020-02-02', NULL, n_name, NULL, NULL, NULL, NULL, trim(repeat(n_name || ' > ', 5000)) FROM nation""",
)
def xml_kinds(t: Tables):
    columns = ["kind", "key", "mdate", "editor", "title", "year", "ee", "series", "publtype", "note"]
    return files.xml_records(t.spark, _bibliography(t)).select(*columns)


def _volumes(t: Tables) -> str:
    n = F.col("o_orderkey")
    lines = t.orders.select(
        F.concat(
            F.lit("<d:volume>"), tag("d:title", F.concat(F.lit("Days "), text(n))),
            F.when(n % 3 == 0, tag("d:title", F.lit("Second title"))).otherwise(""), tag("d:shortTitle", text("o_custkey")),
            F.when(n % 4 != 0, tag("d:date", text(F.to_date("o_orderdate")))).otherwise(""), tag("d:location", F.col("o_orderpriority")),
            tag("d:conference", F.concat(tag("d:dblp", F.concat(F.lit("conf/"), text("o_custkey"))), F.when(n % 2 == 0, tag("d:website", F.lit("http://x"))).otherwise(""))),
            F.lit("</d:volume>"),
        ).alias("value")
    )
    return _write_lines(lines, "volumes")


_VOLUMES = """SELECT 'Days ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '⇹Second title' ELSE '' END AS title, CAST(o_custkey AS VARCHAR) AS "shortTitle",
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderpriority AS location, 'conf/' || o_custkey AS dblp,
  CASE WHEN o_orderkey % 2 = 0 THEN 'http://x' END AS website FROM orders"""


@query("s4_drops_volumes", _VOLUMES)
def drops_volumes(t: Tables):
    return files.proceedings_volumes(t.spark, _volumes(t), "d:volume")


@query("s2_xml_entities", f"SELECT title, website FROM ({_VOLUMES})")
def xml_entities(t: Tables):
    properties = {"title": F.col("title"), "website": F.col("conference.website")}
    return files.xml_entities(t.spark, _volumes(t), "d:volume", "title array<string>, conference struct<website:array<string>>", properties)


@query(
    "s3_ftx_documents",
    with_proxies(
        "proceedings",
        """SELECT ppn, doi, publisher, bk, 'author⇹sponsor' AS "corporateCreatorTypes", 'g' || publisher || '⇹s1' AS "gndIds", 'g' || publisher AS "authorGndId",
  's1' AS "sponsorGndId", 'Club A⇹Club B' AS "corporateCreatorNames", 'Vol ' || orderId AS title, genreCode AS "documentGenreCode", '004' AS ddc FROM proceedings""",
    ),
)
def ftx_documents(t: Tables):
    codes = F.transform(F.split("bk", "⇹"), lambda c: F.concat(F.lit('<classification classificationName="bk"><code>'), c, F.lit("</code></classification>")))
    lines = p.proceedings(t).select(
        F.concat(
            F.lit('<document xmlns="http://example.org/oai" xmlns:dc="http://purl.org/dc/elements/1.1/">'),
            tag("formalInfo", tag("documentGenreCode", F.col("genreCode"))),
            tag("identifiers", F.concat(tag("identifier", F.col("ppn"), ' type="ppn"'), tag("identifier", F.col("doi"), ' type="doi"'))),
            F.lit('<corporateCreator type="author"><name>Club A</name><corporateIDs><corporateID type="gnd">g'), "publisher",
            F.lit('</corporateID><corporateID type="other">x</corporateID></corporateIDs></corporateCreator>'),
            F.lit('<corporateCreator type="sponsor"><name>Club B</name><corporateIDs><corporateID type="gnd">s1</corporateID></corporateIDs></corporateCreator>'),
            tag("bibliographicInfo", F.concat(tag("dc:title", F.concat(F.lit("Vol "), "orderId")), tag("publicationInfo", tag("dc:publisher", F.col("publisher"))))),
            tag("classificationInfo", tag("classifications", F.concat(
                F.coalesce(F.concat_ws("", codes), F.lit("")), F.lit('<classification classificationName="ddc"><code>004</code></classification>')))),
            F.lit("</document>"),
        ).alias("value")
    )
    found = files.catalogue_documents(t.spark, _write_packed(lines, "catalogue"))
    return found.select(
        "ppn", "doi", "publisher", "bk", "corporateCreatorTypes", "gndIds", "authorGndId", "sponsorGndId", "corporateCreatorNames", "title", "documentGenreCode", "ddc"
    )


PAGE_ROWS = 1000  # rows of a response page or batch, as the services send them


def _pages_of(rows: DataFrame, number, name: str) -> DataFrame:
    """Rows as arrays of at most ``PAGE_ROWS`` records with adjacent unique numbers."""
    struct = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.floor(number / PAGE_ROWS).alias("page")).agg(F.collect_list(struct).alias(name))


def _work_pages(t: Tables) -> str:
    pages = _pages_of(raw_crossref(t), F.substring_index("DOI", "/", -1).cast("long"), "items")
    ok = pages.select(F.lit("ok").alias("status"), F.struct("items").alias("message"))
    failed = pages.select(F.lit("failed").alias("status"), F.struct("items").alias("message"))
    path = staging_path(t.spark, "works")
    ok.unionByName(failed).write.json(path)
    return path


@query(
    "s5_crossref_pages",
    with_proxies(
        "event_orders",
        """SELECT '10.1/' || eventId AS "eventId", 'Third Köln Days of ' || series AS title, year, CASE WHEN CAST(eventId AS BIGINT) % 3 = 0 THEN startDate END AS "startDate" FROM event_orders""",
    ),
)
def crossref_pages(t: Tables):
    return clean_crossref(files.work_pages(t.spark, _work_pages(t))).select("eventId", "title", "year", "startDate")


@query("s19_crossref_titles", with_proxies("event_orders", """SELECT 'Third K\\"oln Days of ' || series AS title FROM event_orders"""))
def crossref_titles(t: Tables):
    path = _write_lines(files.work_titles(t.spark, _work_pages(t)), "titles")
    return t.spark.read.text(path).withColumnRenamed("value", "title")


@query(
    "s6_confref_json",
    with_proxies("event_orders", "SELECT eventId, series || ' & friends' AS title, ordinal, year, lower(series) AS \"seriesId\", city || ',' || country AS location FROM event_orders"),
)
def confref_json(t: Tables):
    arrays = _pages_of(raw_confref(t), F.col("id").cast("long"), "rows").select(F.to_json("rows").alias("value"))
    raw = files.conference_list(t.spark, _write_lines(arrays, "conferences"))
    return clean_confref(raw).select("eventId", "title", "ordinal", "year", "seriesId", "location")


def _calls(t: Tables):
    """Raw call records, one per event, some deleted and some spam."""
    n = F.col("event_id")
    base = t.events.select(
        text(n).alias("eventId"), F.concat(F.lit("U"), text("user_id")).alias("acronym"), F.concat(F.lit("Call "), text(n)).alias("title"),
        F.when(n % 13 == 0, "1 spam").otherwise(F.col("event_type")).alias("locality"), F.lit(None).cast("string").alias("seriesId"),
        F.to_date("ts").alias("startDate"), F.to_date("ts").alias("endDate"), (n % 11 == 0).alias("deleted"),
        F.lit(None).cast("string").alias("url"), n.cast("int").alias("wikiCfpId"),
    )
    return base


def _write_batches(t: Tables) -> str:
    """Batches of ``PAGE_ROWS`` ids, one folder each."""
    path = staging_path(t.spark, "batches")
    first = F.floor(F.col("wikiCfpId") / PAGE_ROWS) * PAGE_ROWS
    name = F.concat(F.lit("wikicfp_event"), text(first), F.lit("-"), text(first + PAGE_ROWS - 1))
    _calls(t).withColumn("batch", name).repartition("batch").write.partitionBy("batch").json(path)
    return path


@query(
    "s7_crawl_batches",
    "SELECT CAST(event_id AS VARCHAR) AS \"eventId\", 'Call ' || event_id AS title, 'wikicfp_event' || (event_id // 1000 * 1000) || '-' || (event_id // 1000 * 1000 + 999) AS batch FROM events",
)
def crawl_batches(t: Tables):
    found = files.crawl_batches(t.spark, f"{_write_batches(t)}/*")
    return found.select("eventId", "title", F.regexp_extract("batchFile", "batch=([^/]+)/", 1).alias("batch"))


@query(
    "t1_crawl_ingest",
    """WITH c AS (SELECT *, CAST(event_id AS VARCHAR) AS e FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
SELECT coalesce(c.e, s.k) AS "eventId", CASE WHEN c.e IS NULL THEN 'old' ELSE 'Call ' || c.e END AS title, event_type AS locality,
  CAST(CASE WHEN c.e IS NULL THEN 1990 ELSE year(ts) END AS INTEGER) AS year,
  CASE WHEN c.e IS NOT NULL THEN 'http://www.wikicfp.com/cfp/servlet/event.showcfp?eventid=' || c.e END AS url
FROM c FULL JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'C' || c_custkey END AS k FROM customer) s ON s.k = c.e""",
)
def crawl_ingest(t: Tables):
    table, checkpoint = staging_path(t.spark, "calls"), staging_path(t.spark, "ingest")
    crawl.ingest(t.spark, f"{_write_batches(t)}/*", table, checkpoint, files_per_batch=1000)
    n = F.col("c_custkey")
    existing = t.customer.select(
        F.when(n % 2 == 0, text(n)).otherwise(F.concat(F.lit("C"), text(n))).alias("eventId"), F.lit("old").alias("title"), F.lit(1990).alias("year")
    )
    state = crawl.current_state(existing, crawl.latest(t.spark, table))
    return state.select("eventId", "title", "locality", "year", "url")


@query(
    "s8_csv_in",
    """WITH u AS (SELECT 'C' || (s_suppkey * 3) AS acronym, s_name || ', "x"' AS title FROM supplier), s AS (SELECT 'C' || c_custkey AS acronym, c_name AS title, c_mktsegment AS segment FROM customer)
SELECT coalesce(s.acronym, u.acronym) AS acronym, coalesce(u.title, s.title) AS title, segment FROM s FULL JOIN u ON s.acronym = u.acronym""",
)
def csv_in(t: Tables):
    path = staging_path(t.spark, "csv")
    n = F.col("s_suppkey")
    rows = t.supplier.select(F.concat(F.lit("C"), text(n * 3)).alias("acronym"), F.concat("s_name", F.lit(', "x"')).alias("title"), n.alias("position"))
    files.write_csv(rows, path, ["acronym", "title", "position"])
    return files.csv_upsert(p.series_orders(t), path, "acronym string, title string, position bigint", "acronym", "position")


@query(
    "s9_csv_out",
    with_proxies("event_orders", "SELECT eventId || ';' || series || ';' || year || ';' || coalesce(title, '') AS line FROM event_orders WHERE year > 1996"),
)
def csv_out(t: Tables):
    path = staging_path(t.spark, "csv")
    files.write_csv(p.event_orders(t), path, ["eventId", "series", "year", "title"], selector=F.col("year") > 1996, separator=";")
    return t.spark.read.text(path).where("value <> 'eventId;series;year;title'").select(F.col("value").alias("line"))


_TEMPLATE = {"Acronym": "acronym", "Series": "series", "Title": "title", "Year": "year", "City": "city", "Start date": "startDate", "Ordinal": "ordinal"}


@query(
    "s11_wiki_render",
    with_proxies(
        "event_orders",
        """SELECT eventId, '{{Event' || coalesce(chr(10) || '|Acronym=' || acronym, '') || chr(10) || '|Series=' || series || coalesce(chr(10) || '|Title=' || title, '')
  || chr(10) || '|Year=' || year || coalesce(chr(10) || '|City=' || city, '') || chr(10) || '|Start date=' || startDate || coalesce(chr(10) || '|Ordinal=' || ordinal, '') || chr(10) || '}}' AS markup FROM event_orders""",
    ),
)
def wiki_render(t: Tables):
    return p.event_orders(t).select("eventId", files.render_template("Event", _TEMPLATE).alias("markup"))


@query(
    "s10_wiki_templates",
    with_proxies(
        "event_orders",
        'SELECT eventId AS "pageTitle", acronym, \'{{S|\' || series || \'}}\' AS "inEventSeries", \'[[\' || title || \'|day]]\' AS title, CAST(year AS VARCHAR) AS year, city, CAST(startDate AS VARCHAR) AS "startDate", CAST(ordinal AS VARCHAR) AS ordinal FROM event_orders',
    ),
)
def wiki_templates(t: Tables):
    # pages as a backup table of (pageTitle, wikiMarkup); page files are read by files.read_wiki_files
    path = staging_path(t.spark, "wiki")
    markup = F.concat(F.lit("Intro {{Other|Title=no}}\n"), files.render_template("Event", _TEMPLATE), F.lit("\ntext = x | y"))
    nested = p.event_orders(t).withColumns(
        {"series": F.concat(F.lit("{{S|"), "series", F.lit("}}")), "title": F.concat(F.lit("[["), "title", F.lit("|day]]"))}
    )
    nested.select(F.col("eventId").alias("pageTitle"), markup.alias("wikiMarkup")).write.parquet(path)
    pages = t.spark.read.schema("pageTitle string, wikiMarkup string").parquet(path)
    parsed = files.parse_template(pages, "Event", list(_TEMPLATE))
    return rename_properties(parsed.drop("wikiMarkup"), EVENT_TEMPLATE_PROPERTIES, include=["pageTitle"])


@query(
    "j15_export_series",
    with_proxies(
        "event_orders series_orders",
        """SELECT lower(acronym) AS series, 'series' AS kind, lower(acronym) AS "pageId", '{{Event series' || chr(10) || '|Acronym=' || acronym || chr(10) || '|DblpSeries=' || lower(acronym) || chr(10) || '}}' AS markup FROM series_orders
UNION ALL SELECT lower(series), 'event', eventId, '{{Event' || coalesce(chr(10) || '|Title=' || title, '') || chr(10) || '|Year=' || year || chr(10) || '|Series=' || series || chr(10)
  || '|DblpConferenceId=' || lower(series) || '/' || eventId || chr(10) || '}}' FROM event_orders""",
    ),
)
def export_series(t: Tables):
    events = p.event_orders(t).select(
        "eventId", F.lower("series").alias("series"), "title", "year",
        F.concat(F.lit("https://dblp.org/db/conf/"), F.lower("series"), F.lit("/"), "eventId", F.lit(".html")).alias("url"),
    )
    series = p.series_orders(t).select("acronym", F.lower("acronym").alias("series"))
    return files.export_series(series, events, "series", {"Title": "title", "Year": "year"}, "url")


_TRIPLES = """SELECT CASE WHEN p = 'part' THEN '_:b' ELSE 'http://x/' END || s AS s, 'http://x/' || p AS p,
  CASE WHEN p = 'supplier' THEN 'http://x/' ELSE '' END || o || CASE WHEN p = 'supplier' THEN '' ELSE ' "ü" .' || chr(10) || '\\' END AS o, lang FROM triples"""


def _marked_triples(t: Tables):
    """Triples with blank subjects, and objects that need escapes."""
    link = F.col("p") == "supplier"
    return p.triples(t).withColumn("o", F.when(link, F.col("o")).otherwise(F.concat("o", F.lit(' "ü" .\n\\'))))


@query("s17_rdf_triples", with_proxies("triples", _TRIPLES))
def rdf_triples(t: Tables):
    lines = files.triple_lines(_marked_triples(t), "http://x/", F.col("p") == "supplier", F.col("p") == "part")
    return files.read_triples(t.spark, _write_lines(lines, "triples"))


_TWO_FILES = """SELECT h || s AS s, h || p AS p, CASE WHEN p = 'supplier' THEN h || o ELSE o || ' "ü" .' || chr(10) || '\\' END AS o, lang
FROM (SELECT *, CASE WHEN length(s) % 2 = 0 THEN 'http://y/z/' ELSE 'http://x/' END AS h FROM triples WHERE p <> 'part')"""


@query("s17_rdf_turtle", with_proxies("triples", _TWO_FILES))
def rdf_turtle(t: Tables):
    """The same triples as Turtle, one statement for each subject: prefixed names, lists, long
    literals, and two kinds of files, in which one prefix has different meanings."""
    rows = _marked_triples(t).where("p <> 'part'")
    long = F.concat(F.lit('"""'), F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"""'))
    text = F.when(F.col("lang") == "de", long).otherwise(F.concat(F.lit('"'), files.escaped(F.col("o")), F.lit('"')))
    literal = F.concat(text, F.coalesce(F.concat(F.lit("@"), "lang"), F.lit("")))
    value = F.when(F.col("p") == "supplier", F.concat(F.lit("x:"), "o")).otherwise(literal)
    lists = rows.groupBy("s", "p").agg(F.array_join(F.collect_list(value), ", ").alias("o"))
    bodies = lists.groupBy("s").agg(F.array_join(F.collect_list(F.concat(F.lit("x:"), "p", F.lit(" "), "o")), " ;\n  ").alias("body"))
    even = F.length("s") % 2 == 0
    head = F.when(even, "@base <http://y/> .\n@prefix x: <z/> .\n").otherwise("PREFIX x: <http://x/>\n")
    statements = bodies.select(even.alias("even"), F.concat(head, F.lit("x:"), "s", F.lit("\n  "), "body", F.lit(" .")).alias("value"))
    path = staging_path(t.spark, "turtle")
    statements.write.partitionBy("even").text(path)
    return files.read_turtle(t.spark, path).select("s", "p", "o", "lang")


@query(
    "s18_tib_json_search",
    with_proxies(
        "event_orders",
        """SELECT title, series || ' ; ' || ordinal AS event, CAST(startDate AS VARCHAR) AS starttime, CAST(endDate AS VARCHAR) AS endtime, CAST(year AS VARCHAR) AS pubyear,
  CASE WHEN CAST(eventId AS BIGINT) % 2 = 0 THEN '54.72' END AS bk, eventId AS ppn, CASE WHEN CAST(eventId AS BIGINT) % 3 = 0 THEN '10.1/' || eventId END AS doi
FROM event_orders WHERE title LIKE '%Proceedings%' AND series = 'C5' AND ordinal IS NOT NULL""",
    ),
)
def tib_json_search(t: Tables):
    n = F.col("eventId").cast("long")
    null = F.lit(None).cast("string")
    field = lambda name, code: F.struct(F.lit(name).alias("@classificationName"), code.alias("code"))
    ident = lambda kind, value: F.struct(F.lit(kind).alias("@type"), value.alias("#text"))
    event = F.struct(
        F.struct(
            F.col("title"), F.array(null).alias("alternativeTitles"),
            F.struct(
                F.concat("series", F.lit(" ; "), text("ordinal")).alias("name"), F.array(null).alias("dc:description"),
                F.struct(F.array(text("startDate"), text("endDate")).alias("dc:date")).alias("dates"), F.struct(F.array("nation").alias("place")).alias("places"),
            ).alias("conferenceInfo"),
            text("year").alias("pubyear"), null.alias("pubplace"), null.alias("publisher"),
        ).alias("bib"),
        F.when(n % 2 == 0, F.array(field("ddc", F.lit("004")), field("bk", F.lit("54.72")))).otherwise(F.array(field("ddc", F.lit("004")))).alias("fields"),
        F.when(n % 3 == 0, F.array(ident("ppn", F.col("eventId")), ident("doi", F.concat(F.lit("10.1/"), "eventId")))).otherwise(F.array(ident("ppn", F.col("eventId")))).alias("ids"),
    )
    path = staging_path(t.spark, "library")
    p.event_orders(t).select(event.alias("event")).write.json(path)
    return files.library_search(t.spark, path, "Proceedings", "C5").select("title", "event", "starttime", "endtime", "pubyear", "bk", "ppn", "doi")


_FOUND = ", found AS (SELECT * FROM corpus WHERE lookupAcronym LIKE '_7 %')"


@query(
    "s20_esc_simplify",
    with_proxies(
        "event_orders event_stream",
        _DUCK_CORPUS + _FOUND + """ SELECT source, year, ordinal, title, eventId, NULL AS region, NULL AS country, NULL AS city, city AS "cityLabel", NULL AS url FROM found""",
    ),
)
def esc_simplify(t: Tables):
    return files.simplify_result(event_series_lookup(corpus(t), "_7"))


@query("s21_result_out", with_proxies("event_orders event_stream", _DUCK_CORPUS + _FOUND + " SELECT source, eventId, year, number FROM found"))
def result_out(t: Tables):
    path = staging_path(t.spark, "result")
    files.write_by_source(event_series_lookup(corpus(t), "_7"), path)
    return t.spark.read.schema("eventId string, year int, number int, source string").json(path).select("source", "eventId", "year", "number")
