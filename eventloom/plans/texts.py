"""Queries: values read out of titles, descriptions, ISBNs, words and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.fixed_values import ORDINAL_WORDS, TENS_WORDS, TITLE_CITIES, TITLE_COUNTRIES, TITLE_PROVINCES, TITLE_VOCABULARY
from eventloom.functions import dates, titles
from eventloom.functions.text import isbn_type, to_isbn13
from eventloom.operators import calls, words
from eventloom.plans import proxies as p
from eventloom.plans.cleaning import day_span, raw_descriptions, text
from eventloom.plans.lookup import _SCORE
from eventloom.plans.proxies import Tables, with_proxies
from eventloom.plans.registry import Family
from eventloom.session import staging_path
from eventloom.sources import pages as html

FAMILY = Family()
query = FAMILY.query


@query(
    "x1_range_from_title",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) % 4 AS k, day(startDate) <= 30 AND day(endDate) <= least(30, day(last_day(startDate))) AS ok
  FROM event_orders)
SELECT "eventId", CASE WHEN k = 0 OR (k < 3 AND ok) THEN year END AS year, CASE WHEN k IN (1, 2) AND ok THEN startDate END AS "startDate",
  CASE WHEN k IN (1, 2) AND ok THEN make_date(year, month(startDate), day(endDate)) END AS "endDate" FROM b""",
    ),
)
def range_from_title(t: Tables):
    k = F.col("eventId").cast("long") % 4
    tail = (
        F.when(k == 0, text("year"))
        .when(k == 1, F.concat(F.lit(" "), day_span("startDate", "endDate"), F.lit(" .")))
        .when(k == 2, F.concat(F.lit("  "), day_span("startDate", "endDate", suffix="th")))
        .otherwise(" in spring")
    )
    title = F.concat(F.lit("Proceedings of "), "series", F.lit(", "), "nation", F.lit(","), tail)
    return p.event_orders(t).select("eventId", dates.title_range(title).alias("r")).select("eventId", "r.*")


@query(
    "x2_range_from_text",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) % 7 AS k FROM event_orders)
SELECT "eventId", CASE WHEN k < 6 THEN year END AS year, CASE WHEN k IN (2, 3, 4, 5) THEN startDate END AS "startDate",
  CASE WHEN k = 3 THEN endDate WHEN k = 4 AND day(endDate) <= day(last_day(startDate)) THEN make_date(year, month(startDate), day(endDate))
  WHEN k = 5 AND (month(endDate) <> 2 OR day(endDate) < 29 OR year % 4 = 0) THEN make_date(year, month(endDate), day(endDate)) END AS "endDate" FROM b""",
    ),
)
def range_from_text(t: Tables):
    k = F.col("eventId").cast("long") % 7
    fmt = lambda column, f: F.date_format(column, f)
    day = (
        F.when(k == 0, text("year"))
        .when(k == 1, F.concat(text("year"), F.lit("-"), text(F.col("year") + 1)))
        .when(k == 2, F.concat(fmt("startDate", "dd.MM.yyyy"), F.lit("-")))
        .when(k == 3, F.concat(fmt("startDate", "dd.MM.yyyy"), F.lit("-"), fmt("endDate", "dd.MM.yyyy")))
        .when(k == 4, F.concat(fmt("startDate", "yyyy.MM.dd"), F.lit("-"), fmt("endDate", "dd")))
        .when(k == 5, F.concat(fmt("startDate", "yyyy.MM.dd"), F.lit("-"), fmt("endDate", "MM.dd")))
        .otherwise("1999 May")
    )
    return p.event_orders(t).select("eventId", dates.text_range(day).alias("r")).select("eventId", "r.*")


@query(
    "x3_parse_description",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) % 2 AS k FROM event_orders)
SELECT "eventId", CASE WHEN k = 0 THEN series WHEN ordinal IS NOT NULL THEN 'Long ' || series END AS acronym, ordinal,
  CASE WHEN ordinal IS NOT NULL THEN nation END AS location, CASE WHEN ordinal IS NOT NULL THEN startDate END AS "startDate" FROM b""",
    ),
)
def parse_description(t: Tables):
    rows = raw_descriptions(t).select("eventId", titles.description(F.get("description", F.lit(0))).alias("d"))
    return rows.select("eventId", "d.acronym", "d.ordinal", "d.location", "d.startDate")


@query(
    "x4_parse_fulltitle",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) % 5 AS k FROM event_orders)
SELECT "eventId", CASE WHEN k < 4 THEN 'Days of ' || series END AS title, CASE WHEN k = 3 THEN 'Club ' END AS organization,
  CASE WHEN k IN (2, 3) THEN ordinal END AS ordinal, CASE WHEN k < 4 THEN year END AS year, CASE WHEN k IN (1, 2, 3) THEN nation END AS location FROM b""",
    ),
)
def parse_fulltitle(t: Tables):
    k = F.col("eventId").cast("long") % 5
    year = text("year")
    number = F.coalesce(text("ordinal"), F.lit("?"))
    inner = (
        F.when(k == 0, F.concat(year, F.lit(" - 2009")))
        .when(k == 1, F.concat_ws(" : ", year, "nation"))
        .when(k == 2, F.concat_ws(" : ", F.concat(number, F.lit(".")), year, "nation"))
        .otherwise(F.concat_ws(" : ", F.lit("Club"), number, year, "nation"))
    )
    full = F.concat(F.lit("Days of "), "series", F.when(k < 4, F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""))
    rows = p.event_orders(t).select("eventId", titles.fulltitle(full).alias("f"))
    return rows.select("eventId", "f.title", "f.organization", "f.ordinal", "f.year", "f.location")


@query(
    "x5_parse_ordinal",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 = 7 OR (o_orderkey % 4 = 3 AND o_custkey % 99 < 2) THEN o_custkey % 99 + 1
  WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 < 2 THEN o_custkey % 99 + 1
  ELSE o_custkey % 9 + 21 END AS INTEGER) AS ordinal FROM orders""",
)
def parse_ordinal(t: Tables):
    key, n = F.col("o_orderkey"), F.col("o_custkey") % 99 + 1
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    units = F.array(*[F.lit(w) for w in ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth")])
    word = F.concat(F.lit("Twenty-"), F.element_at(units, (F.col("o_custkey") % 9 + 1).cast("int")))
    title = (
        F.when(key % 4 < 2, F.concat(text(n), suffix, F.lit(" Conference (C 2008), 1999")))
        .when(key % 4 == 2, F.concat(F.lit("Proceedings of the "), word, F.lit(" Workshop")))
        .when(key % 8 == 7, F.concat(text(n), F.lit(". Workshop")))
        .otherwise(F.concat(F.lit("Workshop "), text(n)))
    )
    return t.orders.select("o_orderkey", titles.first_ordinal(title).alias("ordinal"))


@query(
    "x6_isbn",
    """WITH b AS (SELECT *, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS a FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ISBN-13' WHEN 1 THEN 'ISBN-10' WHEN 2 THEN 'ISBN-13' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN '978-1-' || a || '-2047-6' WHEN 1 THEN '978-1-' || a || '-0225-X' WHEN 2 THEN '' END AS isbn13 FROM b""",
)
def isbn(t: Tables):
    key = F.col("p_partkey")
    group = F.lpad(text(key % 10000), 4, "0")
    value = (
        F.when(key % 4 == 0, F.concat(F.lit("978-1-"), group, F.lit("-2047-6")))
        .when(key % 4 == 1, F.concat(F.lit("1-"), group, F.lit("-0225-X"))).when(key % 4 == 2, "").otherwise("2022-01-01")
    )
    return t.part.select("p_partkey", isbn_type(value).alias("kind"), to_isbn13(value).alias("isbn13"))


@query("x7_title_score", with_proxies("event_orders", f"SELECT eventId, title, {_SCORE} AS score FROM event_orders"))
def title_score(t: Tables):
    return p.event_orders(t).select("eventId", "title", titles.title_score(F.col("title")).alias("score"))


@query(
    "x8_volume_number",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 0 THEN nullif(o_custkey % 100, 0)
  WHEN o_orderkey % 5 = 1 THEN o_custkey % 8 + 1 ELSE o_custkey % 4 + 1 END AS INTEGER) AS volume FROM orders""",
)
def volume_number(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    letter = F.substring(F.lit("ABCDEFGH"), (cust % 8 + 1).cast("int"), F.lit(1))
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (cust % 4 + 1).cast("int"))
    title = F.concat(
        F.lit("Papers, "),
        F.when(key % 5 == 0, F.concat(F.lit("volume "), text(cust % 100))).when(key % 5 == 1, F.concat(F.lit("[Part] "), letter))
        .when(key % 5 == 2, F.concat(F.lit("Vol."), roman)).when(key % 5 == 3, F.concat(F.lit("pt. "), roman, F.lit(" of 9")))
        .otherwise("volumes"),
    )
    return t.orders.select("o_orderkey", titles.volume_number(title).alias("volume"))


@query(
    "x9_acronym_split",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS series FROM part",
)
def acronym_split(t: Tables):
    key = F.col("p_partkey")
    acronym = F.when(key % 3 == 0, F.concat("p_type", text(key))).when(key % 3 == 1, F.concat_ws(" ", "p_type", text(key))).otherwise(
        F.concat("p_type", F.lit(" x "), text(key)))
    return t.part.select("p_partkey", titles.series_acronym(acronym).alias("series"))


_WORDS = """WITH w AS (SELECT doc_id, string_split(translate(text, '/()#,;-@''´`', '           '), ' ') AS ws FROM documents),
  p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)"""


@query("x10_title_words", _WORDS + " SELECT word, count(*) AS count, count(DISTINCT doc_id) AS titles FROM p GROUP BY 1")
def title_words(t: Tables):
    found = t.documents.select("doc_id", F.explode(titles.title_words(F.col("text"))).alias("word"))
    per_title = found.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_title.groupBy("word").agg(F.sum("n").alias("count"), F.count("*").alias("titles"))


_PLACES = [(name, "city") for name in TITLE_CITIES] + [(name, "province") for name in TITLE_PROVINCES] + [(name, "country") for name, _ in TITLE_COUNTRIES]
_CATEGORIES = ", ".join(f"""('{word.replace("'", "''")}', '{kind}')""" for word, kind in TITLE_VOCABULARY + _PLACES)
_ITEMS = ", ".join(f"('{name}', '{item}')" for name, item in TITLE_COUNTRIES)

# ordinals and months by rules of their own; entries split as titles are
_DICTIONARY = f""", n(v) AS (SELECT unnest(range(1, 100))),
  words(i, one) AS (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(ORDINAL_WORDS, 1))}),
  tens(i, ten) AS (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(TENS_WORDS, 2))}),
  spelt AS (SELECT one AS w, i AS v FROM words UNION ALL SELECT left(ten, -1) || 'ieth', 10 * i FROM tens
    UNION ALL SELECT ten || '-' || one, 10 * tens.i + words.i FROM tens, words WHERE words.i < 10),
  roman AS (SELECT v, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][v // 10 + 1]
    || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1] AS w FROM n),
  entries AS (SELECT * FROM (VALUES {_CATEGORIES}) AS c(entry, type), (SELECT NULL AS value)
    UNION ALL SELECT w, 'enum', v FROM spelt
    UNION ALL SELECT array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-'), 'enum', v FROM spelt
    UNION ALL SELECT v || '.', 'enum', v FROM n UNION ALL SELECT w || '.', 'enum', v FROM roman
    UNION ALL SELECT v || CASE WHEN v // 10 = 1 THEN 'th' WHEN v % 10 = 1 THEN 'st' WHEN v % 10 = 2 THEN 'nd' WHEN v % 10 = 3 THEN 'rd' ELSE 'th' END, 'enum', v FROM n
    UNION ALL SELECT * FROM (VALUES ('1', 'enum', 1), ('2', 'enum', 2), ('11st', 'enum', 11), ('12nd', 'enum', 12), ('13rd', 'enum', 13), ('21th', 'enum', 21),
      ('31th', 'enum', 31), ('41th', 'enum', 41), ('51th', 'enum', 51), ('II', 'enum', 2), ('III', 'enum', 3), ('Eight', 'enum', 8),
      ('Twenty-third', 'enum', 23), ('Twenty-seventh', 'enum', 27))
    UNION ALL SELECT monthname(make_date(2000, CAST(v AS INTEGER), 1)), 'month', v FROM n WHERE v < 13
    UNION ALL SELECT CAST(y AS VARCHAR), 'year', y FROM range(1960, 2030) r(y)),
  items(name, item) AS (VALUES {_ITEMS}),
  d AS (SELECT trim(regexp_replace(translate(entry, '/()#,;-@''´`', '           '), ' +', ' ', 'g')) AS word, type, value, item
    FROM entries LEFT JOIN items ON name = entry AND type = 'country')"""


_LINES = "('10. Workshop XIV. held at Rome, New York City, (California) and Great Britain / Québec in 1999 ' || chr(10) || text)"


@query(
    "x11_title_annotate",
    _WORDS.replace("translate(text", f"translate({_LINES}")
    + _DICTIONARY
    + """, f AS (SELECT doc_id, pos, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM p WHERE word <> ''),
  l AS (SELECT doc_id, pos, word, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3, lead(word, 3) OVER w AS w4 FROM f
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, pos, word FROM l UNION ALL SELECT doc_id, pos, word || ' ' || w2 FROM l WHERE w2 IS NOT NULL
    UNION ALL SELECT doc_id, pos, word || ' ' || w2 || ' ' || w3 FROM l WHERE w3 IS NOT NULL
    UNION ALL SELECT doc_id, pos, word || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM l WHERE w4 IS NOT NULL)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, g.word, type, CAST(value AS INTEGER) AS value, item FROM g JOIN d ON g.word = d.word WHERE d.word <> ''""",
)
def title_annotate(t: Tables):
    """Documents behind a line of title words: numbers with full stops, places, a year, and phrases."""
    line = F.lit("10. Workshop XIV. held at Rome, New York City, (California) and Great Britain / Québec in 1999 \n")
    titled = t.documents.select("doc_id", F.concat(line, "text").alias("text"))
    return words.annotate(titled, "doc_id", "text")


def _place():
    """Names of two words, every seventh of five, with a hyphen and an apostrophe."""
    return F.when(F.col("p_partkey") % 7 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" of th' coast"))).otherwise(F.col("p_name"))


def _held_in(t: Tables):
    """Titles of line items that name their part."""
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("titleId"),
        F.concat(F.lit("Proceedings, held in "), _place(), F.lit(", "), F.col("p_type"), F.lit(" ring")).alias("title"),
    )


@query(
    "x12_city_phrases",
    """WITH n AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS "titleId", p_name, p_partkey % 7 = 0 AS far
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT "titleId", 3 AS pos, 2 AS length, p_name AS city FROM n WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 7 <> 0)
UNION ALL SELECT "titleId", 3, 5, replace(p_name, ' ', '-') || ' of th'' coast' FROM n WHERE far
UNION ALL SELECT "titleId", CASE WHEN far THEN 9 ELSE 6 END, 1, 'ring' FROM n UNION ALL SELECT "titleId", 4, 1, 'ring' FROM n WHERE p_name LIKE '% ring'""",
)
def city_phrases(t: Tables):
    names = t.part.select(_place().alias("city")).unionByName(
        t.part.where("p_name LIKE '% ring'").select(F.substring_index("p_name", " ", -1).alias("city"))
    )
    return words.city_phrases(_held_in(t), "titleId", "title", names)


@query(
    "x13_month_day",
    with_proxies("event_orders", 'SELECT eventId, CAST(month(startDate) * 100 + day(startDate) AS INTEGER) AS "monthDay" FROM event_orders'),
)
def month_day(t: Tables):
    return p.event_orders(t).select("eventId", dates.month_day(F.col("startDate")).alias("monthDay"))


#: Rendered pages of a task; an order is a small row, so a split of them makes very many pages.
PAGES_A_TASK = 20_000


def call_pages(t: Tables):
    """A call page per order with embedded triples; every ninth page says it was deleted.

    The orders are spread over tasks by their number before they become pages.
    """
    tasks = max(t.spark.sparkContext.defaultParallelism, t.orders.count() // PAGES_A_TASK)
    e = p.event_orders(t).repartition(tasks, "eventId")
    n = F.col("eventId").cast("long")
    stamp = lambda column: F.concat(text(column), F.lit("T00:00:00"))
    prop = lambda name, value: F.concat(F.lit(f'<span property="v:{name}" content="'), value, F.lit('"></span>'))
    due = F.when(n % 4 == 0, "TBD").otherwise(stamp(F.date_sub("startDate", 90)))
    page = F.concat(
        F.lit('<html><body><div typeof="v:Event">'),
        prop("summary", F.concat(F.lit(" "), "series", F.lit(" "), text("year"))),
        prop("eventType", F.lit("Conference")),
        prop("startDate", stamp("startDate")),
        prop("endDate", stamp("endDate")),
        F.lit('<p typeof="v:Address"><span property="v:locality">'), "nation", F.lit("</span></p>"),
        prop("description", F.concat("series", F.lit(" : Days &amp; Nights"))),
        prop("summary", F.lit("Submission Deadline")), prop("startDate", due),
        prop("summary", F.lit("Notification Due")), prop("startDate", stamp(F.date_sub("startDate", 30))),
        F.lit('</div><p>Link: <a href="http://'), F.lower("series"), F.lit('.example.org">home</a></p><a href="/cfp/program?id='),
        F.substring("series", 2, 20), F.lit('&amp;s=x">Series of '), "series", F.lit("</a></body></html>"),
    )
    gone = F.lit("<html><body><h2>Call</h2><h3>This item has been deleted!</h3><h3>x</h3></body></html>")
    return e.select("eventId", F.when(n % 9 == 0, gone).otherwise(page).alias("html"))


def _stored_pages(t: Tables):
    """The call pages as a crawler stores them: one JSON line a page."""
    path = staging_path(t.spark, "call-pages")
    call_pages(t).write.json(path)
    return t.spark.read.schema("eventId string, html string").json(path)


_CALLS = """, b AS (SELECT *, CAST(eventId AS BIGINT) AS n FROM event_orders WHERE CAST(eventId AS BIGINT) % 9 <> 0)"""


@query(
    "x15_wikicfp_pivot",
    with_proxies(
        "event_orders",
        _CALLS
        + """ SELECT "eventId", series || ' ' || year AS acronym, series || ' : Days & Nights' AS title, 'Conference' AS "eventType",
  nation AS locality, startDate AS "startDate", endDate AS "endDate", CASE WHEN n % 4 > 0 THEN startDate - 90 END AS "Submission_Deadline",
  startDate - 30 AS "Notification_Due", CAST(NULL AS DATE) AS "Final_Version_Due" FROM b""",
    ),
)
def wikicfp_pivot(t: Tables):
    return calls.pivot_pages(html.triple_lists(_stored_pages(t), "eventId", "html"), "eventId")


@query(
    "s16_page_rdfa",
    with_proxies(
        "event_orders",
        _CALLS
        + """, x AS (SELECT "eventId", unnest([{'s': 'v:Event', 'p': 'v:summary', 'o': ' ' || series || ' ' || year},
    {'s': 'v:Event', 'p': 'v:eventType', 'o': 'Conference'}, {'s': 'v:Event', 'p': 'v:startDate', 'o': startDate || 'T00:00:00'},
    {'s': 'v:Event', 'p': 'v:endDate', 'o': endDate || 'T00:00:00'}, {'s': 'v:Event', 'p': 'v:locality', 'o': nation},
    {'s': 'v:Event', 'p': 'v:description', 'o': series || ' : Days & Nights'}, {'s': 'v:Event', 'p': 'v:summary', 'o': 'Submission Deadline'},
    {'s': 'v:Event', 'p': 'v:startDate', 'o': CASE WHEN n % 4 = 0 THEN 'TBD' ELSE startDate - 90 || 'T00:00:00' END},
    {'s': 'v:Event', 'p': 'v:summary', 'o': 'Notification Due'}, {'s': 'v:Event', 'p': 'v:startDate', 'o': startDate - 30 || 'T00:00:00'},
    {'s': 'v:Address', 'p': 'v:locality', 'o': nation}]) AS t, unnest(range(11)) AS pos FROM b)
SELECT "eventId", CAST(pos AS INTEGER) AS pos, t.s, t.p, t.o FROM x""",
    ),
)
def page_rdfa(t: Tables):
    return html.page_triples(call_pages(t), "eventId", "html")


@query("x16_deleted_flag", with_proxies("event_orders", "SELECT eventId, CAST(eventId AS BIGINT) % 9 = 0 AS deleted FROM event_orders"))
def deleted_flag(t: Tables):
    return html.deleted_pages(call_pages(t), "eventId", "html")


@query(
    "s15_page_links",
    with_proxies(
        "event_orders",
        """, b AS (SELECT *, CAST(eventId AS BIGINT) % 9 <> 0 AS ok FROM event_orders)
SELECT "eventId", CASE WHEN ok THEN substr(series, 2) END AS "linkId", CASE WHEN ok THEN '/cfp/program?id=' || substr(series, 2) || '&s=x' END AS href,
  CASE WHEN ok THEN 'Series of ' || series END AS "linkText" FROM b""",
    ),
)
def page_links(t: Tables):
    return html.page_link(call_pages(t), "eventId", "html", r"/cfp/program\?id=([0-9]+).*")


@query(
    "s15_page_link_after_label",
    with_proxies("event_orders", "SELECT eventId, CASE WHEN CAST(eventId AS BIGINT) % 9 <> 0 THEN 'http://' || lower(series) || '.example.org' END AS href FROM event_orders"),
)
def page_link_after_label(t: Tables):
    return html.page_link_after(call_pages(t), "eventId", "html", r"\w*Link:\w*")


@query(
    "s15_first_page_link",
    """SELECT page_id, nullif(regexp_extract(html, '<a href="/([^"]*)">', 1), '') AS "linkId",
  regexp_extract(html, '<a href="(/[^"]*)">', 1) AS href, regexp_extract(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS "linkText" FROM pages""",
)
def first_page_link(t: Tables):
    return html.page_link(t.pages, "page_id", "html", r"/(.+)")


@query(
    "s14_page_fields",
    """SELECT page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', '"') AS title,
  replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '&quot;', '"') AS heading,
  replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&amp;', '&') AS ad, NULL AS nothing FROM pages""",
)
def page_fields(t: Tables):
    fields = [("title", "title", None, None), ("heading", "h1", None, None), ("ad", "div", "class", "ad"), ("nothing", "span", "class", "ad")]
    return html.page_fields(t.pages, "page_id", "html", fields)


def colocated_titles(t: Tables):
    """Titles with one or two event types, ordinals and acronyms; every third is co-located."""
    n = F.col("eventId").cast("long")
    return p.event_orders(t).select(
        "eventId",
        F.concat(
            F.lit("12th International Conference "), "series", F.when(n % 4 == 0, " and Second Workshop").when(n % 4 == 1, " Conference").otherwise(""),
            F.when(n % 3 == 0, F.concat(F.lit(" co-located with C"), text(n % 7))).otherwise(""),
        ).alias("title"),
    )


_COLOCATED = """, b AS (SELECT "eventId", series, CAST(eventId AS BIGINT) AS n FROM event_orders),
  c AS (SELECT *, n % 3 = 0 AS co FROM b)"""


@query(
    "a22_category_distribution",
    with_proxies(
        "event_orders",
        _COLOCATED
        + ' SELECT co AS "coLocated", CAST(CASE WHEN n % 4 < 2 THEN 2 ELSE 1 END AS BIGINT) AS matches, count(*) AS titles FROM c GROUP BY ALL',
    ),
)
def category_distribution(t: Tables):
    return words.category_distribution(colocated_titles(t), "eventId", "title", "eventType")


@query(
    "a22_category_combinations",
    with_proxies(
        "event_orders",
        _COLOCATED
        + """ SELECT CASE WHEN n % 4 = 0 THEN 'conference&workshop' ELSE 'conference' END AS categories, CAST(count_if(co) AS BIGINT) AS "coLocated",
  CAST(count_if(NOT co) AS BIGINT) AS "notCoLocated", count(*) AS total FROM c GROUP BY 1""",
    ),
)
def category_combinations(t: Tables):
    return words.category_combinations(colocated_titles(t), "eventId", "title", "eventType")


@query(
    "a22_contradictions",
    with_proxies(
        "event_orders",
        _COLOCATED
        + """, f AS (SELECT co, n % 4 = 0 AS o, co AND series <> 'C' || (n % 7) AND 'C' || (n % 7) IN (SELECT 'C' || c_custkey FROM customer) AS a FROM c)
SELECT co AS "coLocated", count(*) AS titles, CAST(count_if(o) AS BIGINT) AS "contradictingOrdinals",
  CAST(count_if(a) AS BIGINT) AS "contradictingAcronyms", CAST(count_if(o AND a) AS BIGINT) AS "contradictingBoth" FROM f GROUP BY 1""",
    ),
)
def contradictions(t: Tables):
    return words.contradictions(colocated_titles(t), "eventId", "title", p.series_orders(t))
