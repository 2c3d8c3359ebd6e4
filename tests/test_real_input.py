"""Input as it is found outside the rendered tables."""

import json
import os
import subprocess
import sys
import time
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from eventloom.functions import titles
from eventloom.operators import calls, locations, matching, quality, stats, words
from eventloom.sources import cutting, files, pages, turtle
from eventloom.streaming import crawl


def test_triples_with_blank_nodes_and_escapes(spark, tmp_path):
    (tmp_path / "a.nt").write_text(
        '_:b1 <u:p> "K\\u00f6ln\\n\\"x\\" \\\\n \\U0001F600 it\\\'s" .\n<u:s> <u:p> _:b1 .\n<u:\\u00e4> <u:p> "tab\\there"@de . # note\n\n# comment\n<u:s><u:p><u:o>.\n'
    )
    assert {tuple(r) for r in files.read_triples(spark, str(tmp_path)).collect()} == {
        ("_:b1", "u:p", 'Köln\n"x" \\n 😀 it\'s', None), ("u:s", "u:p", "_:b1", None), ("u:ä", "u:p", "tab\there", "de"), ("u:s", "u:p", "u:o", None),
    }


def test_a_triple_line_is_matched_once(spark, tmp_path, capsys):
    (tmp_path / "a.nt").write_text('<u:s> <u:p> "$1 \u2028 x"@en .\u2028\n_:b <u:p> "" .\n')
    found = files.read_triples(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("u:s", "u:p", "$1 \u2028 x", "en"), ("_:b", "u:p", "", None)}
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(value") == 1 and "regexp_extract(value" not in plan


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(
        """@prefix gndo: <https://d-nb.info/gndo#> .
PREFIX g: <https://d-nb.info/gnd/>
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .

g:1 a gndo:Conference ;
  gndo:name "Tag; der, \\"X\\" ."@de, "Day"@en ;
  gndo:date "2019"^^xsd:gYear ; gndo:at <http://x/y> .
_:n1 gndo:place g:2, _:n2 .
"""
    )
    found = {tuple(r) for r in files.read_turtle(spark, str(tmp_path)).collect()}
    one, base = "https://d-nb.info/gnd/1", "https://d-nb.info/gndo#"
    assert found == {
        (one, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", base + "Conference", None), (one, base + "name", 'Tag; der, "X" .', "de"),
        (one, base + "name", "Day", "en"), (one, base + "date", "2019", None), (one, base + "at", "http://x/y", None),
        ("_:n1", base + "place", "https://d-nb.info/gnd/2", None), ("_:n1", base + "place", "_:n2", None),
    }


def turtle_rows(spark, folder):
    return sorted((tuple(r) for r in files.read_turtle(spark, str(folder)).collect()), key=repr)


def test_prefixes_belong_to_files(spark, tmp_path):
    """Also where a file changes one, and where a base makes it."""
    (tmp_path / "a.ttl").write_text('@prefix p: <http://a/> .\np:s p:p "1" .\n@prefix p: <http://c/> .\np:s p:p "2" .\n')
    (tmp_path / "b.ttl").write_text('@base <http://b/x/y> .\nPREFIX p: <p#>\np:s <q> <#f>, <> .\n<s1> <q> "z" .\nBASE <http://d/>\n<s1> a p:t .\n')
    b = "http://b/x/"
    assert turtle_rows(spark, tmp_path) == sorted(
        [
            ("http://a/s", "http://a/p", "1", None), ("http://c/s", "http://c/p", "2", None), (b + "p#s", b + "q", b + "y#f", None), (b + "p#s", b + "q", b + "y", None),
            (b + "s1", b + "q", "z", None), ("http://d/s1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", b + "p#t", None),
        ],
        key=repr,
    )


def test_literals_that_look_like_ends(spark, tmp_path):
    """Long literals hold full stops, quotes and line breaks, in splits of any size."""
    long = "line .\n\"two\" \"\" .\n# three ' .\n"
    text = "@prefix x: <http://x/> .\n" + "".join(f'x:s{n} x:p """{long}"""@en, \'\'\'{long}\'\'\' ; x:q "a . \\"b" , 1.5 . # it\'s .\n' for n in range(300))
    (tmp_path / "a.ttl").write_text(text)
    wanted = sorted(
        (row for n in range(300) for row in [(f"http://x/s{n}", "http://x/p", long, "en"), (f"http://x/s{n}", "http://x/p", long, None), (f"http://x/s{n}", "http://x/q", 'a . "b', None), (f"http://x/s{n}", "http://x/q", "1.5", None)]),
        key=repr,
    )
    for size in (3_000, 1 << 20):
        with split_size(spark, size):
            assert turtle_rows(spark, tmp_path) == wanted


def test_nested_nodes_and_collections(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix : <u:> .\n:s :p [ :q ( "a"@en [ :r 1 ] () ) ; a :T ; ], [] .\n[ :x :y ] .\n[ :x :y ] :z () .\n( 1 ) :p true .\n')
    rows = turtle_rows(spark, tmp_path)
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    shape = sorted(tuple("_" if v and v.startswith("_:") else v for v in row) for row in [tuple(x or "" for x in r) for r in rows])
    assert shape == sorted(
        [("u:s", "u:p", "_", "")] * 2
        + [("_", "u:q", "_", ""), ("_", rdf + "first", "a", "en"), ("_", rdf + "first", "_", ""), ("_", rdf + "first", rdf + "nil", ""), ("_", "u:r", "1", "")]
        + [("_", rdf + "rest", "_", "")] * 2 + [("_", rdf + "rest", rdf + "nil", "")] * 2 + [("_", rdf + "type", "u:T", "")]
        + [("_", "u:x", "u:y", "")] * 2 + [("_", "u:z", rdf + "nil", ""), ("_", rdf + "first", "1", ""), ("_", "u:p", "true", "")]
    )
    assert len({r[0] for r in rows if r[0].startswith("_:")}) == 8


@pytest.mark.parametrize("text", ['x:s x:p "1" .', '<s> "p" <o> .', "<s> <p> .", "<s> <p> <o> ; <q> .", "<s> <p> <o>", "<s> <p> [ <q> .", '<s> <p> """x .\n', "<s> <p> o .", "<s> <p> <o> <o> ) ."])
def test_what_is_not_turtle(spark, tmp_path, text):
    (tmp_path / "a.ttl").write_text(text + "\n")
    with pytest.raises(Exception, match="declared|not a Turtle|ends inside"):
        files.read_turtle(spark, str(tmp_path)).collect()


def test_lines_that_are_no_triples(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<a> <b> <c> .\n<a> <b> .\n")
    with pytest.raises(Exception, match="not a triple"):
        files.read_triples(spark, str(tmp_path)).collect()


def test_template_values_hold_links_and_templates(spark):
    markup = "{{Event\n|Title=[[X|Y]] day\n|Series={{S|a=1|{{T}}}}\n|City=Rome\n|Empty=\n|note\n}} {{Event|City=other}}"
    df = spark.createDataFrame([("a", markup), ("b", "{{Event}}"), ("c", None), ("d", "{{Event series|City=x}}")], "pageTitle string, wikiMarkup string")
    rows = {r["pageTitle"]: tuple(r)[2:] for r in files.parse_template(df, "Event", ["Title", "Series", "City", "Empty", "note"]).collect()}
    assert rows == {"a": ("[[X|Y]] day", "{{S|a=1|{{T}}}}", "Rome", "", None), "b": (None,) * 5}


def test_long_city_names(spark):
    df = spark.createDataFrame([(1, "Days, held in Santa Cruz de la Sierra, Bolivia")], "k int, t string")
    names = spark.createDataFrame([("Santa Cruz",), ("Santa Cruz de la Sierra",)], "city string")
    assert {tuple(r) for r in words.city_phrases(df, "k", "t", names).collect()} == {(1, 3, 2, "Santa Cruz"), (1, 3, 5, "Santa Cruz de la Sierra")}


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("12th IEEE Days", [12]), ("10. Workshop", [10]), ("Workshop XIV. of Rome", [14]), ("12nd Days", [12]), ("Days 1 of x", [1]), ("Days II", [2]),
        ("Twenty-third Days", [23]), ("the ninety-ninth", [99]), ("Eight Days", [8]), ("A. Meyer 2020", []), ("1.5 days, 2:3", []), ("Vol. C. 100. day", []),
    ],
)
def test_ordinal_forms(spark, title, expected):
    found = spark.createDataFrame([(title,)], "t string").select(titles.ordinals(F.col("t")).alias("o")).first()["o"]
    assert found == expected or (title.startswith("Vol.") and found in ([], [100]))


def test_vocabulary_is_complete(spark):
    rows = titles.title_dictionary()
    kinds = {kind: len({row[0] for row in rows if row[1] == kind}) for kind in {row[1] for row in rows}}
    assert kinds == {
        "enum": 509, "field": 86, "scope": 31, "syntax": 24, "eventType": 20, "organization": 16, "month": 12, "frequency": 12, "extract": 11, "publish": 6, "delimiter": 4,
        "country": 95, "province": 19, "year": 70, "city": 63,
    }
    df = spark.createDataFrame([(1, "Summit & round-table discussion, held at New York")], "k int, t string")
    cities = spark.createDataFrame([("New York",), ("York",)], "city string")
    found = {(r.word, r.type) for r in words.annotate(df, "k", "t", cities).collect()}
    assert found == {("Summit", "eventType"), ("&", "delimiter"), ("round table discussion", "eventType"), ("held at", "syntax"), ("at", "syntax"), ("New York", "city"), ("York", "city")}


def test_places_and_years(spark):
    df = spark.createDataFrame([(1, "Days in Québec, New Zealand and Las Vegas, 1961/2029 (2030)")], "k int, t string")
    found = {(r.pos, r.word, r.type, r.value, r.item) for r in words.annotate(df, "k", "t").where("type IN ('country', 'province', 'city', 'year')").collect()}
    assert found == {
        (2, "Québec", "province", None, None), (4, "New Zealand", "country", None, "Q664"), (7, "Las Vegas", "city", None, None), (10, "1961", "year", 1961, None),
        (11, "2029", "year", 2029, None),
    }


def test_city_of_published_titles(spark):
    """One city each, with its item; names with separators; a first word that begins several names."""
    rows = [
        ("Q1297", "Proceedings of the Twenty-Third AAAI Conference on Artificial Intelligence and the Twentieth Innovative Applications of Artificial Intelligence Conference : 13-17 July 2008, Chicago, Illinois, USA ; Vol. 2"),
        ("Q65", "12th IEEE International Conference on Nano/Micro Engineered and Molecular Systems, NEMS 2017, Los Angeles, CA, USA, April 9-12, 2017"),
        ("Q8678", "1st Latin American Network Operations and Management Symposium, LANOMS 1999, Rio de Janeiro, Brazil, December 3-5, 1999"),
        ("Q60", "1960 proceedings of Instrument Society of America 15th Annual Instrument-Automation Conference and Exhibit, New York City, New York, September 26 - 30, 1960 ; Pt. 2"),
        ("Q46", "Days, Saint-Denis"), ("Q47", "Days at St. John's, Canada"), ("Q48", "Days, St. Louis; Xi'an"),
    ]
    names = [("Chicago", "Q1297"), ("Los Angeles", "Q65"), ("Los Alamos", "Q1"), ("Rio de Janeiro", "Q8678"), ("New York City", "Q60"), ("Saint-Denis", "Q46"), ("St. John's", "Q47"), ("St. Louis", "Q48"), ("-", "Q0")]
    df = spark.createDataFrame(rows, "k string, t string")
    found = words.annotate(df, "k", "t", spark.createDataFrame(names, "city string, item string")).where("type = 'city'").collect()
    assert sorted((r.k, r.item) for r in found) == sorted((k, k) for k, _ in rows)
    empty = words.city_phrases(df, "k", "t", spark.createDataFrame([], "city string"))
    assert empty.collect() == []


def test_zipf_search_is_unbounded(spark):
    counts = spark.createDataFrame([(1, 10**9), (2, 1)], "x int, f long")
    assert stats.zipf_fit(counts).first()["b"] == pytest.approx(29.897, abs=0.002)
    assert stats.zipf_fit(counts.where("x = 1")).first()["b"] is None


def test_old_years_are_valid(spark):
    df = spark.createDataFrame([("e", 1799, "s")], "eventId string, year int, source string")
    assert quality.rate(df, ["year"], "event", "eventId").first()["reason"] == "ok"
    assert quality.rate(df, ["year"], "event", "eventId", years=(1850, 2100)).first()["reason"] == "invalid"


PAGE = """<P TITLE=it's><a href="/next">on</a></p><div TypeOf="v:Event"><span Property="v:summary" content='a "b"'>x</span>
<div typeof="v:Place"><i property="v:city">Ro<b>me</b></i></div><script>var t = "<a href='/no'>";</script><p>tail &amp; end</div>"""


def test_unbalanced_quotes_and_upper_case(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<a href='x"), (3, "")], "k int, html string")
    assert pages.page_link(df, "k", "html", r"/(.+)").orderBy("k").first()["href"] == "/next"
    assert [tuple(r)[1:] for r in pages.page_triples(df, "k", "html").orderBy("k", "pos").collect()] == [
        (0, "v:Event", "v:summary", 'a "b"'), (1, "v:Event", "v:city", "Rome"), (2, "v:Place", "v:city", "Rome"),
    ]


def test_pivot_of_pages_equals_pivot_of_triples(spark):
    rows = [[("summary", "IDC 2009"), ("startDate", "2009-06-03T"), ("summary", "Submission Deadline"), ("startDate", "TBD"), ("endDate", "2009-06-05T")], [("x", "y")], []]
    lists = [(k, [("v:Event", f"v:{p}", o) for p, o in found]) for k, found in enumerate(rows)]
    df = spark.createDataFrame(lists, "k int, triples array<struct<s:string,p:string,o:string>>")
    long = df.select("k", F.posexplode("triples").alias("pos", "t")).select("k", "pos", "t.*")
    assert sorted(calls.pivot_pages(df, "k").collect()) == sorted(calls.pivot_calls(long, "k").collect())


def test_records_of_many_kinds_and_across_splits(spark, tmp_path):
    """Two rare records at the ends of many others; no row is longer than one record; attributes are columns."""
    body = "".join(f'<article mdate="2020-01-01" key="j/{n}">\n<title>T{n}</title>\n<ee>http://x/{n}</ee>\n</article>\n' for n in range(4000))
    rare = '<proceedings key="c/{0}" publtype="informal"><title>First\nline</title></proceedings>'
    (tmp_path / "dump.xml").write_text('<?xml version="1.0"?>\n<dblp>\n' + rare.format(1) + "\n" + body + rare.format(2) + "</dblp>\n")
    with split_size(spark, 7001):
        found = files.xml_records(spark, str(tmp_path)).toPandas()
    assert found["kind"].value_counts().to_dict() == {"article": 4000, "proceedings": 2}
    assert found["key"].nunique() == 4002 and set(found[found["kind"] == "proceedings"]["publtype"]) == {"informal"}
    assert set(found[found["kind"] == "article"]["title"]) == {f"T{n}" for n in range(4000)}


@contextmanager
def split_size(spark, size):
    """Splits of so many bytes, also of files that would be cut by the number of cores."""
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_records_of_any_length(spark, tmp_path):
    """One record over many splits, some without a key, markup in comments, data and attributes."""
    odd = '<www mdate="2020-01-01" x="a > b" y=\'"\'><!-- <www> --><title>T</title><note><![CDATA[ </www> ]]></note></www>\n<www/>'
    long = "".join(f"<cite>c > {n}</cite>" for n in range(12000))
    rows = [f'<article key="{n}"><title>T{n}</title>{long if n == 7 else ""}</article>' for n in range(20)]
    (tmp_path / "dump.xml").write_text("<!DOCTYPE dblp [ <!ENTITY x '<y>'> ]>\n<dblp>" + "\n".join([odd, *rows, odd]) + "\n</dblp>\n")
    for size in (30_000, 8 << 20):
        with split_size(spark, size):
            found = files.xml_records(spark, str(tmp_path)).toPandas()
        assert found["kind"].value_counts().to_dict() == {"article": 20, "www": 4} and set(found["key"].dropna()) == {str(n) for n in range(20)}
        assert found["cite"].str.len().max() == len(",".join(f"c > {n}" for n in range(12000)))
        assert found[found["kind"] == "www"]["title"].dropna().tolist() == ["T", "T"]


def test_records_between_many_others(spark, tmp_path):
    """Two records of a tag, one nested in itself, between 200,000 foreign ones in one line."""
    other = "<o><t>x</t></o>" * 200_000
    hit = "<r id='{0}'><t>{0}</t><r id='inner'><t>no</t></r></r>"
    (tmp_path / "a.xml").write_text("<all>" + hit.format(1) + other + hit.format(2) + "</all>")
    with split_size(spark, 300_000):
        texts = cutting.cut(spark, str(tmp_path), partial(cutting.Elements, row_tag="r")).collect()
        rows = files.read_xml(spark, str(tmp_path), "r", "_id string, t array<string>").collect()
    assert sorted(r["text"] for r in texts) == [hit.format(1), hit.format(2)]
    assert sorted((r["_id"], r["t"]) for r in rows) == [("1", ["1"]), ("2", ["2"])]


@pytest.mark.parametrize("body", ["<dblp><a><b></a></dblp>", "<dblp><a>", "<dblp><a></a></a></dblp>", "<dblp><!-- x <a></a></dblp>", '<dblp><a x="></a></dblp>'])
def test_broken_dumps(spark, tmp_path, body):
    (tmp_path / "dump.xml").write_text(body)
    with pytest.raises(ValueError, match="inside a record|end tag"):
        files.xml_records(spark, str(tmp_path))


def test_cutting_is_linear():
    """Text that ends no record is searched once, and many records are cut from one text."""
    began = time.perf_counter()
    for text, records in (("<a><b>x</b>" + "<b>y > z</b>" * 700_000, 0), ("<r>x</r>" * 200_000, 200_000)):
        scanner, found, step = cutting.Elements(), 0, 1200 * 11
        for first in range(0, len(text), step):
            found += len(scanner.feed(text[first : first + step]))
        assert found == records
    assert time.perf_counter() - began < 20


def test_cutting_at_any_place():
    """Pieces of any size give the records of the whole text."""
    text = """<?xml version="1.0"?><!DOCTYPE d [ <!ENTITY x "</y>"> ] ><d a="/"><a x="1 > 0" y='"'/><!-- <a> -- > </a> - --><b ><![CDATA[ ]] </b> ]]></b ><c
 k="/"  ><b/><c>x > y</c ></c><a /></d>"""
    whole = cutting.Elements(root="d").feed(text)
    assert whole == ["""<a x="1 > 0" y='"'/>""", "<b ><![CDATA[ ]] </b> ]]></b >", '<c\n k="/"  ><b/><c>x > y</c ></c>', "<a />"]
    for step in range(1, len(text)):
        scanner = cutting.Elements(root="d")
        pieces = [scanner.feed(text[at : at + step]) for at in range(0, len(text), step)]
        assert sum(pieces, []) == whole and (scanner.state, scanner.depth, scanner.carry) == (0, 0, "")


def test_first_pass_scans_once(monkeypatch):
    """Summary and records of a split come from one scan, with the results of separate ones."""
    text = "".join(f'x:s{n} x:p """a . "" {n}\n. """, "b" .\n' for n in range(2000)).splitlines()
    batches = [pa.table({"value": text[at : at + 100], "file": [1] * 100, "start": [0] * 100}).to_batches()[0] for at in range(0, 4000, 100)]
    scanned, feed = [], cutting.Statements.feed

    def counted(self, part, keep=True):
        scanned.append(len(part))
        return feed(self, part, keep)

    monkeypatch.setattr(cutting.Statements, "feed", counted)
    rows = [r for batch in cutting._first_pass(cutting.Statements)(iter(batches)) for r in batch.to_pylist()]
    assert sum(scanned) < 3.5 * len("\n".join(text))  # all three states are followed to the end; 4 with a second scan
    whole = cutting.Statements()
    assert [r["text"] for r in rows[:-1]] == [*feed(whole, "\n".join(text)), *([whole.parts[-1]] if whole.parts[-1] else [])]
    states = [cutting.Statements(state=n, depth=0) for n in range(3)]
    for scanner in states:
        feed(scanner, "\n".join(text), False)
    assert rows[-1]["ends"] == [s.state for s in states] and rows[-1]["changes"] == [s.depth for s in states] and rows[-1]["lows"] == [s.low for s in states]


def test_directives_are_found_in_the_head():
    """What follows them is not read for them."""
    text = '# x\n@prefix a: <u:a> . @base <u:b> .\nPREFIX p: <u:p>\np:s p:p ' + '"x", ' * 1000 + '"y" .'
    assert len(turtle._head(text)) < 15
    assert turtle._directives(turtle._head(text))[0] == turtle._directives(turtle._tokens(text))[0] == [("a", "u:a"), (None, "u:b"), ("p", "u:p")]


def test_newer_file_wins_within_one_batch(spark, tmp_path):
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    os.makedirs(incoming)

    def arrive(name, title, rows, time):
        path = f"{incoming}/{name}"
        with open(path, "w") as out:
            for n in range(rows):
                out.write(json.dumps({"eventId": str(n), "title": title}) + "\n")
        os.utime(path, (time, time))

    arrive("wikicfp_event0-9.json", "OLD", 3, 1_600_000_000)
    arrive("wikicfp_event10-19.json", "NEW", 5000, 1_600_000_000)
    assert crawl.ingest(spark, incoming, table, checkpoint, buckets=4) == 1
    assert {r["title"] for r in crawl.latest(spark, table).collect()} == {"NEW"}
    arrive("wikicfp_event20-29.json", "THIRD", 1, 1_600_000_001)
    assert crawl.ingest(spark, incoming, table, checkpoint, buckets=4) == 1
    state = {r["eventId"]: r["title"] for r in crawl.latest(spark, table).collect()}
    assert len(state) == 5000 and state["0"] == "THIRD" and state["1"] == "NEW"
    versions = {r["bucket"]: r["version"] for r in crawl.versions(spark, table).collect()}
    assert sorted(versions) == [0, 1, 2, 3] and sorted(v.split("-")[0] for v in versions.values()) == ["0", "0", "0", "1"]
    assert crawl.ingest(spark, incoming, table, checkpoint, buckets=4) == 0


def test_state_is_not_written_again_by_every_batch(spark, tmp_path):
    """Ten batches of equal size: old rows are merged a few times, and the last title of an event holds."""
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    os.makedirs(incoming)
    for batch in range(10):
        with open(f"{incoming}/wikicfp_event{batch}0-{batch}9.json", "w") as out:
            out.writelines(json.dumps({"eventId": str(n), "title": f"T{batch}"}) + "\n" for n in (0, *range(batch * 19 + 1, batch * 19 + 20)))
        os.utime(out.name, (1_600_000_000 + batch,) * 2)
    assert crawl.ingest(spark, incoming, table, checkpoint, files_per_batch=1, buckets=1) == 10
    assert spark.read.parquet(f"{table}/state").count() < 30 * 20  # 55 times 20 rows if each batch wrote all
    state = {r["eventId"]: r["title"] for r in crawl.latest(spark, table).collect()}
    assert len(state) == 191 and state["0"] == "T9" and state["1"] == "T0" and crawl.latest(spark, table).count() == 191


@pytest.mark.parametrize("broken", ["_commit", "done"])
def test_a_run_that_dies_leaves_whole_state(spark, tmp_path, monkeypatch, broken):
    """Before the manifest names the new version the old state is whole, behind it the new one."""
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    os.makedirs(incoming)

    def arrive(number, title):
        with open(f"{incoming}/wikicfp_event{number}-{number + 9}.json", "w") as out:
            out.writelines(json.dumps({"eventId": str(n), "title": title}) + "\n" for n in range(50))
        os.utime(out.name, (1_600_000_000 + number,) * 2)

    titles = lambda: sorted({r["title"] for r in crawl.latest(spark, table).collect()})
    arrive(0, "OLD")
    crawl.ingest(spark, incoming, table, checkpoint, buckets=4)
    arrive(10, "NEW")
    commit = crawl._commit

    def die(*arguments):
        if broken == "done":
            commit(*arguments)
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(crawl, "_commit", die)
        with pytest.raises(Exception, match="killed"):
            crawl.ingest(spark, incoming, table, checkpoint, buckets=4)
    assert titles() == (["NEW"] if broken == "done" else ["OLD"])
    crawl.ingest(spark, incoming, table, checkpoint, buckets=4)
    assert titles() == ["NEW"] and crawl.latest(spark, table).count() == 50


def test_predefined_places(spark):
    terms = {r["text"]: r["id"] for r in locations.predefined_terms(spark).collect()}
    assert terms["Amsterdam"] == "Q727" and terms["Online"] is None and terms["York, UK"] == "Q42462"
    assert terms["Cambridge, MA, USA"] == "Q49111" and terms["Cambridge, UK"] == "Q21713103" and terms["Toronto, Ontario"] == "Q172"
    assert "Brno" not in terms and "Beijing, China" not in terms  # left to the resolvers


def test_last_truth_is_unique(spark):
    rows = [("isbn", "1", "a", 5), ("isbn", "1", "b", 5), ("isbn", "2", "c", 1)]
    truth = spark.createDataFrame(rows, "name string, id string, label string, pos int")
    prepared = matching.prepare_truth(truth)
    assert {(r["id"], r["label"]) for r in prepared.where("last = 1").collect()} == {("1", "b"), ("2", "c")}
    assert {(r["id"], r["label"]) for r in matching.truth_lookup(truth).collect()} == {("1", "b"), ("2", "c")}


def test_workers_find_the_package_elsewhere(tmp_path):
    """A query with Python workers, started from another folder and without a path to the package."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from eventloom.session import local_session; "
        "print('ROWS', e.queries()['s14_page_fields'](local_session(2), '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
