"""Operators against brute force on small fixtures, hot keys and files included."""

import itertools
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom import session
from eventloom.operators import calls, joins, locations, matching, quality, ranking, stats, triples, views
from eventloom.sources import files, pages, schemas
from eventloom.streaming import crawl

NAMES = ["A", "B", "seriesC"]


def brute_force_evaluation(truth, records, names):
    """The evaluation as defined, over all pairs."""
    lut, members = {}, {}
    for label, pos, name, i in sorted(truth, key=lambda r: r[1]):
        lut[name, i] = label
        members.setdefault(label, set()).add((name, i))

    def related(n1, i1, n2, i2):
        return (n2, i2) in members.get(lut.get((n1, i1)), ()) or (n1, i1) in members.get(lut.get((n2, i2)), ())

    counts, rows = {}, set()
    by_record = {}
    for record, name, i in records:
        by_record.setdefault(record, {}).setdefault(name, set()).add(i)
    for n1, n2 in itertools.combinations(names, 2):
        count = dict(TP=0, FP=0, FN=0, TN=0)
        for record, ids in by_record.items():
            own, other = ids.get(n1, set()), ids.get(n2, set())
            for a, b in itertools.product(own, other):
                label = "TP" if related(n1, a, n2, b) else "FP"
                count[label] += 1
                rows.add((record, n1, a, n2, b, label))
            if "series" in n1.lower():
                continue
            for b in {i for n, i in lut if n == n2} - other:
                for a in own:
                    label = "FN" if related(n1, a, n2, b) else "TN"
                    count[label] += 1
                    if label == "FN":
                        rows.add((record, n1, a, n2, b, label))
        counts[n1, n2] = count
    return counts, rows


@pytest.mark.parametrize("seed", range(4))
def test_evaluation_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    # ids repeat over labels, and one series id is in a third of them
    truth = sorted({
        (f"r{k}", k, name, f"{name}{0 if name == 'seriesC' and k % 3 == 0 else rng.randrange(9)}")
        for k in range(14) for name in NAMES for _ in range(rng.randrange(3))
    })
    records = sorted({(f"x{k}", name, f"{name}{rng.randrange(11)}") for k in range(9) for name in NAMES for _ in range(rng.randrange(4))})
    t = spark.createDataFrame(truth, "label string, pos int, name string, id string")
    r = spark.createDataFrame(records, "record string, name string, id string")
    counts, rows = brute_force_evaluation(truth, records, NAMES)
    for many in (64, 1):  # with all ids joined, and with frequent ids by the labels their records know
        found = {(x.name1, x.name2): {k: x[k] for k in ("TP", "FP", "FN", "TN")} for x in matching.confusion(r, t, NAMES, many).collect()}
        assert found == counts
        result = [tuple(x)[:6] for x in matching.evaluate(r, t, NAMES, many).collect()]
        assert set(result) == rows and len(result) == len(rows)
    checked = matching.check_matches(matching.present_pairs(r, NAMES), t).collect()
    assert {(x.record, x.name1, x.id1, x.name2, x.id2, "TP" if x.actual else "FP") for x in checked} == {x for x in rows if x[5] != "FN"}


def test_evaluation_shuffles_records_once(spark):
    """All steps of an evaluation read one shuffle by record, and ids get their labels before they are paired."""
    truth = [(f"r{k}", k, name, f"{name}{k // 3 if name == 'seriesC' else k}") for k in range(30) for name in NAMES]
    t = spark.createDataFrame(truth, "label string, pos int, name string, id string")
    r = t.selectExpr("label AS record", "name", "CASE WHEN name = 'A' AND pos % 6 = 0 THEN concat('A', pos + 1) ELSE id END AS id").localCheckpoint()
    result = matching.evaluate(r, t, NAMES)
    _, rows = brute_force_evaluation(truth, [tuple(x) for x in r.collect()], NAMES)
    assert sorted(tuple(x)[:6] for x in result.collect()) == sorted(rows) and any(x[5] == "FN" for x in rows)
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len([line for line in shuffles if "Reused" not in line]) == 1 and len(shuffles) > 3
    for many in (64, 1):
        checked = matching.check_records(r, t, NAMES, many).collect()
        assert sorted((x.record, x.name1, x.id1, x.name2, x.id2, "TP" if x.actual else "FP") for x in checked) == sorted(x for x in rows if x[5] != "FN")


def test_perfect_match_scores(spark):
    truth = [("a", 0, "A", "1"), ("a", 0, "B", "2"), ("b", 1, "A", "3"), ("b", 1, "B", "4")]
    t = spark.createDataFrame(truth, "label string, pos int, name string, id string")
    r = t.select(F.col("label").alias("record"), "name", "id")
    score = matching.scores(matching.confusion(r, t, ["A", "B"])).first()
    assert (score.precision, score.recall, score.accuracy) == (1.0, 1.0, 1.0)


#: Two records of a published training set of matches; a series' ids belong to both.
PUBLISHED = {
    "ACISP 1996": {
        "openresearchId": ["ACISP 1996"], "wikidataId": ["Q106067066"], "dblpConferenceId": ["conf/acisp/1996"], "dblpSeriesId": ["conf/acisp"], "gndId": ["2159559-8"],
        "seriesWikidataId": ["Q105695401"], "seriesWikicfpId": ["32"], "seriesOpenresearchId": ["ACISP"], "confrefId": ["acisp1996"], "confrefSeriesId": ["acisp"],
    },
    "ACISP 1997": {
        "openresearchId": ["ACISP 1997"], "wikidataId": ["Q106067060"], "TibKatId": ["534995004"], "dblpConferenceId": ["conf/acisp/1997"], "dblpSeriesId": ["conf/acisp"],
        "gndId": ["2164018-X"], "seriesWikidataId": ["Q105695401"], "seriesWikicfpId": ["32"], "seriesOpenresearchId": ["ACISP"], "confrefId": ["acisp1997"], "confrefSeriesId": ["acisp"],
    },
}


def published(spark, records):
    """Records as rows, and the truth."""
    truth = [(label, pos, name, i) for pos, (label, ids) in enumerate(PUBLISHED.items()) for name, found in ids.items() for i in found]
    rows = [(record, name, i) for record, ids in records.items() for name, found in ids.items() for i in ([found] if isinstance(found, str) else found)]
    names = list(dict.fromkeys(n for ids in PUBLISHED.values() for n in ids))
    return spark.createDataFrame(rows, "record string, name string, id string"), spark.createDataFrame(truth, "label string, pos int, name string, id string"), names


def test_published_truth(spark):
    """Perfect records, a record with one wrong id, and matches within and across the two events."""
    r, t, names = published(spark, PUBLISHED)
    score = matching.scores(matching.confusion(r, t, names)).first()
    assert (score.precision, score.recall, score.accuracy) == (1.0, 1.0, 1.0)
    wrong = {"x": {**PUBLISHED["ACISP 1996"], "openresearchId": "ACISP 1997"}}
    r, t, _ = published(spark, wrong)
    some = ["wikidataId", "openresearchId", "dblpConferenceId"]
    rows = {(x.name1, x.id1, x.name2, x.id2, x.label) for x in matching.evaluate(r, t, some).collect()}
    assert rows == {
        ("wikidataId", "Q106067066", "openresearchId", "ACISP 1997", "FP"), ("wikidataId", "Q106067066", "openresearchId", "ACISP 1996", "FN"),
        ("wikidataId", "Q106067066", "dblpConferenceId", "conf/acisp/1996", "TP"), ("openresearchId", "ACISP 1997", "dblpConferenceId", "conf/acisp/1996", "FP"),
        ("openresearchId", "ACISP 1997", "dblpConferenceId", "conf/acisp/1997", "FN"),
    }
    one, two = PUBLISHED.values()
    pairs = [(a, x[0], b, y[0], own is other) for own, other in ((one, one), (two, two), (one, two)) for a, x in own.items() for b, y in other.items()]
    pairs = [p for p in pairs if p[4] or not ("series" in p[0].lower() or "series" in p[2].lower())]
    df = spark.createDataFrame(pairs, "name1 string, id1 string, name2 string, id2 string, expected boolean")
    assert all(x.actual == x.expected for x in matching.check_matches(df, t).collect())


def test_a_hot_id_and_a_hot_label(spark):
    """An id in all records and labels, and a label with all ids, are counted in few rows."""
    size = 3000
    truth = spark.range(size).select(F.concat(F.lit("l"), "id").alias("label"), F.col("id").alias("pos"), F.inline(F.array(
        F.struct(F.lit("A").alias("name"), F.lit("hot").alias("id")), F.struct(F.lit("B").alias("name"), F.col("id").cast("string").alias("id")))))
    truth = truth.unionByName(spark.range(size).select(F.lit("l0").alias("label"), F.lit(-1).cast("long").alias("pos"), F.lit("B").alias("name"), F.col("id").cast("string").alias("id")))
    records = truth.select(F.col("label").alias("record"), "name", "id").where("record <> 'l0'")
    row = matching.confusion(records, truth, ["A", "B"]).first()
    # the id stands for the last label, and every label holds it
    assert (row.TP, row.FP, row.FN, row.TN) == (size - 1, 0, (size - 1) * (size - 1), 0)


def test_long_ids_split_stored_lists(spark):
    df = spark.createDataFrame([("r", "a⇹b", ["c", "a"]), ("s", None, None)], "k string, x string, y array<string>")
    assert {tuple(r) for r in matching.long_ids(df, "k", ["x", "y"]).collect()} == {("r", "x", "a"), ("r", "x", "b"), ("r", "y", "c"), ("r", "y", "a")}


def test_global_running_equals_a_plain_loop(spark):
    rows = [(i, 0 if i % 3 == 0 else i % 7, i % 5) for i in range(5000)]
    df = spark.createDataFrame(rows, "i int, k int, w int").repartition(6)
    found = sorted((r.rowNumber, r.i, r.before, r.total) for r in ranking.global_running(df, [F.asc("k"), F.asc("i")], F.col("w")).collect())
    expected, before = [], 0
    for number, (i, k, w) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), start=1):
        expected.append((number, i, before, sum(r[2] for r in rows)))
        before += w
    assert found == expected


def test_coverage_cut_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(x,) for x in "aaaaabbbccd"], "v string")
    assert [r.v for r in ranking.coverage_cut(df, "v", 50.0).orderBy("rowNumber").collect()] == ["a", "b"]
    assert [r.v for r in ranking.coverage_cut(df, "v", 100.0, limit=1).collect()] == ["a"]


def test_zipf(spark):
    df = spark.createDataFrame([(1,)] * 8 + [(2,)] * 4 + [(3,)] * 2, "x int")
    counts = stats.zipf_counts(df, "x", skip=1)
    assert sorted(r.f for r in counts.collect()) == [2, 4]
    assert stats.zipf_summary(counts).first()["mean"] == 3.0
    # two values fit exactly: 2^-b / 3^-b = 2
    assert stats.zipf_fit(counts).first()["b"] == pytest.approx(1.71, abs=0.002)


def test_median_threshold(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.1, 0.1, 0.9, None)], "c double")
    assert stats.median_threshold(df, "c").first()["threshold"] == 0.1


@pytest.mark.parametrize("seed", range(1))
def test_reach_labels_equal_closure(spark, seed):
    """Random graphs with several parents, cycles, self-loops, and parts without a root."""
    draw = random.Random(seed)
    edges = {(f"n{draw.randint(0, 24)}", f"n{draw.randint(0, 24)}") for _ in range(26)} | {("x", "y"), ("y", "x"), ("z", "z")}
    df = spark.createDataFrame(sorted(edges), "child string, parent string")
    reach = triples.reach_labels(df)
    places = {r["node"]: (r["low"], r["high"]) for r in reach.nodes.collect()}
    assert sorted(low for low, _ in places.values()) == list(range(len(places)))
    pairs = set(edges)
    while True:
        more = {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs
        if not more:
            break
        pairs |= more
    for target in sorted(places)[:: 5 - seed]:
        ranges = triples.ranges_below(reach, target)
        below = {n for n, (place, _) in places.items() if any(low <= place <= high for low, high in ranges)}
        assert below == {a for a, b in pairs if b == target} | {target}
    assert triples.ranges_below(reach, "nowhere") == []
    empty = spark.createDataFrame([], "child string, parent string")
    types = spark.createDataFrame([("s", "c")], "s string, o string")
    assert triples.instances_of(types, empty, "c").collect() == [("s",)] and triples.instances_of(types, empty, "d").collect() == []


def test_value_pages(spark):
    """One subject with most values: pages are full, in order, and hold each value once."""
    rows = [("hot", "p", f"v{n % 5000:05d}") for n in range(12000)] + [("s", "p", "b"), ("s", "p", "a"), ("s", "q", "c"), ("s", "r", "d")]
    pages = triples.value_pages(spark.createDataFrame(rows, "s string, p string, o string").repartition(4), ["p", "q"], 100).collect()
    hot = sorted((r["page"], r["values"]) for r in pages if r["s"] == "hot")
    assert [n for n, _ in hot] == list(range(50)) and [v for _, found in hot for v in found] == [f"v{n:05d}" for n in range(5000)]
    assert sorted((r["p"], r["page"], r["values"]) for r in pages if r["s"] == "s") == [("p", 0, ["a", "b"]), ("q", 0, ["c"])]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("eventId"), (F.col("id") % 7).alias("x"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}/stored'")
    try:
        for name in ("one", "two"):
            files.store_bucketed(rows, f"stored.{name}", "eventId", 8)
        one, two = spark.table("stored.one"), spark.table("stored.two")
        joined = one.hint("merge").join(two, "eventId").groupBy("eventId").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 2000
        assert one.where("eventId = '77'").count() == 1
    finally:
        spark.sql("DROP DATABASE stored CASCADE")


@pytest.mark.parametrize("seed", range(2))
def test_selection_equals_sorting(spark, seed):
    """Wide and narrow ranges, equal values, both ends, and what is no number."""
    draw = random.Random(seed)
    values = [draw.choice([draw.uniform(-1, 1), draw.gauss(0, 1) * 10 ** draw.randint(-300, 300), 0.0, 7.0, -1.5e308, 1.7e308]) for _ in range(3000)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "c double").repartition(5)
    ordered = sorted(v for v in values if v is not None)
    for share in (0.0, 0.1, 0.5, 0.9999):
        assert stats.value_at(df, "c", share) == ordered[int(share * len(ordered))]
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "c double")
    assert stats.value_at(odd, "c", 0.0) == 1.0 and stats.value_at(odd, "c", 0.5) != stats.value_at(odd, "c", 0.5)
    assert stats.value_at(df.where("false"), "c", 0.5) is None and stats.median_threshold(df.where("false"), "c").first()["threshold"] is None


def test_closure_and_descendants(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "c"), ("y", "z")]
    df = spark.createDataFrame(edges, "child string, parent string")
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    assert {tuple(r) for r in triples.closure(df).collect()} == reach
    assert {r.child for r in triples.descendants(df, "c").collect()} == {a for a, b in reach if b == "c"}


def test_upsert_in_order(spark):
    existing = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    updates = spark.createDataFrame(
        [("a", 1, 5, None, ["n"]), ("a", 2, None, "z", ["s"]), ("c", 3, 7, None, ["n"]), (None, 4, 9, "q", ["n", "s"]), ("b", 5, None, None, ["n"])],
        "k string, pos int, n int, s string, present array<string>",
    )
    found = {r.k: (r.n, r.s) for r in quality.upsert(existing, updates, "k", "pos", "present").collect()}
    assert found == {"a": (5, "z"), "b": (None, "y"), "c": (7, None)}


def test_multi_query(spark):
    tables = {"event_a": spark.range(3).withColumnRenamed("id", "n"), "event_b": spark.range(2), "event_acm": spark.range(9)}
    assert list(views.multi_query("SELECT n FROM {event}", tables)) == ["a"]
    with pytest.raises(Exception):
        views.multi_query("SELECT n FROM {event}", tables, strict=True)
    with pytest.raises(ValueError):
        views.multi_query("SELECT 1", tables)


def test_location_terms(spark):
    cities = spark.createDataFrame(
        [(0, "Cambridge", None, None, "United Kingdom", "UK", "Q21713103"), (1, "Cambridge", "Massachusetts", "MA", "United States", "USA", "Q49111")],
        "pos int, city string, region string, regionCode string, country string, countryCode string, id string",
    )
    fixed = spark.createDataFrame([("Online", None), ("York, UK", "Q42462")], "text string, id string")
    found = {r.text: r.id for r in locations.gazetteer_terms(cities, fixed).collect()}
    assert found["Cambridge, UK"] == "Q21713103" and found["Cambridge, MA"] == "Q49111" and found["York, UK"] == "Q42462"
    assert found["Online"] is None and "Cambridge Massachusetts United States" not in found
    assert len(found) == 2 + 2 + 2 + 11
    agreed = locations.consensus(
        spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], "text string, id string"),
        spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "text string, id string"),
    )
    assert {r.text: r.id for r in agreed.collect()} == {"a": "1", "b": None, "c": "1", "d": None}


PAGE = """<html><head><title>T &amp; x</title><script>var a="<h3>no</h3>";</script></head><body class="a b">
<span class="CEURVOLACRONYM">DL4KG2020</span><span class="CEURLOCTIME">Heraklion, Greece, June 02, 2020</span>
<div typeof="v:Event"><span property="v:summary" content="IDC 2009"></span><p typeof="v:Address"><b property="v:locality">Milano, <i>Como</i></b></p>
<br/><img src=x property="v:logo" content='a"b'></div><p>Link: <a href="http://x.org">home</a></p></body></html>"""


def test_page_reading(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>broken <b>text"), (3, None)], "k int, html string")
    fields = [("acronym", "span", "class", "CEURVOLACRONYM"), ("place", "span", "class", "CEURLOCTIME"), ("title", "title", None, None), ("h", "h3", None, None)]
    rows = {r.k: tuple(r)[1:] for r in pages.page_fields(df, "k", "html", fields).collect()}
    assert rows == {1: ("DL4KG2020", "Heraklion, Greece, June 02, 2020", "T & x", None), 2: (None,) * 4, 3: (None,) * 4}
    assert [tuple(r)[1:] for r in pages.page_triples(df, "k", "html").orderBy("pos").collect()] == [
        (0, "v:Event", "v:summary", "IDC 2009"), (1, "v:Event", "v:locality", "Milano, Como"), (2, "v:Event", "v:logo", 'a"b'),
        (3, "v:Address", "v:locality", "Milano, Como"),
    ]
    assert pages.page_link_after(df, "k", "html", r"\w*Link:\w*").orderBy("k").first()["href"] == "http://x.org"
    body = pages.page_fields(df, "k", "html", [("all", "body", "class", "b")]).orderBy("k").first()["all"]
    assert "var a" not in body and "DL4KG2020" in body


def test_pivot_calls(spark):
    rows = [
        ("summary", "IDC 2009"), ("eventType", "Conference"), ("startDate", "2009-06-03T00:00:00"), ("endDate", "TBD"), ("locality", "Milano, Como, Italy"),
        ("description", " IDC  2009 : Days"), ("summary", "Submission Deadline"), ("startDate", "2009-01-19T00:00:00"), ("summary", "Final Version Due"), ("startDate", "TBD"),
    ]
    df = spark.createDataFrame([(1, i, "v:Event", f"v:{p}", o) for i, (p, o) in enumerate(rows)], "k int, pos int, s string, p string, o string")
    r = calls.pivot_calls(df, "k").first()
    assert (r.acronym, r.title, r.locality) == ("IDC 2009", "IDC  2009 : Days", "Milano, Como, Italy")
    assert (str(r.startDate), r.endDate, str(r.Submission_Deadline), r.Notification_Due, r.Final_Version_Due) == ("2009-06-03", None, "2009-01-19", None, None)


def test_bibliography_file(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(
        """<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE dblp SYSTEM "dblp.dtd"><dblp>
<inproceedings key="conf/x/a"><title>Inside</title></inproceedings>
<proceedings mdate="2020-01-01" key="conf/x/2020"><editor>J&uuml;rgen A</editor><editor>B &amp; C</editor><title>Days of H<sub>2</sub>O</title>
<ee type="oa">https://doi.org/1</ee><ee>https://x</ee><series href="db/x.html">LN</series></proceedings><article key="j/1"><title>T1</title></article>
<proceedings key="conf/y/2021"><title>Next</title><year>2021</year></proceedings></dblp>""",
        encoding="utf-8",
    )
    tables = files.xml_kinds(spark, str(tmp_path), ["proceedings", "inproceedings", "article"])
    found = {r.key: r for r in tables["proceedings"].collect()}
    assert set(found) == {"conf/x/2020", "conf/y/2021"}
    first = found["conf/x/2020"]
    assert (first.editor, first.title, first.ee, first.series, first.mdate) == ("Jürgen A,B & C", "Days of H", "https://doi.org/1,https://x", "LN", "2020-01-01")
    assert [r.title for r in tables["inproceedings"].collect()] == ["Inside"] and [r.title for r in tables["article"].collect()] == ["T1"]


def test_json_documents(spark, tmp_path):
    for i, status in enumerate(["ok", "failed"]):
        page = {"status": status, "message": {"items": [{"event": {"name": f"n{i}"}, "title": ["t", ""], "DOI": str(i)}, {"DOI": "z"}]}}
        (tmp_path / f"crossref-{i}.json").write_text(json.dumps(page, indent=2))
    assert [r.DOI for r in files.work_pages(spark, str(tmp_path), multi_line=True).collect()] == ["0", "z"]
    assert [r.title for r in files.work_titles(spark, str(tmp_path), multi_line=True).collect()] == ["t"]
    listing = tmp_path / "list"
    listing.mkdir()
    (listing / "a.json").write_text(json.dumps([{"id": "1", "area": {"value": "x"}}, {"id": "2"}], indent=1))
    assert [r.id for r in files.conference_list(spark, str(listing), multi_line=True).collect()] == ["1", "2"]


def test_wiki_files(spark, tmp_path):
    (tmp_path / "AAAI 2020.wiki").write_text("intro\n{{Event\n|Acronym=AAAI 2020\n|Start date = 2020/02/07\n|Title=a=b\n|Acronym=AAAI-20\n}}\nend {{Other|City=x}}")
    (tmp_path / "None.wiki").write_text("no template")
    found = files.parse_template(files.read_wiki_files(spark, str(tmp_path)), "Event", ["Acronym", "Start date", "Title", "City"]).collect()
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in found] == [("AAAI 2020", "AAAI-20", "2020/02/07", "a=b", None)]


def test_table_store_and_lookup_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "source string, country string, ordinal int")
    files.store_table(df, str(tmp_path / "t"), ["country", "ordinal"])
    assert sorted(os.listdir(tmp_path / "t"))[-2:] == ["source=a", "source=b"]
    files.write_lookup(df, str(tmp_path / "l"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "l")).count() == 2


def tasks_of(capsys, df):
    """Numbers of tasks that rows are dealt out to by name."""
    df.explain()
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)]


@pytest.fixture
def large_facts(spark, tmp_path, monkeypatch):
    """Triples in a file that calls for 50 tasks and some, with a repeated one."""
    rows = [(f"s{n}", p, f"{o}{n}") for n in range(300) for p, o in (("type", "T"), ("label", "a"), ("label", "b"), ("label", "a"))]
    spark.createDataFrame(rows, "s string, p string, o string").coalesce(1).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    monkeypatch.setattr(session, "TASK_BYTES", sum(os.path.getsize(f.removeprefix("file://")) for f in facts.inputFiles()) // 50)
    return facts


def test_scholars_take_as_many_tasks_as_there_is_input(spark, large_facts, capsys):
    scholars = spark.createDataFrame([("s1", "x"), ("none", "x"), (None, "x")], "s string, label string")
    found = joins.scholar_enrich(scholars, large_facts, ["label"], "s")
    assert min(tasks_of(capsys, found)) >= 50
    assert sorted(map(tuple, found.collect())) == [("none", "x"), ("s1", "a1|b1")]


def test_entities_take_as_many_tasks_as_there_is_input(spark, large_facts, capsys):
    lists = triples.flatten_aggregated(large_facts, "type", "T1", ["label"], [])
    figures = triples.flatten_figures(large_facts, "type", "T1", ["label"], [])
    assert min(tasks_of(capsys, lists)) >= 50 and min(tasks_of(capsys, figures)) >= 50
    assert [tuple(r) for r in lists.collect()] == [("s1", "a1", 2, "a1| b1")]
    assert [tuple(r) for r in figures.collect()] == [("s1", "a1", 2)]


def test_triples_file(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<u:s> <u:p> "say \\"x\\""@en .\n# comment\n<u:s> <u:q> <u:o> .\n<u:s> <u:r> "5"^^<u:int> .\n')
    assert sorted(tuple(r) for r in files.read_triples(spark, str(tmp_path)).collect()) == sorted(
        [("u:s", "u:p", 'say "x"', "en"), ("u:s", "u:q", "u:o", None), ("u:s", "u:r", "5", None)], key=str
    )


def test_streaming_equals_batch_and_skips_finished_files(spark, tmp_path):
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))

    def batch(first, title):
        rows = [(str(i), f"{title} {i}", i % 4 == 0) for i in range(first, first + 10)]
        df = spark.createDataFrame(rows, "eventId string, title string, deleted boolean")
        df.coalesce(1).write.mode("append").json(incoming)

    existing = spark.createDataFrame([("1", "old"), ("99", "kept")], "eventId string, title string")
    batch(0, "first")
    assert crawl.ingest(spark, incoming, table, checkpoint) >= 1
    assert crawl.ingested(spark, table).count() == 7
    batch(5, "second")
    crawl.ingest(spark, incoming, table, checkpoint)
    arrived = crawl.ingested(spark, table)
    assert arrived.count() == 15
    state = {r.eventId: r.title for r in crawl.current_state(existing, arrived).collect()}
    expected = {"1": "old", "99": "kept"} | {str(i): f"first {i}" for i in range(10) if i % 4} | {str(i): f"second {i}" for i in range(5, 15) if i % 4}
    assert state == expected


class FakeSession:
    """A session with the given settings, as a cluster would hand out."""

    def __init__(self, master, settings):
        self.conf = settings
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_staging_folder_comes_from_the_session():
    cluster = FakeSession("yarn", {session.CHECKPOINT_SETTING: "hdfs://shared/work/"})
    assert session.staging_path(cluster, "x").startswith("hdfs://shared/work/eventloom/x-")
    with pytest.raises(RuntimeError):
        session.staging_root(FakeSession("yarn", {}))


def test_schemas_are_valid(spark):
    for schema in (schemas.BIBLIOGRAPHY, schemas.CATALOGUE_DOCUMENT, schemas.VOLUME, schemas.WORK_PAGE, schemas.CONFERENCE, schemas.CALL, schemas.LIBRARY_EVENT):
        assert spark.createDataFrame([], schema).count() == 0


def test_pairs_of_place_and_date_are_not_shuffled(spark):
    """Repeated rows on both sides: every pair once, made distinct below the join."""
    rows = [(f"e{n % 40}", "2020-01-01", "2020-01-02", f"t{n % 40}") for n in range(80)] + [("x", None, "2020-01-02", "t")]
    days = [F.to_date(c).alias(c) for c in ("startDate", "endDate")]
    both = spark.createDataFrame(rows, "eventId string, startDate string, endDate string, title string").select("eventId", *days, "title")
    left = both.select("*", F.lit("c").alias("countryId"), F.lit("http://Q1").alias("cityId"))
    right = both.select("startDate", "endDate", "title", F.lit("c").alias("country"), F.lit("c1").alias("city"), F.lit("Q1").alias("cityWikidataid"), F.col("eventId").alias("doi"))
    found = joins.place_and_date_match(left, right, "http://")
    pairs = [(r["leftId"], r["doi"]) for r in found.collect()]
    assert sorted(pairs) == sorted(itertools.product({r[0] for r in rows[:80]}, repeat=2))
    assert {(r["startDate"], r["endDate"], r["cityId"]) for r in found.collect()} == {("2020-01-01", "2020-01-02", "Q1")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_catalogue_takes_little_disk(spark, tables, monkeypatch, tmp_path):
    """Files of the catalogue and the records cut from them lie compressed."""
    monkeypatch.setattr(session, "staging_root", lambda spark: str(tmp_path))
    from eventloom.plans import files as plans

    rows = plans.ftx_documents(tables).count()
    size = sum(os.path.getsize(os.path.join(folder, name)) for folder, _, names in os.walk(tmp_path) for name in names)
    assert rows == tables.lineitem.count() and size < 200 * rows


def test_plain_pages_need_no_parser(spark, tables, monkeypatch):
    """Plain markup is read without the parser and as it reads it; the call pages are spread over tasks."""
    from html.parser import HTMLParser

    from eventloom.plans import texts as plans

    def seen(page):
        number = {id(e): n for n, e in enumerate(page.elements)}
        elements = [(e.tag, e.attributes, e.text, [number[id(f)] for f in e.found]) for e in page.elements]
        return elements, [(t, f and number[id(f)]) for t, f in page.texts], page.triples()

    def parsed(html):
        with monkeypatch.context() as patch:
            patch.setattr(pages._Page, "_plain", lambda self, html: False)
            return seen(pages._Page(html))

    calls_of = plans.call_pages(tables)
    plain = [r["html"] for r in calls_of.limit(50).collect()]
    plain += ['<P A="1" a="2">x &amp &lt;b&gt;<br/>y<p\n id="&quot;">z</div></p> &', "", "a &nbsp"]
    for html in plain + ["<p>a < b</p>", "<title>a<b></title>", '<p a=1 b="&copy;">', "<script><p></script><p>", "<!-- <p> --><p a='>'>", "<p"]:
        assert seen(pages._Page(html)) == parsed(html)
    monkeypatch.setattr(HTMLParser, "feed", lambda self, html: pytest.fail("parsed"))
    assert all(pages._Page(html) for html in plain)
    assert calls_of.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_links_are_made_distinct_as_numbers(tables):
    """The map-side table of distinct links holds two numbers a link."""
    from eventloom.plans import proxies

    plan = proxies.triples(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_partkey#" in plan
