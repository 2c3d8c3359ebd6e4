"""Published example values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, text, titles
from eventloom.operators import cleaning, joins
from eventloom.operators import series as s


def values(spark, column_function, inputs, kind="string"):
    rows = [(i, value) for i, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column_function(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("value", ["18-21 September 2005", "18-21st September 2005", " 18-21 September 2005 ."])
def test_day_month_range(spark, value):
    assert tuple(values(spark, dates.day_month_range, [value])[0]) == (2005, date(2005, 9, 18), date(2005, 9, 21))


def test_day_month_range_rejects(spark):
    found = values(spark, dates.day_month_range, ["18-31 May 2005", "3-30 February 2005", "in 2005", None, "2005"])
    assert [tuple(f) if f else None for f in found[:3]] == [(None, None, None)] * 3
    assert found[4]["year"] == 2005 and found[4]["startDate"] is None


def test_text_range(spark):
    texts = ["2018-2019", "08.01.2019-11.01.2019", "2019", "1996.05.23-25", "2021.02.28-03.02", "08.01.2019-", "31.02.2019", "1996.05.23-45"]
    assert [tuple(v) for v in values(spark, dates.text_range, texts)] == [
        (2018, None, None),
        (2019, date(2019, 1, 8), date(2019, 1, 11)),
        (2019, None, None),
        (1996, date(1996, 5, 23), date(1996, 5, 25)),
        (2021, date(2021, 2, 28), date(2021, 3, 2)),
        (2019, date(2019, 1, 8), None),
        (None, None, None),
        (None, None, None),
    ]


def test_description(spark):
    texts = [
        "Italian Workshop on Neural Nets (WIRN) ; 8 (Vietri) : 1996.05.23-25",
        "WALCOM ; 15 (Online) : 2021.02.28-03.02",
        "No parts (X)",
        "Fair ; 1996 (Bonn) : 1996.05.23-25",
        "Only name ; nothing",
    ]
    assert [tuple(v) for v in values(spark, titles.description, texts)] == [
        ("WIRN", 8, "Vietri", 1996, date(1996, 5, 23), date(1996, 5, 25)),
        ("WALCOM", 15, "Online", 2021, date(2021, 2, 28), date(2021, 3, 2)),
        (None,) * 6,
        (None,) * 6,
        ("Only name", None, None, None, None, None),
    ]


def test_fulltitle(spark):
    found = values(spark, titles.fulltitle, ["Symposium on Cognition (1 : 1965 : Pittsburgh, Pa.)", "Days (x : Bonn)", "No bracket", "A (2001 - 2002)"])
    assert (found[0]["title"], found[0]["ordinal"], found[0]["year"], found[0]["location"]) == (
        "Symposium on Cognition", 1, 1965, "Pittsburgh, Pa.",
    )
    assert found[1]["invalidYear"] and found[1]["location"] == "Bonn"
    assert found[2]["invalidTitle"] and found[2]["title"] is None
    assert found[3]["yearRange"] and found[3]["year"] == 2001


def test_ordinals(spark):
    texts = [
        "12th IEEE International Symposium on Wearable Computers (ISWC 2008), September 28 - October 1, 2008",
        "Proceedings of the Twenty-Third Conference and the second Workshop",
        "with the 5 best",
        None,
    ]
    assert values(spark, titles.ordinals, texts) == [[12], [23, 2], [], None]


def test_isbn(spark):
    numbers = ["978-1-4244-2047-6", "1-4244-0225-5", "2022-01-01", ""]
    assert values(spark, text.isbn_type, numbers) == ["ISBN-13", "ISBN-10", None, "ISBN-13"]
    assert values(spark, text.to_isbn13, numbers) == ["978-1-4244-2047-6", "978-1-4244-0225-5", None, ""]


def test_title_score(spark):
    texts = ["volume 1", "volume 2", "Proceedings of the 10th Asian Conference on Computer Vision volume 1", None]
    assert values(spark, titles.title_score, texts) == [1.5, 1.0, 3.5, 0.0]


def test_volume_number(spark):
    labels = ["volume", "vol.", "part", "pt."]
    numbers = ["1", "2", "3", "A", "B", "C", "I", "II", "III", "IV", "V"]
    wanted = [1, 2, 3, 1, 2, 3, 1, 2, 3, 4, 5]
    texts = [f"Papers {label} {n}" for label in labels for n in numbers]
    assert values(spark, titles.volume_number, texts) == wanted * 4
    assert values(spark, titles.volume_number, ["volume x", "no", "Vol. 00"]) == [None, None, None]


def test_encoding(spark):
    assert values(spark, text.fix_encodings, ['M\\"unster, Germany', "a\\Sb&#x0D;"]) == ["Münster, Germany", "a Sb"]


def test_unescape(spark):
    assert values(spark, text.html_unescape, ["R&amp;D B&uuml;ro", "plain", None]) == ["R&D Büro", "plain", None]


def test_lookup_acronym(spark):
    df = spark.createDataFrame(
        [("FLAM 2013", None, 2013), ("IPTC", None, 2014), ("COMET", None, 2012), (None, "NACRW", 2013), (None, None, 2013)],
        "acronym string, event string, year int",
    )
    assert [r.lookupAcronym for r in cleaning.with_lookup_acronym(df).collect()] == ["FLAM 2013", "IPTC 2014", "COMET 2012", "NACRW 2013", None]


@pytest.mark.parametrize(
    "allowed, kept",
    [(["54"], ["a", "b"]), (["54.72"], ["a"]), (["54", "null"], ["a", "b", "d"]), (["none"], ["d"]), (["x"], []), (["85", "54.64"], ["b", "c"])],
)
def test_classification_filter(spark, allowed, kept):
    df = spark.createDataFrame([("a", "54.72⇹85.20x"), ("b", "54.64"), ("c", "85.20"), ("d", None)], "k string, bk string")
    found = {r.k for r in df.where(joins.classification_filter(F.col("bk"), allowed)).collect()}
    # the first code of "a" ends in a letter but its main class still is 85
    assert found == set(kept) | ({"a"} if "85" in allowed else set())


PAIRS = [
    ([], None),
    ([(2000, 1)], 0),
    ([(2000, 1), (2001, 2)], 1),
    ([(2000, 1), (2002, 2), (2006, 4)], 2),
    ([(2000, 1), (2001, 2), (2003, 3)], 0),
    ([(2000, 2), (2001, 1)], 0),
    ([(2000, 1), (2001, 3)], 0),
    ([(2000, 1), (2000, 2)], 0),
]


@pytest.mark.parametrize("pairs, frequency", PAIRS)
def test_frequency(spark, pairs, frequency):
    df = spark.createDataFrame([("s", y, o) for y, o in pairs], "series string, year int, ordinal int")
    found = [r.frequency for r in s.series_frequency(df, ["series"]).collect()]
    assert found == ([] if frequency is None else [frequency])


def complete(spark, pairs):
    df = spark.createDataFrame([("s", y, o) for y, o in pairs], "series string, year int, ordinal int")
    return sorted((r.year, r.ordinal) for r in s.complete_series(df, ["series"]).collect())


def test_complete_series(spark):
    known = [(1975, 1), (1975, None), (1990, 16), (2019, 45), (2020, 46), (2020, 46), (None, 3)]
    assert complete(spark, known) == [(1974 + i, i) for i in range(1, 47)]
    assert complete(spark, [(2006, 1), (2017, 12), (2010, 3)]) == []
    assert complete(spark, [(2006, 1), (2017, 12)]) == [(2005 + i, i) for i in range(1, 13)]
    assert complete(spark, [(2000, 1), (2001, 2), (2001, 3)]) == []
    # an ordinal that falls back is left out, as later ones rise again
    assert complete(spark, [(2000, 1), (2001, 2), (2002, 1), (2003, 4)]) == [(2000, 1), (2001, 2), (2002, 3), (2003, 4)]
    assert complete(spark, []) == []


def test_rename_properties(spark):
    df = spark.createDataFrame([("A", "x")], "Acronym string, Other string")
    names = {"Acronym": "acronym"}
    assert cleaning.rename_properties(df, names).columns == ["acronym"]
    assert cleaning.rename_properties(df, names, force=True).columns == ["acronym", "Other"]
    assert cleaning.rename_properties(df.withColumnRenamed("Acronym", "acronym"), names, reverse=True, include=["Other"]).columns == ["Acronym", "Other"]


def test_mapping_sheets(spark):
    sheets = s.mapping_sheets(spark)
    assert sheets["WikidataMapping"].count() == 29
    found = {(r.Entity, r.Column): r.PropertyName for r in sheets["SmwMapping"].collect()}
    assert found["Event", "Series"] == "inEventSeries" and found["Event series", "GND-ID"] == "gndId"
