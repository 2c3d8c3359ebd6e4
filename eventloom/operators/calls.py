"""Call-for-papers pages: embedded triples to one row per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.fixed_values import DEADLINE_LABELS


def pivot_calls(triples: DataFrame, key: str) -> DataFrame:
    """Ordered triples (key, pos, s, p, o) to event columns.

    A value directly behind a deadline summary belongs to that deadline; otherwise its
    column is the predicate. The first value of a column wins, ``TBD`` dates are null.
    The preceding triple is found by an equi-join on (key, pos), which spreads the triples
    of a long page over all tasks, and the columns come from one map-side aggregation.
    """
    bare = triples.select(key, "pos", F.replace("p", F.lit("v:"), F.lit("")).alias("p"), "o")
    labels = bare.where((F.col("p") == "summary") & F.col("o").isin(DEADLINE_LABELS)).select(
        key, (F.col("pos") + 1).alias("pos"), F.replace("o", F.lit(" "), F.lit("_")).alias("label")
    )
    is_date = F.col("p").endswith("Date")
    value = F.when(~is_date, F.col("o")).when(F.col("o") != "TBD", F.substring("o", 1, 10))
    keyed = bare.join(labels, [key, "pos"], "left").select(
        key, "pos", F.coalesce("label", "p").alias("name"), value.alias("value")
    )

    def first(name: str):
        return F.min_by("value", F.when(F.col("name") == name, F.col("pos")))

    texts = {"acronym": "summary", "title": "description", "eventType": "eventType", "locality": "locality"}
    dated = {"startDate": "startDate", "endDate": "endDate", **{l.replace(" ", "_"): l.replace(" ", "_") for l in DEADLINE_LABELS}}
    trimmed = {"acronym", "title"}
    return keyed.groupBy(key).agg(
        *[(F.trim(first(n)) if c in trimmed else first(n)).alias(c) for c, n in texts.items()],
        *[F.try_to_date(first(n), "yyyy-MM-dd").alias(c) for c, n in dated.items()],
    )


def pivot_pages(pages: DataFrame, key: str) -> DataFrame:
    """As :func:`pivot_calls`, from the ordered ``triples`` of each page as one array.

    Every column is read from the page's own array, so no triple is moved.
    """
    bare = F.transform("triples", lambda t: F.struct(F.replace(t["p"], F.lit("v:"), F.lit("")).alias("p"), t["o"].alias("o")))

    def named(t, i):
        before = F.get(F.col("_bare"), i - 1)
        label = F.when((before["p"] == "summary") & before["o"].isin(DEADLINE_LABELS), F.replace(before["o"], F.lit(" "), F.lit("_")))
        value = F.when(~t["p"].endswith("Date"), t["o"]).when(t["o"] != "TBD", F.substring(t["o"], 1, 10))
        return F.struct(F.coalesce(F.when(i > 0, label), t["p"]).alias("name"), value.alias("value"))

    rows = pages.where(F.size("triples") > 0).select(key, bare.alias("_bare")).select(key, F.transform("_bare", named).alias("_named"))

    def first(name: str):
        return F.get(F.filter("_named", lambda n: n["name"] == name), F.lit(0))["value"]

    texts = {"acronym": "summary", "title": "description", "eventType": "eventType", "locality": "locality"}
    dated = {"startDate": "startDate", "endDate": "endDate", **{l.replace(" ", "_"): l.replace(" ", "_") for l in DEADLINE_LABELS}}
    trimmed = {"acronym", "title"}
    return rows.select(
        key,
        *[(F.trim(first(n)) if c in trimmed else first(n)).alias(c) for c, n in texts.items()],
        *[F.try_to_date(first(n), "yyyy-MM-dd").alias(c) for c, n in dated.items()],
    )
