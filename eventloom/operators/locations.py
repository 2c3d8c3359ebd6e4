"""Location texts to places by gazetteer tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.fixed_values import LOCATION_PATTERNS_NO_REGION, LOCATION_PATTERNS_REGION, PREDEFINED_CITIES, PREDEFINED_TEXTS
from eventloom.session import literal_rows


def gazetteer_terms(cities: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """All texts a city may be written in, as (text, id); of repeated texts the last wins.

    ``cities`` has pos, city, region, regionCode, country, countryCode and id. ``fixed``
    rows (text, id) come first; a null id says that the text names no place.
    """
    def written(pattern: str):
        pieces = [piece for piece in re.split(r"(\{\w+\})", pattern) if piece]
        return F.concat(*[F.col(piece[1:-1]) if piece.startswith("{") else F.lit(piece) for piece in pieces])

    short = F.array(*map(written, LOCATION_PATTERNS_NO_REGION))
    full = F.array(*map(written, LOCATION_PATTERNS_NO_REGION + LOCATION_PATTERNS_REGION))
    texts = F.when(F.col("region").isNull(), short).otherwise(full)
    terms = cities.select(F.col("pos").cast("long").alias("pos"), F.explode(texts).alias("text"), "id")
    if fixed is not None:
        terms = terms.unionByName(fixed.select(F.lit(-1).cast("long").alias("pos"), "text", "id"))
    return terms.groupBy("text").agg(F.max_by("id", F.struct("pos", "id")).alias("id"))


def predefined_terms(spark: SparkSession) -> DataFrame:
    """The published table of texts, in which some name no place (null id)."""
    cities = [(i, *row) for i, row in enumerate(PREDEFINED_CITIES)]
    table = literal_rows(spark, "pos int,city string,region string,regionCode string,countryCode string,country string,id string", cities)
    return gazetteer_terms(table, literal_rows(spark, "text string,id string", PREDEFINED_TEXTS))


def consensus(first: DataFrame, second: DataFrame) -> DataFrame:
    """Answers of the first resolver unless the second gives another one."""
    other = second.select("text", F.col("id").alias("_other"))
    agreed = F.when(F.col("_other").isNull() | (F.col("_other") == F.col("id")), F.col("id"))
    return first.join(other, "text", "left").select("text", agreed.alias("id"))


def resolve_terms(predefined: DataFrame, agreed: DataFrame) -> DataFrame:
    """Predefined texts, their nulls included, before what the resolvers agree on."""
    rest = agreed.join(predefined.select("text"), "text", "left_anti")
    return predefined.select("text", "id").unionByName(rest.select("text", "id")).where("id IS NOT NULL")


def enrich(events: DataFrame, location: str, terms: DataFrame, places: DataFrame) -> DataFrame:
    """Add the place columns to all events whose location text is resolved.

    Texts and places are joined first; events then meet them once. Stage ``terms`` to let
    the planner see their size and broadcast them only if they are small.
    """
    known = terms.join(places, "id").withColumnsRenamed({"text": location, "id": "cityWikidataid"})
    kept = [c for c in events.columns if c == location or c not in known.columns]
    return events.select(*kept).join(known, location, "left")
