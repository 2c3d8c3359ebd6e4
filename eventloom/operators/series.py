"""Series operators: duplicates, completion and frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.fixed_values import (
    EVENT_SHEET,
    PROCEEDINGS_SHEET,
    WIKIDATA_MAPPING,
    WIKI_MAPPING,
)
from eventloom.functions.titles import title_score, volume_number
from eventloom.session import literal_rows, stage


def dedup_by_title(records: DataFrame, group: list[str]) -> DataFrame:
    """Keep the records with the best title score of their group and year.

    The best score is aggregated map-side and joined back, where a window would sort a year
    holding a third of all records in one task. Without a group there is one score per year:
    it is staged, so that the planner sees its size and, if that is small, broadcasts it and
    leaves the records where they are. Otherwise the adaptive skew join splits a hot year.
    A missing year is a group of its own.
    """
    keys = [*group, "year"]
    scored = records.withColumn("_score", title_score(F.col("title")))
    best = scored.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_score").alias("_best"))
    if not group:
        best = stage(best, "best")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return scored.join(best, [*same, F.col("_score") == F.col("_best")], "left_semi").drop("_score")


def year_ordinal_pairs(records: DataFrame, group: list[str]) -> DataFrame:
    """Distinct known (year, ordinal) pairs of every group."""
    return records.where("year IS NOT NULL AND ordinal IS NOT NULL").select(*group, "year", "ordinal").distinct()


def rising_pairs(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Pairs, by year and ordinal, whose ordinal exceeds all before them.

    The input is already distinct, so a window holds at most years × ordinals of a group
    however many records the group has.
    """
    before = W.partitionBy(*group).orderBy("year", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    highest = F.max("ordinal").over(before)
    return pairs.withColumn("_highest", highest).where("_highest IS NULL OR ordinal > _highest").drop("_highest")


def series_frequency(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Years between editions if it is the same whole number throughout, else 0."""
    order = W.partitionBy(*group).orderBy("year", "ordinal")
    steps = pairs.withColumns(
        {"_years": F.col("year") - F.lag("year").over(order), "_ordinals": F.col("ordinal") - F.lag("ordinal").over(order)}
    )
    step = F.try_divide(F.col("_years").cast("double"), F.col("_ordinals"))
    summary = steps.groupBy(*group).agg(
        F.count("*").alias("_pairs"),
        F.min("_ordinals").alias("_smallest"),
        F.min(step).alias("_lowest"),
        F.max(step).alias("_highest"),
    )
    regular = (
        (F.col("_pairs") > 1)
        & (F.col("_smallest") > 0)
        & (F.col("_lowest") == F.col("_highest"))
        & (F.col("_lowest") == F.floor("_lowest"))
    )
    return summary.select(*group, F.coalesce(F.when(regular, F.col("_lowest").cast("int")), F.lit(0)).alias("frequency"))


def complete_series(records: DataFrame, group: list[str]) -> DataFrame:
    """All (year, ordinal) editions of regular series, from the first to the last known.

    Series with two rising ordinals in one year or without a common step give no rows.
    """
    rising = rising_pairs(year_ordinal_pairs(records, group), group)
    order = W.partitionBy(*group).orderBy("year", "ordinal")
    steps = rising.withColumns(
        {"_years": F.col("year") - F.lag("year").over(order), "_ordinals": F.col("ordinal") - F.lag("ordinal").over(order)}
    )
    step = F.col("_years") / F.col("_ordinals")
    summary = steps.groupBy(*group).agg(
        F.count("*").alias("_pairs"),
        F.min("_years").alias("_gap"),
        F.min(step).alias("_lowest"),
        F.max(step).alias("_highest"),
        F.max(F.struct("year", "ordinal")).alias("_last"),
    )
    regular = summary.where(
        "_pairs > 1 AND _gap > 0 AND _lowest = _highest AND _lowest = floor(_lowest) AND _last.ordinal >= 1"
    )
    editions = regular.select(
        *group, "_last", F.col("_lowest").cast("int").alias("_step"), F.explode(F.expr("sequence(1, _last.ordinal)")).alias("ordinal")
    )
    year = F.col("_last.year") - F.col("_step") * (F.col("_last.ordinal") - F.col("ordinal"))
    return editions.select(*group, year.alias("year"), "ordinal")


def _editions_or_blank(records: DataFrame, group: list[str]) -> DataFrame:
    """Completed editions of every group, and one blank row where there are none."""
    return records.select(*group).distinct().join(complete_series(records, group), group, "left")


def _sheet(editions: DataFrame, headers: list[str], filled: dict[str, str]) -> DataFrame:
    empty = F.lit(None).cast("string")
    return editions.select(*[(F.col(filled[h]) if h in filled else empty).alias(h) for h in headers])


def event_sheet(records: DataFrame, group: list[str]) -> DataFrame:
    """Blank event sheet with the series, year and ordinal of every edition."""
    filled = {"Year": "year", "Ordinal": "ordinal", "Series": group[0]}
    return _sheet(_editions_or_blank(records, group), EVENT_SHEET, filled)


def proceedings_sheet(records: DataFrame, group: list[str]) -> DataFrame:
    """Blank proceedings sheet with the ordinal of every edition."""
    return _sheet(_editions_or_blank(records, group), PROCEEDINGS_SHEET, {"ordinal": "ordinal"})


def source_sheet(records: DataFrame) -> DataFrame:
    """Records of one source by year, a missing year first.

    The id as second key lets a year with very many records spread over several ranges.
    """
    return records.orderBy(F.coalesce("year", F.lit(0)), "eventId")


def mapping_sheets(spark: SparkSession) -> dict[str, DataFrame]:
    """The two fixed sheets that say which property every sheet column fills."""
    wikidata = literal_rows(
        spark,
        "Entity string,Column string,PropertyName string,PropertyId string,Type string,Value string,Qualifier string,Lookup string",
        WIKIDATA_MAPPING,
    )
    rows = [(entity, parameter, name, wiki_property, parameter) for entity, wiki_property, name, parameter in WIKI_MAPPING]
    wiki = literal_rows(spark, "Entity string,Column string,PropertyName string,PropertyId string,TemplateParam string", rows)
    return {"WikidataMapping": wikidata, "SmwMapping": wiki}


def duplicate_profile(records: DataFrame, group: list[str]) -> DataFrame:
    """Per series: records, distinct years and ordinals, repeats, and records after dedup.

    Records are counted per (year, ordinal, score) with map-side aggregation first; all
    further steps work on those counts.
    """
    lowered = F.lower("title")
    cells = records.groupBy(*group, "year", "ordinal", title_score(F.col("title")).alias("score")).agg(
        F.count("*").alias("n"),
        F.count_if(lowered.contains("proceeding")).alias("proceedingsCount"),
        F.count_if(volume_number(F.col("title")).isNotNull()).alias("volumeCount"),
    )
    by_year = (
        cells.groupBy(*group, "year", "score").agg(F.sum("n").alias("n"))
        .groupBy(*group, "year").agg(F.max(F.struct("score", "n")).alias("best"))
        .groupBy(*group).agg(F.count("year").alias("years"), F.sum("best.n").alias("afterDedup"))
    )
    by_ordinal = (
        cells.groupBy(*group, "ordinal")
        .agg(*[F.sum(c).alias(c) for c in ("n", "proceedingsCount", "volumeCount")])
        .groupBy(*group)
        .agg(
            F.sum("n").alias("records"),
            F.count("ordinal").alias("ordinals"),
            F.count_if(F.col("ordinal").isNotNull() & (F.col("n") > 1)).alias("repeatedOrdinals"),
            F.sum("proceedingsCount").alias("proceedingsCount"),
            F.sum("volumeCount").alias("volumeCount"),
        )
    )
    return by_ordinal.join(by_year, group)
