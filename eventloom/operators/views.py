"""Common views over per-source tables, their catalogue, and queries across sources."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.fixed_values import SERIES_COLUMNS, SOURCES, VIEW_EXCLUDES
from eventloom.session import literal_rows

Corpus = dict[str, DataFrame]


def view_tables(tables: Corpus, kind: str = "event") -> Corpus:
    """Tables ``<kind>_…`` that belong to the common view."""
    return {
        name: df
        for name, df in tables.items()
        if name.startswith(f"{kind}_") and name not in VIEW_EXCLUDES.get(kind, [])
    }


def common_view(tables: Corpus, kind: str = "event") -> DataFrame:
    """Union of the source tables on all their columns, missing ones null."""
    parts = list(view_tables(tables, kind).values())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def strict_view(tables: Corpus, kind: str = "event") -> DataFrame:
    """Union of the source tables on the columns they all have."""
    parts = list(view_tables(tables, kind).values())
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*shared) for p in parts])


def table_counts(tables: Corpus) -> DataFrame:
    """Name and number of rows of every table, as one plan."""
    counts = [df.select(F.lit(name).alias("tableName")).groupBy("tableName").count() for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def column_survey(tables: Corpus, wanted: list[str]) -> DataFrame:
    """(name, type, tableName, filled) for every wanted column, one pass over each table."""
    parts = []
    for table, df in tables.items():
        fields = [f for f in df.schema.fields if f.name in wanted]
        if not fields:
            continue
        cells = [
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(table).alias("tableName"),
                F.count(f.name).alias("filled"),
            )
            for f in fields
        ]
        parts.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    return reduce(DataFrame.unionAll, parts)


def source_infos(tables: Corpus, sources: list[tuple] = SOURCES) -> DataFrame:
    """Source catalogue with the numbers of its events and series."""
    spark = next(iter(tables.values())).sparkSession
    catalogue = literal_rows(
        spark,
        "lookupId string,name string,title string,url string,tableSuffix string,locationColumn string,"
        "seriesColumn string",
        [(*source, SERIES_COLUMNS.get(source[0])) for source in sources],
    )
    counts = table_counts(tables).select(
        F.substring_index("tableName", "_", 1).alias("kind"),
        F.expr("substring(tableName, instr(tableName, '_') + 1)").alias("suffix"),
        "count",
    )
    per_source = counts.groupBy("suffix").pivot("kind", ["event", "eventseries"]).sum("count")
    return catalogue.join(per_source, F.col("tableSuffix") == F.col("suffix"), "left").select(
        *catalogue.columns,
        F.coalesce("event", F.lit(0)).alias("events"),
        F.coalesce("eventseries", F.lit(0)).alias("series"),
    )


def multi_query(template: str, tables: Corpus, strict: bool = False) -> Corpus:
    """Run a ``select … from {event}`` text on every table of the view.

    Tables the text cannot be analysed on are left out unless ``strict``.
    """
    variable = re.search(r"\{(.*)\}", template)
    if variable is None:
        raise ValueError("the query names no {table} to run on")
    spark = next(iter(tables.values())).sparkSession
    results: Corpus = {}
    for name, df in view_tables(tables, variable.group(1)).items():
        try:
            results[name.split("_", 1)[1]] = spark.sql(template, **{variable.group(1): df})
        except AnalysisException:
            if strict:
                raise
    return results


def with_source(results: Corpus) -> DataFrame:
    """A result per source as one table with a ``source`` column."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def restrict_to_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose (source, eventId) is among the ids; the ids never reach the driver."""
    return records.join(ids.select("source", "eventId"), ["source", "eventId"], "left_semi")
