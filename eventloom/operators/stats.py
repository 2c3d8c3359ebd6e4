"""Counts, profiles, distributions and completeness figures.

Every aggregate is either algebraic (map-side combined) or runs on counts that were
aggregated before, so a value that holds a third of all rows costs one row per task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.fixed_values import SERIES_SIGNATURE, SIGNATURE
from eventloom.functions.dates import month_day
from eventloom.functions.titles import series_acronym, volume_text
from eventloom.session import stage


def source_counts(events: DataFrame) -> DataFrame:
    """Events per source with a ``TOTAL`` row, smallest first."""
    counted = events.rollup("source").agg(F.count("*").alias("count"), F.grouping("source").alias("isTotal"))
    name = F.when(F.col("isTotal") == 1, "TOTAL").otherwise(F.col("source"))
    return counted.select(name.alias("source"), "count").orderBy("count")


def value_counts(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"))


def repeated_values(df: DataFrame, column: str, minimum: int = 2) -> DataFrame:
    """Values occurring at least ``minimum`` times."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.where(F.col("count") >= minimum)


def series_span(events: DataFrame, key: str, title: str = "title") -> DataFrame:
    """Number, first and last year and a title of every series."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("count"),
        F.min("year").alias("minYear"),
        F.max("year").alias("maxYear"),
        F.min(title).alias("title"),
    )


def non_null_profile(events: DataFrame, columns: list[str]) -> DataFrame:
    """Per source the rows, and per column its filled rows and their whole percentage."""
    counted = events.groupBy("source").agg(
        F.count("*").alias("total"), *[F.count(c).alias(f"{c}Count") for c in columns]
    )
    figures = [[F.col(f"{c}Count"), F.expr(f"`{c}Count` * 100 div total").alias(f"{c}Percent")] for c in columns]
    return counted.select("source", "total", *[f for pair in figures for f in pair])


def signature_completeness(events: DataFrame) -> DataFrame:
    """Share of events with the whole signature, and with each column of it."""

    def share(condition: Column) -> Column:
        return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 2)

    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in SIGNATURE])
    return events.groupBy("source").agg(
        share(whole).alias("complete"), *[share(F.col(c).isNotNull()).alias(f"{c}Share") for c in SIGNATURE]
    )


def series_completeness(events: DataFrame, key: str) -> DataFrame:
    """Ordinal range of every series against its highest ordinal."""
    span = F.col("maxOrdinal") - F.col("minOrdinal")
    return (
        events.where("ordinal IS NOT NULL")
        .groupBy(key)
        .agg(
            F.min("ordinal").alias("minOrdinal"),
            F.max("ordinal").alias("maxOrdinal"),
            F.round(F.avg("ordinal"), 6).alias("avgOrdinal"),
        )
        .withColumn("ordinalRange", span)
        .withColumn("completeness", F.round(F.try_divide(span, F.col("maxOrdinal") - 1.0), 6))
    )


#: Bins of one pass of a selection.
_BINS = 1024


def value_at(values: DataFrame, column: str, share: float) -> float | None:
    """The value at place ``floor(share * n)`` (from 0) of the sorted values; None without any.

    Each pass counts the values by bins of the range that still holds the place, and goes on
    with the range of one bin's values, until they are all equal. Bins are summed in the tasks, so
    a pass moves a thousand rows a task, whatever the number of values, and nothing is sorted.
    Not-a-number is greater than all others.
    """
    numbers = stage(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "values")
    ordered = numbers.where(~F.isnan("v"))
    count, low, high = ordered.agg(F.count("*"), F.min("v"), F.max("v")).first()
    total = numbers.count()
    if not total:
        return None
    place = int(share * total)
    if place >= count:
        return math.nan
    while low < high:
        # halves, as the whole width may be beyond the largest number
        inside = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
        part = F.least(F.lit(_BINS - 1), F.floor(inside * _BINS)).alias("bin")
        bins = ordered.where(F.col("v").between(low, high)).groupBy(part).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: r["bin"]):  # at most _BINS
            if place < row["n"]:
                low, high = row["low"], row["high"]
                break
            place -= row["n"]
    return low


def median_threshold(df: DataFrame, column: str) -> DataFrame:
    """Middle element of the sorted values rounded to two digits."""
    middle = value_at(df.select(F.round(column, 2).alias("value")), "value", 0.5)
    return df.sparkSession.range(1).select(F.lit(middle).cast("double").alias("threshold"))


def acronym_completeness(events: DataFrame) -> DataFrame:
    """Distinct ordinals against the highest, by the series part of the acronym."""
    cells = (
        events.select(series_acronym(F.col("acronym")).alias("series"), "ordinal")
        .where("series IS NOT NULL AND ordinal <> 0")
        .groupBy("series", "ordinal")
        .agg(F.count("*").alias("n"))
    )
    highest = F.col("maxOrdinal")
    return (
        cells.groupBy("series")
        .agg(
            F.min("ordinal").alias("minOrdinal"),
            F.max("ordinal").alias("maxOrdinal"),
            F.round(F.sum(F.col("ordinal") * F.col("n")) / F.sum("n"), 6).alias("avgOrdinal"),
            F.count("*").alias("_distinct"),
        )
        .withColumn("completeness", F.round(F.when(highest > 1, F.col("_distinct") / highest).otherwise(1.0), 6))
        .drop("_distinct")
    )


def create_lookup(tables: dict[str, DataFrame], column: str, id_column: str) -> DataFrame:
    """Values with an id: total and per-table counts, first id, frequency over all rows.

    The id comes from the first table having one, there the most frequent, then the
    smallest id.
    """
    labelled = [
        df.select(F.lit(i).alias("_at"), F.lit(name).alias("_table"), F.col(column), F.col(id_column))
        for i, (name, df) in enumerate(tables.items())
    ]
    counts = (
        reduce(DataFrame.unionAll, labelled)
        .groupBy("_at", "_table", column, id_column)
        .agg(F.count("*").alias("_n"))
    )
    counts = stage(counts, "lookup-counts")
    rows = counts.agg(F.sum("_n")).scalar()
    order = F.struct("_at", -F.col("_n"), F.col(id_column))
    per_table = [F.sum(F.when(F.col("_table") == name, F.col("_n"))).alias(f"{name}Count") for name in tables]
    return (
        counts.where(F.col(id_column).isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col(column).alias("name"))
        .agg(F.sum("_n").alias("count"), F.min_by(id_column, order).alias("qid"), *per_table)
        .withColumn("frequency", F.round(F.col("count") * 100 / rows, 3))
    )


def signature_complete_series(events: DataFrame, key: str, more_than: int) -> DataFrame:
    """Series with a complete signature and a location on all of more than n events."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in SERIES_SIGNATURE])
    placed = F.col("country").isNotNull() & F.col("city").isNotNull()
    if "location" in events.columns:
        placed = placed | F.col("location").isNotNull()
    return (
        events.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.bool_and(filled & placed).alias("complete"), F.count("*").alias("events"))
        .where(F.col("complete") & (F.col("events") > more_than))
        .select(key, "events")
    )


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), column).limit(n)


def long_counts(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """Several aggregates of one pass as (key, value) rows."""
    cells = [F.struct(F.lit(k).alias("key"), v.cast("bigint").alias("value")) for k, v in figures.items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def extract_stats(titles: DataFrame, column: str) -> DataFrame:
    """How the extraction from full titles went, as (key, value) rows."""
    x = F.col(column)
    figures = {f"parts{n}": F.count_if(x["partCount"] == n) for n in range(1, 5)}
    figures["partsMore"] = F.count_if(x["partCount"] > 4)
    for flag in ("invalidTitle", "invalidOrdinal", "invalidYear", "yearRange", "invalidDate"):
        source = F.col("invalidDate") if flag == "invalidDate" else x[flag]
        figures[flag] = F.count_if(source)
    return long_counts(titles, figures)


def durations(events: DataFrame) -> DataFrame:
    """Events per duration in days, both days counted."""
    days = F.datediff("endDate", "startDate") + 1
    return events.where("endDate IS NOT NULL AND startDate IS NOT NULL").groupBy(days.alias("duration")).agg(
        F.count("*").alias("count")
    )


def negative_durations(events: DataFrame) -> DataFrame:
    return events.withColumn("duration", F.datediff("endDate", "startDate") + 1).where("duration < 0")


def histogram(df: DataFrame, value: str, label: Column, bins: int | None = None) -> DataFrame:
    """Counts and densities per label over unit-wide or n equal bins, empty ones included."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(label.alias("label"), F.col(value).cast("double").alias("x"))
        .agg(F.count("*").alias("n"))
    )
    ranges = counts.groupBy("label").agg(
        F.min("x").alias("_min"), F.max("x").alias("_max"), F.sum("n").alias("_total")
    )
    flat = F.col("_min") == F.col("_max")
    if bins is None:
        ranges = ranges.select("label", "_total", (F.col("_min") - 0.5).alias("_low"), F.lit(1.0).alias("_width"),
                               F.ceil(F.col("_max") - F.col("_min") + 1).cast("int").alias("_bins"))
    else:
        low = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
        width = F.when(flat, 1.0).otherwise(F.col("_max") - F.col("_min")) / bins
        ranges = ranges.select("label", "_total", low.alias("_low"), width.alias("_width"), F.lit(bins).alias("_bins"))
    place = F.least(F.floor((F.col("x") - F.col("_low")) / F.col("_width")).cast("int"), F.col("_bins") - 1)
    filled = counts.join(ranges, "label").groupBy("label", place.alias("bin")).agg(F.sum("n").alias("count"))
    empty = ranges.withColumn("bin", F.explode(F.expr("sequence(0, _bins - 1)")))
    count = F.coalesce("count", F.lit(0))
    return empty.join(filled, ["label", "bin"], "left").select(
        "label",
        "bin",
        F.round(F.col("_low") + F.col("bin") * F.col("_width"), 6).alias("lower"),
        F.round(F.col("_low") + (F.col("bin") + 1) * F.col("_width"), 6).alias("upper"),
        count.alias("count"),
        F.round(count / (F.col("_total") * F.col("_width")), 6).alias("density"),
    )


def day_of_year_histogram(df: DataFrame, date: str) -> DataFrame:
    """Events per day of the year for all 366 days."""
    counts = df.where(F.col(date).isNotNull()).groupBy(month_day(F.col(date)).alias("monthDay")).agg(
        F.count("*").alias("n")
    )
    days = df.sparkSession.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-12-31')) AS day")
    return days.select(month_day(F.col("day")).alias("monthDay")).join(counts, "monthDay", "left").select(
        "monthDay", F.coalesce("n", F.lit(0)).alias("count")
    )


def zipf_counts(df: DataFrame, column: str, skip: int = 0) -> DataFrame:
    """Frequencies of the values without the ``skip`` smallest values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("f"))
    if skip:
        smallest = counts.select("x").orderBy("x").limit(skip)
        counts = counts.join(F.broadcast(smallest), "x", "left_anti")
    return counts


def zipf_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("*").alias("values"),
        F.round(F.avg("f"), 6).alias("mean"),
        F.round(F.avg(F.log("f")), 6).alias("meanLog"),
    )


def zipf_fit(counts: DataFrame, digits: int = 3) -> DataFrame:
    """Exponent b of the most likely power law x^-b.

    The log-likelihood -b Σ f log x - Σ f · log Σ x^-b is concave in b. A grid moves and
    widens until its best point lies inside, and is then refined digit by digit; each round
    is one aggregate of the staged counts in which every distinct value meets the grid by an
    explode. Null if there are fewer than two distinct values, for which no b is better.
    """
    counts = stage(counts, "zipf-counts")
    if counts.select("x").distinct().limit(2).count() < 2:
        return counts.agg(F.lit(None).cast("double").alias("b"))

    def best(grid: list[float]) -> float:
        sums = (
            counts.withColumn("b", F.explode(F.array(*map(F.lit, grid))))
            .groupBy("b")
            .agg(
                F.sum(F.col("f") * F.log("x")).alias("logs"),
                F.sum("f").alias("total"),
                F.sum(F.pow(F.col("x").cast("double"), -F.col("b"))).alias("norm"),
            )
        )
        likelihood = -F.col("b") * F.col("logs") - F.col("total") * F.log("norm")
        return sums.agg(F.max_by("b", likelihood)).first()[0]

    centre, step, reach = 0.0, 1.0, 10
    peak = best([centre + i * step for i in range(-reach, reach + 1)])
    while abs(peak - centre) >= reach * step:
        centre, step = peak, step * 2
        peak = best([centre + i * step for i in range(-reach, reach + 1)])
    for digit in range(1 - len(str(int(step))), digits + 1):
        step = 10.0**-digit
        peak = best(sorted({round(peak + i * step, max(digit, 0)) for i in range(-20, 21)}))
    return counts.agg(F.lit(peak).alias("b"))


def column_fill(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """Filled rows of one column in every table."""
    parts = [
        df.agg(F.lit(name).alias("tableName"), F.count(column).alias("filled"), F.count("*").alias("total"))
        for name, df in tables.items()
        if column in df.columns
    ]
    percent = F.round(F.try_divide(F.col("filled") * 100.0, F.col("total")), 6)
    return reduce(DataFrame.unionAll, parts).withColumn("percent", percent)


def volume_distribution(titles: DataFrame, column: str) -> DataFrame:
    """Titles per volume text among those that mention ``vol.``."""
    return (
        titles.where(F.lower(column).contains("vol."))
        .select(volume_text(F.col(column)).alias("volume"))
        .where("volume IS NOT NULL")
        .groupBy("volume")
        .agg(F.count("*").alias("count"))
    )


def _first_word(acronym: Column) -> Column:
    return F.btrim(F.split(acronym, " ")[0], F.lit(" ()#"))


def acronym_structure(df: DataFrame, column: str) -> DataFrame:
    """Distributions of length, blanks, first-word length and capitals of acronyms."""
    a = F.col(column)
    short = F.length(a) - F.length(F.replace(a, F.lit(" "), F.lit(""))) <= 1
    stripped = F.trim(a)
    measures = {
        "length": F.length(a),
        "blanks": F.length(stripped) - F.length(F.replace(stripped, F.lit(" "), F.lit(""))),
        "firstWordLength": F.when(short, F.length(_first_word(a))),
        "capitals": F.when(short, F.regexp_count(_first_word(a), F.lit(r"\p{Lu}"))),
    }
    cells = [F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures.items()]
    counts = df.where(a.isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return (
        counts.select("n", F.inline(F.array(*cells)))
        .where("value IS NOT NULL")
        .groupBy("measure", "value")
        .agg(F.sum("n").alias("count"))
    )


def acronym_dictionary(events: DataFrame, excluded: list[str]) -> DataFrame:
    """Distinct words usable as acronyms, co-located ones (``A@B``) taken apart."""
    known = events.where(F.col("acronym").isNotNull() & ~F.col("source").isin(excluded)).select("acronym").distinct()
    single = known.select(F.explode(F.split("acronym", "@")).alias("a")).where(
        F.length("a") - F.length(F.replace("a", F.lit(" "), F.lit(""))) <= 1
    )
    word = single.select(_first_word(F.col("a")).alias("acronym")).distinct()
    return word.where(F.length("acronym").between(3, 10) & (F.regexp_count("acronym", F.lit(r"\p{Lu}")) > 1))


def acronym_year_check(events: DataFrame) -> DataFrame:
    """Acronyms ending in a year: how many, and how many contradict the start date."""
    matched = events.where(F.col("acronym").rlike(r"^[A-Z]+\s*[12][0-9]{3}"))
    embedded = F.regexp_extract("acronym", "^.*([12][0-9]{3}).*$", 1)
    differs = embedded != F.year("startDate").cast("string")
    return matched.agg(F.count("*").alias("matched"), F.count_if(differs).alias("yearDiffers"))


def acronym_match_share(events: DataFrame) -> DataFrame:
    """Share of acronyms made of capitals and digits, per year."""
    matches = F.when(F.col("acronym").rlike(r"^[A-Z]+\s*[0-9]+"), 1.0).otherwise(0.0)
    return events.where("acronym IS NOT NULL").groupBy("year").agg(
        F.count("*").alias("total"), F.round(F.avg(matches), 6).alias("matchShare")
    )


def location_parts(df: DataFrame, column: str) -> DataFrame:
    """Values per number of comma parts."""
    return df.where(F.col(column).isNotNull()).groupBy(F.size(F.split(column, ",")).alias("parts")).agg(
        F.count("*").alias("count")
    )
