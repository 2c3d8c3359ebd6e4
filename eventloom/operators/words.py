"""Words of titles: categories, city phrases and co-location."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.titles import title_dictionary, title_words
from eventloom.session import literal_rows


def _normal(name: str) -> Column:
    """The words of a name as those of a title are written, one space between them."""
    return F.array_join(F.filter(title_words(F.col(name)), lambda w: w != ""), " ")


def _first(phrase: str) -> Column:
    return F.substring_index(phrase, " ", 1)


def _length(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def dictionary(spark: SparkSession, cities: bool = True) -> DataFrame:
    """The fixed title dictionary: about 950 rows, whatever the data.

    Entries are written as the words of a title are; what a title's separators leave nothing
    of (``-``) can be no word of it.
    """
    entries = [row for row in title_dictionary() if cities or row[1] != "city"]
    rows = literal_rows(spark, "entry string,type string,value int,item string", entries)
    return rows.select(_normal("entry").alias("word"), "type", "value", "item").where("word <> ''")


def _split(titles: DataFrame, key: str, text: str, more: Iterable[Column] = ()) -> DataFrame:
    """Titles with their words that are not empty: ``pos`` counts the empty ones, too."""
    placed = F.transform(title_words(F.col(text)), lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return titles.select(key, *more, F.filter(placed, lambda w: w["word"] != "").alias("_words"))


def _entries(titles: DataFrame, key: str, text: str, entries: DataFrame, more: Iterable[Column] = (), keep: bool = False) -> DataFrame:
    """Entries of the dictionary in titles: ``pos``, ``word`` and what else the entries have.

    The dictionary has a fixed size. Its first words are part of the plan: a title's words meet
    them in place, and only those that begin an entry become rows with the words behind
    them. ``keep`` keeps titles without any, and words that only begin like an entry, as rows without an entry.
    """
    rows = entries.withColumns({"first": _first("word"), "n": _length("word")}).collect()
    firsts, longest = sorted({row["first"] for row in rows}), max(row["n"] for row in rows)
    numbered = F.transform("_words", lambda w, n: F.struct(n.alias("nth"), w["word"].alias("word"), w["pos"].alias("pos")))
    begun = F.filter(numbered, lambda w: w["word"].isin(firsts))
    hits = F.transform(begun, lambda w: F.struct(w["pos"].alias("pos"), w["word"].alias("first"), F.slice(F.col("_words"), w["nth"] + 1, longest)["word"].alias("words")))
    split = _split(titles, key, text, more)
    kept = [c for c in split.columns if c != "_words"]
    found = split.select(*kept, (F.explode_outer if keep else F.explode)(hits).alias("h")).select(*kept, "h.*")
    known = F.broadcast(entries.withColumns({"_first": _first("word"), "_n": _length("word")}))
    same = (F.col("first") == F.col("_first")) & (F.array_join(F.slice("words", 1, F.col("_n")), " ") == F.col("word"))
    return found.join(known, same, "left" if keep else "inner").select(*kept, "pos", *entries.columns)


def _named(titles: DataFrame, key: str, text: str, names: DataFrame, name: str, more: Iterable[Column] = ()) -> DataFrame:
    """Names of a table of any size in titles: ``nth`` and ``pos`` of the first word, ``length``, and the name's row.

    The names' first words with the lengths of the names that they begin are an index; a
    title's words meet it, and a phrase is built only where one begins a name. Both steps are
    equi-joins; the planner broadcasts a side only if its size allows it. Names are compared as
    titles are written, so hyphens and apostrophes count as spaces.
    """
    named = names.withColumn("_phrase", _normal(name)).where("_phrase <> ''").distinct()
    index = named.select(_first("_phrase").alias("_first"), _length("_phrase").alias("length")).distinct()
    longest = index.agg(F.max("length")).first()[0] or 1
    split = _split(titles, key, text, more)
    kept = [c for c in split.columns if c != "_words"]
    # every word side by side with those behind it, so a row holds a few words however long the text
    behind = [F.slice("_words", n + 1, F.greatest(F.size("_words"), F.lit(1))).alias(f"w{n}") for n in range(longest)]
    rows = split.select(*kept, F.posexplode(F.arrays_zip(*behind)).alias("nth", "w"))
    rows = rows.select(*kept, "nth", F.col("w.w0.pos").alias("pos"), F.col("w.w0.word").alias("_first"), F.array(*[F.col(f"w.w{n}.word") for n in range(longest)]).alias("_behind"))
    begun = rows.join(index, "_first")
    whole = F.element_at("_behind", F.col("length")).isNotNull()
    phrases = begun.where(whole).select(*kept, "nth", "pos", "length", F.array_join(F.slice("_behind", 1, F.col("length")), " ").alias("_phrase"))
    return phrases.join(named, "_phrase").drop("_phrase")


def annotate(titles: DataFrame, key: str, text: str, cities: DataFrame | None = None) -> DataFrame:
    """Dictionary entries in titles as (key, pos, word, type, value, item).

    A table of ``cities`` (columns ``city`` and, if known, ``item``) takes the place of the few that the
    dictionary has.
    """
    columns = [key, "pos", "word", "type", "value", "item"]
    found = _entries(titles, key, text, dictionary(titles.sparkSession, cities is None)).select(*columns)
    if cities is None:
        return found
    item = F.col("item") if "item" in cities.columns else F.lit(None).cast("string")
    named = _named(titles, key, text, cities.select("city", item.alias("item")), "city")
    return found.unionByName(named.select(key, "pos", F.col("city").alias("word"), F.lit("city").alias("type"), F.lit(None).cast("int").alias("value"), "item"))


def city_phrases(titles: DataFrame, key: str, text: str, cities: DataFrame) -> DataFrame:
    """City names in titles as (key, pos, length, city); positions and lengths count words.

    ``city`` is the name as the table writes it; hyphens and apostrophes count as spaces.
    """
    found = _named(titles, key, text, cities.select("city"), "city")
    return found.select(key, F.col("nth").alias("pos"), "length", "city")


def _categories(titles: DataFrame, key: str, text: str) -> DataFrame:
    """Per title its co-location flag and the entries of it that are in the dictionary, or nulls."""
    colocated = F.col(text).contains("co-located").alias("coLocated")
    return _entries(titles, key, text, dictionary(titles.sparkSession), [colocated], keep=True).select(key, "coLocated", "word", "type", "value")


def category_distribution(titles: DataFrame, key: str, text: str, category: str) -> DataFrame:
    """How many titles have how many words of a category, with and without co-location."""
    per_title = _categories(titles, key, text).groupBy(key, "coLocated").agg(
        F.count_if(F.col("type") == category).alias("matches")
    )
    return per_title.groupBy("coLocated", "matches").agg(F.count("*").alias("titles"))


def category_combinations(titles: DataFrame, key: str, text: str, category: str) -> DataFrame:
    """Combinations of a category's words, counted by co-location."""
    found = F.when(F.col("type") == category, F.lower("word"))
    per_title = _categories(titles, key, text).groupBy(key, "coLocated").agg(
        F.array_join(F.sort_array(F.collect_set(found)), "&").alias("categories")
    )
    return per_title.groupBy("categories").agg(
        F.count_if("coLocated").alias("coLocated"),
        F.count_if(~F.col("coLocated")).alias("notCoLocated"),
        F.count("*").alias("total"),
    )


def contradictions(titles: DataFrame, key: str, text: str, acronyms: DataFrame) -> DataFrame:
    """Titles naming several ordinals or several known acronyms, counted by co-location."""
    ordinal = F.when(F.col("type") == "enum", F.col("value")).alias("ordinal")
    entries = _categories(titles, key, text).select(key, "coLocated", ordinal, F.lit(None).cast("string").alias("acronym"))
    named = _named(titles, key, text, acronyms.select(F.col("acronym").cast("string").alias("acronym")), "acronym", [F.col(text).contains("co-located").alias("coLocated")])
    words = entries.unionByName(named.select(key, "coLocated", F.lit(None).cast("int").alias("ordinal"), "acronym"))
    per_title = words.groupBy(key, "coLocated").agg(
        (F.min("ordinal") < F.max("ordinal")).alias("ordinals"), (F.min("acronym") < F.max("acronym")).alias("acronyms")
    )
    ordinals, names = F.coalesce("ordinals", F.lit(False)), F.coalesce("acronyms", F.lit(False))
    return per_title.groupBy("coLocated").agg(
        F.count("*").alias("titles"),
        F.count_if(ordinals).alias("contradictingOrdinals"),
        F.count_if(names).alias("contradictingAcronyms"),
        F.count_if(ordinals & names).alias("contradictingBoth"),
    )
