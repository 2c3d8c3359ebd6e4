"""Groups of repeated byte strings, with every occurrence in the corpus.

The interval trees of ``suffixes`` give the repeats of an anchor by its distinct blocks. Here a
group gets back all places where its blocks stand: equal blocks share their first
occurrence's groups, shifted. Blocks that recur as a whole are groups themselves, and anchors with
very many blocks contribute the groups of their windows. Groups that lie side by side and
have the same occurrences, shifted, are one longer repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import blocks, suffixes
from eventloom.llm.suffixes import WIDTH
from eventloom.session import stage

_KEY = ["k1", "k2", "kind"]
_PLACE = ["doc_id", "copy", "start"]
#: Window starts of a document that are joined as one key.
_STRIP = 64


def _strip(start) -> F.Column:
    return F.floor(start / _STRIP).cast("int")


def _window_groups(many: DataFrame) -> DataFrame:
    """Every window of the blocks of frequent anchors, as a piece of ``WIDTH`` bytes named by its hash."""
    cells = stage(suffixes._cells(many), "group-cells")
    single = cells.select("h", "doc_id", "copy", "lo", F.posexplode("windows").alias("step", "w"))
    return single.select(
        F.col("h").alias("k1"), F.col("w").alias("k2"), F.lit(1).alias("kind"), F.lit(WIDTH).alias("length"), "doc_id", "copy", (F.col("lo") + F.col("step")).alias("start")
    )


def _everywhere(pieces: DataFrame, found: blocks.Candidates) -> DataFrame:
    """The pieces of first occurrences at all occurrences of the blocks in which they start.

    The blocks of a document share no window start, so a place is in one block only.
    """
    first = found.distinct.select("h", "x", F.col("doc_id").alias("d"), F.col("copy").alias("c"), "lo", "size")
    first = first.withColumn("strip", F.explode(F.sequence(_strip(F.col("lo")), _strip(F.col("lo") + F.col("size") - 1))))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")) & (_strip(F.col("start")) == F.col("strip"))
    inside = F.col("start").between(F.col("lo"), F.col("lo") + F.col("size") - 1)
    named = pieces.join(first, same & inside).select(*_KEY, "length", "h", "x", (F.col("start") - F.col("lo")).alias("shift"))
    placed = found.blocks.select("h", "x", "doc_id", "copy", "lo")
    return named.join(placed, ["h", "x"]).select(*_KEY, "length", "doc_id", "copy", (F.col("lo") + F.col("shift")).alias("start"))


def repeat_groups(documents: DataFrame) -> DataFrame:
    """``group``, ``length``, ``doc_id``, ``copy`` and ``start`` of every occurrence of repeated strings.

    All occurrences of a group are equal over ``length`` bytes, at least ``WIDTH``. For every window that
    starts at two places or more, one group holds exactly its places and covers it. A string that
    repeats around or inside one with more occurrences has its group on either side of it, up to the
    borders of blocks. A null text has no windows; rows that repeat a ``doc_id`` and its text
    are two places with the same name; an empty table has no groups.
    """
    found = suffixes.find_candidates(documents)
    few, many = suffixes.mixed_texts(documents, found)
    trees = suffixes.shard_groups(few).select(F.col("h").alias("k1"), F.col("number").cast("long").alias("k2"), F.lit(0).alias("kind"), "length", *_PLACE)
    parts = _everywhere(trees.unionByName(_window_groups(many)), found)
    whole = blocks.repeats_of(found).select(
        F.col("h").alias("k1"), F.col("x").alias("k2"), F.lit(2).alias("kind"), (F.col("size") - 1 + WIDTH).alias("length"), "doc_id", "copy", F.col("lo").alias("start")
    )
    places = stage(parts.unionByName(whole), "group-places")
    return _joined(places)


def _joined(places: DataFrame) -> DataFrame:
    """Neighbouring groups with the same shifted occurrences, as one."""
    firsts = places.groupBy(*_KEY, "length").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stage(firsts.select(*_KEY, "length", "n", *[F.col(f"first.{c}").alias(f"first_{c}") for c in _PLACE]), "group-firsts")
    member = [F.col("doc_id"), F.col("copy"), F.col("start") - F.col("first_start")]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *member).cast("decimal(38,0)"))
    own = [*_KEY, "length"]
    marked = places.join(firsts.select(*own, "first_start"), own).groupBy(*own).agg(total(1).alias("s1"), total(2).alias("s2"))
    named = firsts.join(marked, own)
    # groups with the same occurrences, by their place in the first document that has them
    side = W.partitionBy("n", "s1", "s2", "first_doc_id", "first_copy").orderBy("first_start", "length", *_KEY)
    reached = F.max(F.col("first_start") + F.col("length") - WIDTH).over(side.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first_start") > reached + 1, F.lit(True)).cast("int")
    runs = named.withColumn("opens", opens).withColumn("run", F.sum("opens").over(side))
    alike = ["n", "s1", "s2", "first_doc_id", "first_copy", "run"]
    chosen = runs.groupBy(*alike).agg(
        F.min_by(F.struct(*own), F.struct("first_start", "length", *_KEY)).alias("one"),
        (F.max(F.col("first_start") + F.col("length")) - F.min("first_start")).alias("long"),
        F.min("first_start").alias("begin"),
    )
    groups = chosen.select("one.*", "long", F.xxhash64("n", "s1", "s2", "first_doc_id", "first_copy", "begin").alias("group"))
    return places.join(groups, own).select("group", F.col("long").alias("length"), *_PLACE)
