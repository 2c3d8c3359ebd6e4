"""Near duplicates by circulant MinHash, banding, and exact verification.

Documents with equal shingle sets form one class. Classes that share a band are linked if
their full sets are similar enough, in two steps: every class is compared with the first class
of each of its buckets, and what lies in different components after that is compared pair by
pair, unless a bound on the overlap rules the link out. The bound counts, in 64 cells, only
shingles that several classes have, so a large group of copies of one text needs few
comparisons though all its members share buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.arrays import slices
from eventloom.llm.shingles import band_hashes, set_hashes, shingle_sets, signatures
from eventloom.session import stage

#: Stands for a missing id: such rows come after all others.
_NO_ID = (1 << 63) - 1
_CELLS = 64


@dataclass(frozen=True)
class Settings:
    """Bands of 4 rows miss a pair with similarity 0.75 with a probability of 5 in a million."""

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def text_digest() -> Column:
    """128 bits that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def signature_table(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``n`` (set size), ``s1``, ``s2`` (hash of the set), and ``bands`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = shingle_sets(part, settings.shingle)
                s1, s2 = set_hashes(sets)
                bands = band_hashes(signatures(sets, settings.bands * settings.rows), settings.rows)
                ends = pa.array(np.arange(part.rows + 1, dtype=np.int32) * settings.bands)
                columns = [
                    batch.column("doc_id").slice(part.first, part.rows),
                    batch.column("digest").slice(part.first, part.rows),
                    pa.array(np.diff(sets.bounds)),
                    _signed(s1),
                    _signed(s2),
                    pa.ListArray.from_arrays(ends, _signed(bands.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "s1", "s2", "bands"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, n long, s1 long, s2 long, bands array<long>")


def class_sets(documents: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``node`` and its sorted ``shingles`` for each wanted class, from one document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = shingle_sets(part, settings.shingle)
                s1, s2 = set_hashes(sets)
                lists = pa.ListArray.from_arrays(pa.array(sets.bounds.astype(np.int32)), _signed(sets.values))
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(part.first, part.rows), _signed(s1), _signed(s2), lists], names=["d", "s1", "s2", "shingles"])

    ids = wanted.select(F.col("node.d").alias("d")).distinct()
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), "text").join(ids, "d", "left_semi")
    sets = texts.mapInArrow(run, "d long, s1 long, s2 long, shingles array<long>")
    # rows may repeat an id with other texts; one row a class is enough
    return sets.select(_node().alias("node"), "shingles").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _node() -> Column:
    return F.struct("d", "s1", "s2")


def _similar(settings: Settings, same: Column) -> Column:
    return 100 * same >= settings.percent * (F.col("a_n") + F.col("b_n") - same)


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar, by the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    counted = joined.select("a", "b", F.size("a_set").alias("a_n"), F.size("b_set").alias("b_n"), F.size(F.array_intersect("a_set", "b_set")).alias("same"))
    return counted.where(_similar(settings, F.col("same"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and the least node (``root``) that links (``a``, ``b``) connect it to.

    Alternates large and small stars, which shorten paths, until nothing changes. Nodes
    without a link have no row.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours point to the least one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        # small star: the node and its smaller neighbours point to the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stage(small, "small-star")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = state


def _first_pairs(shared: DataFrame, settings: Settings) -> DataFrame:
    """Each class with the first class of its buckets, if their sizes allow a link."""
    sizes = 100 * F.least("n", "first_n") >= settings.percent * F.greatest("n", "first_n")
    return shared.where((F.col("node") != F.col("first")) & sizes).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def _common_cells(sets: DataFrame) -> DataFrame:
    """For each class, how many shingles that other classes have too fall into each cell."""
    single = sets.select("node", F.explode("shingles").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle")
    cell = F.pmod(F.col("shingle"), F.lit(_CELLS))
    counts = [F.count(F.when(F.col("cell") == c, 1)).cast("int") for c in range(_CELLS)]
    return single.join(common, "shingle").select("node", cell.alias("cell")).groupBy("node").agg(F.array(*counts).alias("cells"))


def _open_pairs(shared: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs in one bucket but in different components that the bounds do not rule out."""
    marked = shared.select("h", "node", "n").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    buckets = marked.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    rows = stage(marked.join(buckets, "h"), "open-buckets")
    cells = _common_cells(sets.join(rows.select("node").distinct(), "node", "left_semi"))
    # a class needs common shingles for percent of its own set to have any link
    common = F.aggregate("cells", F.lit(0), lambda a, x: a + x)
    rows = stage(rows.join(cells, "node").withColumn("common", common).where(100 * F.col("common") >= settings.percent * F.col("n")), "bounded")
    left, right = (rows.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "root", "common", "cells")]) for side in "ab")
    need = settings.percent * (F.col("a_n") + F.col("b_n"))
    cap = F.aggregate(F.zip_with("a_cells", "b_cells", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    condition = (
        (left["h"] == right["h"])
        & (F.col("a_node") < F.col("b_node"))
        & (F.col("a_root") != F.col("b_root"))
        & (100 * F.least("a_n", "b_n") >= settings.percent * F.greatest("a_n", "b_n"))
        & ((100 + settings.percent) * F.least("a_common", "b_common") >= need)
        & ((100 + settings.percent) * cap >= need)
    )
    pairs = left.join(right, condition).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def groups(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``n`` (set size), and the first node (``root``) of the
    component of every row; no root without words."""
    signed = stage(signature_table(documents, settings), "signatures")
    some = signed.where("n > 0").withColumn("d", F.coalesce("doc_id", F.lit(_NO_ID)))
    classes = some.groupBy("s1", "s2").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stage(classes.select(_node().alias("node"), "n", "bands"), "classes")
    rows = classes.select(F.explode("bands").alias("h"), "node", "n")
    buckets = rows.groupBy("h").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = buckets.select("h", F.col("first.node").alias("first"), F.col("first.n").alias("first_n"))
    shared = stage(rows.join(buckets, "h"), "shared-buckets")
    sets = stage(class_sets(documents, shared.select("node").distinct(), settings), "candidate-sets")

    tested = stage(_first_pairs(shared, settings), "first-pairs")
    links = stage(verified(tested, sets, settings), "first-links")
    labels = components(links)
    more = verified(stage(_open_pairs(shared, labels, tested, sets, settings), "open-pairs"), sets, settings)
    labels = components(links.unionByName(more))

    roots = classes.select("node").join(labels, "node", "left").select("node.s1", "node.s2", F.coalesce("root", "node").alias("root"))
    return signed.join(roots, ["s1", "s2"], "left").select("doc_id", "digest", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the least ``doc_id`` that links reach, the own one included; ``kept``
    marks the document that has it. Documents without words (null, empty or white text) are
    linked with nothing. Rows that repeat a ``doc_id`` are judged by their own texts. Rows
    without ``doc_id`` come after all others: a group of such rows only has no component id,
    and its rows are kept.
    """
    found = groups(documents, settings)
    group = F.when(F.col("n") > 0, F.nullif("root.d", F.lit(_NO_ID))).otherwise(F.col("doc_id"))
    result = found.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_copies(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each component, whole: the one with the least ``doc_id``, then the least digest of its text.

    Rows count by their own texts: a row that repeats an id is judged like any other, rows
    without an id come after all others, and of equal rows one stays. Rows without words (null, empty
    or white text) are copies of nothing and all stay.
    """
    found = stage(groups(documents, settings).where("n > 0"), "near-groups")
    row = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "digest")
    first = found.groupBy("root").agg(F.min(row).alias("row"))
    first = found.join(first, "root").where(row == F.col("row")).groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    first = stage(first.select(F.col("row.d").alias("__d"), F.col("row.digest").alias("__digest"), "times"), "first-copies")
    own = documents.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__digest": text_digest()})
    once = own.join(first.where("times = 1"), ["__d", "__digest"], "left_semi")
    equal = own.join(first.where("times > 1"), ["__d", "__digest"], "left_semi").dropDuplicates(["__d", "__digest"])
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return once.unionByName(equal).drop("__d", "__digest").unionByName(documents.where(~words))
