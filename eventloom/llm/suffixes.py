"""Repeated byte strings by the interval tree of an enhanced suffix array.

Every window of ``width`` bytes belongs to the block of its anchor (``blocks``). A shard
sorts the suffixes that begin at the anchors of its blocks, each with its left context, into
an enhanced suffix array: order, and length of the common prefix with the one before. A scan
with a stack gives the tree of common-prefix intervals. Within an interval the left contexts
are scanned in the same way: where they differ, a repeat ends to the left, and where the
members come from several children, it ends to the right. Such a group is a maximal repeat
with all its occurrences, as far as the blocks reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import blocks
from eventloom.llm.arrays import Prefixes, Slice, pair_hash
from eventloom.session import stage

WIDTH = 200
SHAPE = blocks.Shape(WIDTH, 64)
#: Distinct blocks of an anchor up to which a task compares them in one suffix array; blocks
#: of more frequent anchors are split into cells and windows, which Spark groups by hash.
MEMBERS = 512
#: Blocks for each shard.
SHARD_BLOCKS = 8192
#: Window starts in a cell of a frequent block.
CELL = 16


def _symbols(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    return part.data, part.bounds


def common_lengths(texts: list[bytes]) -> list[int]:
    """Length of the common prefix of each text with the one before; 0 for the first."""
    out = [0]
    for before, text in zip(texts, texts[1:], strict=False):
        size = min(len(before), len(text))
        if before[:size] == text[:size]:
            out.append(size)
            continue
        low, high = 0, size  # the prefixes of length low agree, those of length high do not
        while high - low > 1:
            middle = (low + high) // 2
            if before[low:middle] == text[low:middle]:
                low = middle
            else:
                high = middle
        out.append(low)
    return out


def intervals(lengths: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """The interval tree, children first: common length, first and last place, where children begin.

    ``lengths[i]`` is the common prefix of entries i - 1 and i; an interval is divided where
    it equals the interval's own.
    """
    stack: list[tuple[int, int, list[int]]] = []  # length, first place, begins of children
    for place in range(1, len(lengths) + 1):
        length = lengths[place] if place < len(lengths) else -1
        first = place - 1
        while stack and stack[-1][0] > length:
            top, first, begins = stack.pop()
            yield top, first, place - 1, begins
        if length >= 0:
            if stack and stack[-1][0] == length:
                stack[-1][2].append(place)
            else:
                stack.append((length, first, [first, place]))


def maximal_repeats(left: list[bytes], right: list[bytes], width: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``width`` bytes across the anchor of one group.

    ``left`` are the contexts before the anchor, reversed; ``right`` begin at the anchor. Gives
    the lengths to the left and right of the anchor's first byte, and the members.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    by_left = {member: rank for rank, member in enumerate(sorted(range(len(left)), key=left.__getitem__))}
    for length, first, last, begins in intervals(common_lengths([right[i] for i in order])):
        if not length:
            continue
        members = sorted(order[first : last + 1], key=by_left.__getitem__)
        child = {}
        for number, begin in enumerate(begins):
            end = begins[number + 1] if number + 1 < len(begins) else last + 1
            for place in range(begin, end):
                child[order[place]] = number
        for before, low, high, _ in intervals(common_lengths([left[i] for i in members])):
            group = members[low : high + 1]
            if before + length >= width and any(child[i] != child[group[0]] for i in group):
                yield before, length, group


def _shard_repeats(width: int):
    """Repeats of all anchors of a shard: one row for each occurrence of each group."""

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        borders = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
        doc, copy, lo = (table.column(n).to_pylist() for n in ("doc_id", "copy", "lo"))
        at, content = table.column("at").to_pylist(), table.column("content").to_pylist()
        out: list[tuple] = []
        for begin, end in zip(borders[:-1], borders[1:], strict=True):
            own = order[begin:end]
            places = [at[i] for i in own]
            left = [content[i][:p][::-1] for i, p in zip(own, places, strict=True)]
            right = [content[i][p:] for i, p in zip(own, places, strict=True)]
            for number, (before, after, group) in enumerate(maximal_repeats(left, right, width)):
                for member in group:
                    i = own[member]
                    out.append((int(h[i]), number, before + after, doc[i], copy[i], lo[i] + places[member] - before))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        names = ("h", "number", "length", "doc_id", "copy", "start")
        values = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=list(names))

    return run


def find_candidates(documents: DataFrame) -> blocks.Candidates:
    """The blocks of all texts whose anchor repeats."""
    return blocks.candidates(blocks.block_table(documents, _symbols, SHAPE))


def mixed_texts(documents: DataFrame, found: blocks.Candidates) -> tuple[DataFrame, DataFrame]:
    """Distinct blocks that must be compared, with their texts: of anchors with few and with many of them."""
    cut = lambda text, lo, size: [text[a : a + n - 1 + WIDTH] for a, n in zip(lo.tolist(), size.tolist(), strict=True)]
    texts = stage(blocks.with_texts(found.mixed, documents, cut, "binary"), "block-texts")
    return texts.where(F.col("m") <= MEMBERS), texts.where(F.col("m") > MEMBERS)


def shard_groups(few: DataFrame) -> DataFrame:
    """The maximal repeats of each anchor, one row for each distinct block that holds one."""
    shards = 1 + few.count() // SHARD_BLOCKS
    grouped = few.select("h", "doc_id", "copy", "lo", "at", "content", F.pmod("h", F.lit(shards)).alias("shard")).groupBy("shard")
    return stage(
        grouped.applyInArrow(_shard_repeats(WIDTH), "h long, number int, length int, doc_id long, copy long, start int"),
        "repeats",
    )


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats, and the ranges of windows that repeat.

    The repeats have ``h`` and ``number`` (which name a group), ``length``, ``doc_id``, ``copy``
    and ``start`` of each occurrence in the blocks of anchors that have several blocks; equal
    blocks are represented by the first. The ranges (``doc_id``, ``copy``, ``lo``, ``size``)
    hold every window that starts anywhere else too. ``repeat_groups`` gives whole groups.
    """
    found = find_candidates(documents)
    few, many = mixed_texts(documents, found)
    groups = shard_groups(few)
    ranges = blocks_that_repeat(found)
    ranges = ranges.unionByName(groups.select("doc_id", "copy", F.col("start").alias("lo"), (F.col("length") - WIDTH + 1).alias("size")).distinct())
    return groups, ranges.unionByName(_frequent(many))


def blocks_that_repeat(found: blocks.Candidates) -> DataFrame:
    """Blocks all of whose windows repeat: they occur twice as a whole."""
    return blocks.repeats_of(found).select("doc_id", "copy", "lo", "size")


def _cells(texts: DataFrame) -> DataFrame:
    """Blocks of frequent anchors, cut at every ``CELL`` starts counted from the anchor.

    All windows of a cell cover its core, so equal windows lie in cells with equal cores:
    the core's hash is the key (``h``) of a finer block table. ``windows`` are the hashes of
    the cell's windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                rows, keys, whole_cells, starts, sizes, windows = [], [], [], [], [], []
                for row, (content, size, at) in enumerate(zip(batch.column("content"), batch.column("size").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                    prefixes = Prefixes(np.frombuffer(content.as_buffer(), np.uint8))
                    steps = np.arange(size)
                    cell = (steps - at) // CELL
                    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                    end = np.append(begin[1:], size) - 1
                    core = at + cell[begin] * CELL
                    cores = prefixes.of(core + CELL - 1, core + WIDTH)
                    keys.append(pair_hash(cores, (cell[begin] + WIDTH).astype(np.uint64)))
                    whole_cells.append(pair_hash(prefixes.of(begin, end + WIDTH), (begin - core + CELL).astype(np.uint64)))
                    rows.append(np.full(len(begin), row))
                    starts.append(begin)
                    sizes.append(end - begin + 1)
                    windows.append(prefixes.of(steps, steps + WIDTH))
                rows, sizes = np.concatenate(rows), np.concatenate(sizes)
                h = batch.column("h").to_numpy().view(np.uint64)[rows]
                lo = batch.column("lo").to_numpy()[rows] + np.concatenate(starts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(windows).view(np.int64)))
                columns = [batch.column(n).take(pa.array(rows)) for n in ("doc_id", "copy")]
                columns += [pa.array(v.view(np.int64)) for v in (pair_hash(h, np.concatenate(keys)), np.concatenate(whole_cells))]
                columns += [pa.array(v.astype(np.int32)) for v in (lo, sizes, np.zeros(len(rows)))]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "copy", "h", "x", "lo", "size", "at", "windows"])

    rows = texts.select("h", "doc_id", "copy", "lo", "size", "at", "content")
    return rows.mapInArrow(run, "doc_id long, copy long, h long, x long, lo int, size int, at int, windows array<long>")


def _frequent(texts: DataFrame) -> DataFrame:
    """Repeating windows of anchors with very many blocks, as ranges.

    Cells are told apart as blocks were: a core that occurs once has no repeats, equal cells
    repeat as a whole, and only cells on the border of a repeat are split into windows.
    """
    cells = stage(_cells(texts), "cells")
    found = blocks.candidates(cells.drop("windows"))
    edges = found.mixed.select("h", "x", "doc_id", "copy", "lo")
    own = cells.select("h", "x", F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("lo").alias("l"), "windows")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")) & (F.col("lo") == F.col("l"))
    rows = edges.withColumnsRenamed({"h": "k", "x": "y"}).join(own, (F.col("k") == F.col("h")) & (F.col("y") == F.col("x")) & same)
    windows = stage(rows.select("h", "doc_id", "copy", "lo", "windows"), "edge-cells")
    single = windows.select("h", "doc_id", "copy", "lo", F.posexplode("windows").alias("step", "w"))
    often = stage(single.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w"), "frequent-windows")
    repeated = single.join(often, ["h", "w"]).select("doc_id", "copy", (F.col("lo") + F.col("step")).alias("lo"), F.lit(1).alias("size"))
    return blocks_that_repeat(found).unionByName(repeated)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``kept`` (bytes) and ``spans`` (start and end of removed runs).

    Every byte goes that lies in a ``WIDTH``-byte string that starts anywhere else too, in
    this or another row, judged on the input. A null text is empty. Rows that repeat a
    ``doc_id`` and its text are two places. Kept bytes may end inside a character.
    """
    _, ranges = repeats(documents)
    rows = blocks.with_ranges(documents, stage(ranges, "repeat-ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                kept, sizes, spans = [], [], []
                for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("ranges"), strict=True):
                    data = text.as_py() or b""
                    gone = blocks.covered(ranges.values if ranges.is_valid else None, WIDTH, len(data))
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                    sizes.append(len(data))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def suffix_digests(documents: DataFrame) -> DataFrame:
    return without_repeats(documents).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_digests(spark.read.parquet(f"{folder}/documents.parquet"))


OP1_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, s, substr(hex(b), 2 * s - 1, 400) AS w FROM docs, LATERAL (SELECT unnest(range(1, octet_length(b) - 198)) AS s)),
often AS (SELECT md5(w) AS k FROM windows GROUP BY md5(w) HAVING count(*) > 1),
starts AS (SELECT doc_id, s FROM windows JOIN often ON md5(w) = k),
edges AS (
  SELECT doc_id, s, max(s + 199) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM starts
),
runs AS (SELECT doc_id, s, sum(CASE WHEN reached IS NULL OR s > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM edges),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 199 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
kept AS (
  SELECT d.doc_id, count(g.a) AS n_spans, coalesce(sum(g.e - g.a + 1), 0) AS n_removed,
    CASE WHEN count(g.a) = 0 THEN hex(any_value(d.b))
      ELSE string_agg(substr(hex(d.b), 2 * g.before + 1, 2 * (g.a - g.before - 1)) || CASE WHEN g.next IS NULL THEN substr(hex(d.b), 2 * g.e + 1) ELSE '' END, '' ORDER BY g.a) END AS h
  FROM docs d LEFT JOIN gaps g ON d.doc_id = g.doc_id GROUP BY d.doc_id
)
SELECT k.doc_id, octet_length(d.b) AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(h)) AS kept_sha256
FROM kept k JOIN docs d ON k.doc_id = d.doc_id
"""
