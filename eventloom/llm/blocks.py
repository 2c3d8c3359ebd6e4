"""Blocks of consecutive windows that share an anchor.

A window is ``width`` consecutive symbols of a text. Its anchor is the least hash among the
``gram``-symbol parts inside it, so equal windows have equal anchors, wherever they lie.
Consecutive windows with the same anchor are one block: about one for 70 bytes or 8 words.
Windows whose anchor occurs once in the corpus cannot repeat; blocks that are equal as a
whole repeat as a whole; only the rest needs a comparison of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.arrays import Prefixes, Slice, slices
from eventloom.session import stage

#: Low bits of a packed hash that hold a place; longer sequences are cut with an overlap.
_PLACE_BITS = 24
#: Texts cut together.
_TEXTS = 256
_SCHEMA = "doc_id long, copy long, h long, x long, lo int, size int, at int"


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int


@dataclass
class Found:
    """Blocks of a slice: text row, anchor hash, hash of the whole block, first window, windows,
    and where in the block its anchor begins."""

    row: np.ndarray
    h: np.ndarray
    x: np.ndarray
    lo: np.ndarray
    size: np.ndarray
    at: np.ndarray


_NONE = np.zeros(0, np.int64)
_EMPTY = Found(_NONE, _NONE.astype(np.uint64), _NONE.astype(np.uint64), _NONE, _NONE, _NONE)


def _least(packed: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values."""
    reach, out = 1, packed
    while 2 * reach <= span:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_blocks(symbols: np.ndarray, bounds: np.ndarray, shape: Shape) -> Found:
    """``symbols`` of several texts, which begin and end at ``bounds``."""
    most = (1 << _PLACE_BITS) - shape.width
    if len(symbols) > most:
        parts = [_find(symbols, bounds, shape, first, min(len(symbols), first + most + shape.width - 1)) for first in range(0, len(symbols), most)]
        return Found(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("row", "h", "x", "lo", "size", "at")])
    return _find(symbols, bounds, shape, 0, len(symbols)) if len(symbols) >= shape.width else _EMPTY


def _find(symbols: np.ndarray, bounds: np.ndarray, shape: Shape, first: int, last: int) -> Found:
    """Blocks of the windows inside ``[first, last)``."""
    own = symbols[first:last]
    count = max(0, len(own) - shape.width + 1)
    starts = np.arange(count)
    rows = np.searchsorted(bounds, starts + first, "right") - 1
    fits = bounds[rows + 1] - first - starts >= shape.width
    starts, rows = starts[fits], rows[fits]
    if not len(starts):
        return _EMPTY
    prefixes = Prefixes(own)
    places = np.arange(len(own) - shape.gram + 1)
    grams = prefixes.of(places, places + shape.gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    anchors = (_least((grams & ~low) | places.astype(np.uint64), shape.width - shape.gram + 1) & low).astype(np.int64)[starts]
    begins = np.ones(len(starts), bool)
    begins[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(starts)))
    lo = starts[at]
    x = Prefixes(own, 1).of(lo, lo + size - 1 + shape.width)
    return Found(rows[at], grams[anchors[at]], x, lo + first - bounds[rows[at]], size, anchors[at] - lo)


def copy_hash(text: Column) -> Column:
    """Tells rows that repeat a ``doc_id`` with another text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def block_table(documents: DataFrame, symbols: Callable[[Slice], tuple[np.ndarray, np.ndarray]], shape: Shape) -> DataFrame:
    """All blocks of all whole texts, written: the table of the corpus that all steps read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                found = find_blocks(*symbols(part), shape)
                rows = pa.array(part.first + found.row)
                columns = [batch.column("doc_id").take(rows), batch.column("copy").take(rows)]
                columns += [pa.array(v.view(np.int64)) for v in (found.h, found.x)] + [pa.array(v.astype(np.int32)) for v in (found.lo, found.size, found.at)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "h", "x", "lo", "size", "at"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", copy_hash(F.col("text")).alias("copy"))
    return stage(rows.mapInArrow(run, _SCHEMA), "blocks")


def place() -> Column:
    """Order of occurrences: by document, then by place in it."""
    return F.struct("doc_id", "copy", "lo", "size", "at")


@dataclass
class Candidates:
    """``blocks``: those whose anchor repeats. ``distinct``: each of them once, with its first
    occurrence, how often it occurs (``n``), and how many different blocks its anchor has (``m``)."""

    blocks: DataFrame
    distinct: DataFrame

    @property
    def mixed(self) -> DataFrame:
        """Blocks that share only a part with others, if anything: their texts must be compared."""
        return self.distinct.where("m > 1")


def candidates(blocks: DataFrame) -> Candidates:
    anchors = stage(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors")
    repeated = stage(blocks.join(anchors, "h", "left_semi"), "repeated-blocks")
    distinct = stage(repeated.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("rep")), "distinct-blocks")
    members = stage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "anchor-members")
    return Candidates(repeated, distinct.join(members, "h").select("h", "x", "n", "m", "rep.*"))


def repeats_of(found: Candidates) -> DataFrame:
    """Occurrences of blocks that occur twice or more as a whole, with the first one (``rep``)."""
    often = found.distinct.where("n > 1").select("h", "x", place().alias("rep"))
    return found.blocks.join(often, ["h", "x"])


def with_texts(distinct: DataFrame, documents: DataFrame, cut: Callable[[bytes, np.ndarray, np.ndarray], list], kind: str) -> DataFrame:
    """``distinct`` with the ``content`` of each block, cut from its first occurrence.

    ``cut`` gets a text, and the first windows and numbers of windows of its blocks. The blocks of a text
    travel with it, so a task holds one batch of texts.
    """
    wanted = distinct.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "size", "at", "h", "x", "n", "m")).alias("own"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "own")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", copy_hash(F.col("text")).alias("copy"))
    joined = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))).select("doc_id", "copy", "text", "own")
    names = ("lo", "size", "at", "h", "x", "n", "m")
    content = pa.binary() if kind == "binary" else pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), _TEXTS):
                batch = whole.slice(first, _TEXTS)
                lists = batch.column("own")
                own, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                lo, size = (own.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                pieces, at = [], 0
                for text, count in zip(batch.column("text").cast(pa.binary()), counts, strict=True):
                    pieces += cut(text.as_py(), lo[at : at + count], size[at : at + count])
                    at += count
                rows = pa.array(np.repeat(np.arange(len(batch)), counts))
                columns = [batch.column("doc_id").take(rows), batch.column("copy").take(rows), *[own.field(i) for i in range(len(names))], pa.array(pieces, content)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", *names, "content"])

    return joined.mapInArrow(run, f"doc_id long, copy long, lo int, size int, at int, h long, x long, n long, m long, content {kind}")


def gather_ranges(ranges: DataFrame) -> DataFrame:
    """One row for each text that loses something: its ranges of windows (``lo``, ``size``)."""
    return ranges.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "size")).alias("ranges")).select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "ranges")


def with_ranges(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of ``documents`` with its ``ranges``, null where it loses nothing."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", copy_hash(F.col("text")).alias("copy"))
    return rows.join(gather_ranges(ranges), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left").select("doc_id", "text", "ranges")


def covered(ranges, width: int, count: int) -> np.ndarray:
    """Which of ``count`` symbols lie in any window of the ranges."""
    change = np.zeros(count + 1, np.int64)
    if ranges is not None and len(ranges):
        lo = ranges.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = lo + ranges.field(1).to_numpy(zero_copy_only=False) - 1 + width
        np.add.at(change, lo, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change)[:count] > 0
