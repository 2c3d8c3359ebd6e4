"""SimHash near duplicates by anchor-point covering.

The anchors are the words of a covering code: pairs of words of the binary Golay code, one for
each of two blocks of 23 bits of the fingerprint. The code is perfect, so every block has one
anchor within its covering radius of 3, its home. A fingerprint is replicated to every anchor
within the radius plus the threshold, where the blocks share the threshold. If two fingerprints
differ in at most ``threshold`` bits, each of them is replicated to the other's home: the members
of an anchor are compared with its replicas, and all pairs are found. The other 18 bits count
only in the comparison.

Anchors that are home to many fingerprints (large groups of near copies) are refined by the
finest covering code, all words of 64 bits with radius 0: each side goes to the words within
half of the threshold, so no word has more than a few members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.arrays import LOWER
from eventloom.llm.near_duplicates import components
from eventloom.session import stage

#: Stands for a missing id: such rows come after all others.
_NO_ID = (1 << 63) - 1
_LOWER = LOWER.tobytes()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at once, and fingerprints replicated at once.
_PIECE, _ROWS = 1 << 20, 4096

#: Fixed values of the binary Golay code: length, covering radius, and generator polynomial
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_LENGTH, _RADIUS, _GENERATOR = 23, 3, 0b110001110101
_BLOCK = (1 << _LENGTH) - 1


@dataclass(frozen=True)
class Settings:
    """``crowded``: an anchor that is home to more fingerprints is refined."""

    shingle: int = 3
    threshold: int = 2
    crowded: int = 1024
    seed: int = 42


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text cut at white space into parts of about a megabyte."""
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + _PIECE) if start + _PIECE < len(data) else None
        end = space.start() if space else len(data)
        yield data[start:end]
        start = end


def fingerprint(data: bytes, settings: Settings = Settings()) -> int:
    """The fingerprint of a text, as an unsigned number: a bit is 1 if set in over half of the
    hashes of its shingles. Without words it is 0."""
    size, seed, digest = settings.shingle, settings.seed, xxhash.xxh64_intdigest
    ones, total, last = np.zeros(64, np.int64), 0, []
    for piece in _pieces(data.translate(_LOWER)):
        words = last + piece.split()
        if len(words) >= size:
            shingles = zip(*(words[step:] for step in range(size)), strict=False)
            hashes = np.array([digest(b" ".join(s), seed) for s in shingles], np.uint64)
            total += len(hashes)
            for first in range(0, len(hashes), 1 << 14):
                octets = hashes[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        last = words[max(0, len(words) - size + 1) :]
    if not total:
        return digest(b" ".join(last), seed) if last else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id`` and fingerprint ``f`` (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", settings) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "f"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, f long")


class CoveringCode:
    """Words of the Golay code around any block: ``patterns[e]`` has the differences of weight
    3 + e (up to 3 for e = 0) by syndrome s, in ``bounds[e][s]:bounds[e][s + 1]``."""

    def __init__(self, threshold: int):
        steps = np.zeros(_LENGTH, np.int64)
        value = 1
        for bit in range(_LENGTH):
            steps[bit] = value
            value <<= 1
            value ^= _GENERATOR if value >> 11 else 0
        self.steps = steps
        self.patterns, self.bounds = [], []
        for excess in range(threshold + 1):
            weights = range(_RADIUS + 1) if excess == 0 else [_RADIUS + excess]
            found = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(_LENGTH), w)], np.int64)
            syndromes = self.syndromes(found)
            order = np.argsort(syndromes, kind="stable")
            self.patterns.append(found[order])
            self.bounds.append(np.searchsorted(syndromes[order], np.arange(2049)))

    def syndromes(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), np.int64)
        for bit in range(_LENGTH):
            out ^= np.where(blocks >> bit & 1, self.steps[bit], 0)
        return out

    def anchors(self, f: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Position in ``f`` and anchor of every replica."""
        blocks = [(f & _BLOCK), (f >> _LENGTH) & _BLOCK]
        syndromes = [self.syndromes(b) for b in blocks]
        rows, found = [], []
        for low in range(threshold + 1):
            for high in range(threshold + 1 - low):
                starts = [self.bounds[e][s] for e, s in zip((low, high), syndromes, strict=True)]
                counts = [self.bounds[e][s + 1] - b for e, s, b in zip((low, high), syndromes, starts, strict=True)]
                each = counts[0] * counts[1]
                row = np.repeat(np.arange(len(f)), each)
                place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                width = counts[1][row]
                left = blocks[0][row] ^ self.patterns[low][starts[0][row] + place // np.maximum(width, 1)]
                right = blocks[1][row] ^ self.patterns[high][starts[1][row] + place % np.maximum(width, 1)]
                rows.append(row)
                found.append(left << _LENGTH | right)
        return np.concatenate(rows), np.concatenate(found)


def replicas(distinct: DataFrame, threshold: int) -> DataFrame:
    """``anchor`` and ``f`` for every anchor within the radius plus ``threshold``; 0 gives the homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = CoveringCode(threshold)
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False)
            for first in range(0, len(f), _ROWS):
                part = f[first : first + _ROWS]
                rows, found = code.anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], names=["anchor", "f"])

    return distinct.select("f").mapInArrow(run, "anchor long, f long")


def nearby_words(distinct: DataFrame, distance: int) -> DataFrame:
    """``word`` and ``f`` for all words of 64 bits that differ in at most ``distance`` bits."""
    flips = [sum(1 << b for b in bits) for w in range(distance + 1) for bits in combinations(range(64), w)]
    masks = np.array(flips, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False)
            for first in range(0, len(f), _ROWS):
                part = f[first : first + _ROWS]
                words = (part[:, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(part, len(masks)))], names=["word", "f"])

    return distinct.select("f").mapInArrow(run, "word long, f long")


def _close(left: DataFrame, right: DataFrame, key: str, threshold: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of fingerprints that meet at a key and differ in few bits.

    Both sides hold many rows for each fingerprint, but the planner takes what Python makes of a
    row for one row and would broadcast it: the sides are always merged.
    """
    left, right = left.withColumnRenamed("f", "a").hint("merge"), right.withColumnRenamed("f", "b").hint("merge")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return left.join(right, (left[key] == right[key]) & near).select("a", "b")


def linked(distinct: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All pairs ``a`` < ``b`` of distinct fingerprints that differ in at most ``threshold`` bits.

    A fingerprint has at most as many links as there are words within the threshold, however
    many documents share it.
    """
    homes = stage(replicas(distinct, 0), "anchor-homes")
    crowded = homes.groupBy("anchor").count().where(F.col("count") > settings.crowded).select("anchor")
    crowded = stage(crowded, "crowded-anchors")
    around = replicas(distinct, settings.threshold)
    if crowded.isEmpty():
        return _close(homes, around, "anchor", settings.threshold)
    few = _close(homes.join(crowded, "anchor", "left_anti"), around, "anchor", settings.threshold)
    # of a refined anchor, homes and replicas meet at the words between them
    inner = stage(homes.join(crowded, "anchor", "left_semi").select("f").distinct(), "crowded-homes")
    outer = stage(around.join(crowded, "anchor", "left_semi").select("f").distinct(), "crowded-replicas")
    half = settings.threshold // 2
    refined = _close(nearby_words(inner, settings.threshold - half), nearby_words(outer, half), "word", settings.threshold)
    return few.unionByName(refined).distinct()


def near_copies(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of every row.

    ``component_id`` is the least ``doc_id`` that links reach, the own one included. Texts that
    are null, empty or white have fingerprint zero and are linked like any others. Rows that
    repeat a ``doc_id`` are judged by their own texts. Rows without ``doc_id`` come after all
    others: a group of such rows only has no component id. Other columns are not read.
    """
    found = stage(fingerprints(documents, settings), "fingerprints")
    classes = found.groupBy("f").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("d"))
    classes = stage(classes, "fingerprint-classes")
    links = stage(linked(classes, settings), "fingerprint-links")
    node = F.struct("d", "f")
    left = classes.select(F.col("f").alias("a"), node.alias("left"))
    right = classes.select(F.col("f").alias("b"), node.alias("right"))
    named = links.join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
    roots = components(named).select(F.col("node.f").alias("f"), F.col("root.d").alias("root"))
    groups = classes.join(roots, "f", "left").select("f", F.nullif(F.coalesce("root", "d"), F.lit(_NO_ID)).alias("component_id"))
    return found.join(groups, "f", "left").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet"))
