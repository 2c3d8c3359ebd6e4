"""Repeated phrases by sharded Aho-Corasick automata over words.

A phrase is ``WIDTH`` consecutive words. Phrases that recur are confirmed by their hashes;
the patterns of a shard, with their first places, become one automaton, and the texts of the
shard stream through its copies, which find every occurrence. A shard takes the anchors
(``blocks``) of one hash range. Where an anchor has many patterns, the shard is divided by the
hashes of the phrases: each bucket has a bounded number of patterns, and a text goes to the
buckets of its own phrases only. Where a bucket has many texts, they are dealt out to several tasks,
each with the patterns of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import blocks
from eventloom.llm.arrays import Prefixes, Slice, find_words, slices, word_hashes
from eventloom.session import stage

WIDTH = 20
SHAPE = blocks.Shape(WIDTH, 6)
#: Texts of blocks, and patterns, for each task.
SHARD_BLOCKS = 6000


def _symbols(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(part)
    return word_hashes(part, words, lower=False), words.rows


def _cut(text: bytes, lo: np.ndarray, size: np.ndarray) -> list[list[str]]:
    words = text.split()  # at 0x20 and 0x09-0x0D, as the windows' words
    return [[w.decode() for w in words[a : a + n - 1 + WIDTH]] for a, n in zip(lo.tolist(), size.tolist(), strict=True)]


def _window_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the block, and hash of every window of a batch of blocks."""
    content = batch.column("content")
    counts = content.value_lengths().to_numpy()
    words = content.flatten()
    hashes = [word_hashes(p, _whole(p), lower=False) for p in slices(words)]
    prefixes = Prefixes(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
    size = batch.column("size").to_numpy()
    rows = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    at = begins[rows] + step
    return rows, step, prefixes.of(at, at + WIDTH)


def _windows(texts: DataFrame) -> DataFrame:
    """The hash and place of every window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, step, hashes = _window_hashes(batch)
            columns = [batch.column(n).take(pa.array(rows)) for n in ("h", "doc_id", "copy", "lo")]
            values = [pa.array(hashes.view(np.int64)), pa.array(step.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *values], names=["h", "doc_id", "copy", "lo", "w", "step"])

    return texts.select("h", "doc_id", "copy", "lo", "size", "content").mapInArrow(run, "h long, doc_id long, copy long, lo int, w long, step int")


def _in_buckets(texts: DataFrame) -> DataFrame:
    """Blocks of divided shards, once for each bucket that one of their windows belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1024):
                batch = whole.slice(first, 1024)
                rows, _, hashes = _window_hashes(batch)
                bucket = np.mod(hashes.view(np.int64), batch.column("buckets").to_numpy().astype(np.int64)[rows])
                rows, bucket = np.unique(np.stack([rows, bucket]), axis=1)
                columns = [batch.column(n).take(pa.array(rows)) for n in ("shard", "doc_id", "copy", "lo", "content")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket.astype(np.int64))], names=["shard", "doc_id", "copy", "lo", "content", "bucket"])

    rows = texts.select("shard", "buckets", "doc_id", "copy", "lo", "size", "content")
    return rows.mapInArrow(run, "shard long, doc_id long, copy long, lo int, content array<string>, bucket long")


def _whole(part: Slice):
    """Every row of the slice is one word."""
    from eventloom.llm.arrays import Words

    return Words(part.bounds[:-1], part.bounds[1:], np.arange(part.rows + 1))


def confirmed(texts: DataFrame) -> DataFrame:
    """Patterns: phrases of two blocks or more, with their hash, words and first place."""
    first = F.min(F.struct("doc_id", "copy", (F.col("lo") + F.col("step")).alias("start"), "lo"))
    often = _windows(texts).groupBy("h", "w").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    source = texts.select("h", F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("lo").alias("l"), "content").dropDuplicates(["h", "d", "c", "l"])
    same = (F.col("first.doc_id").eqNullSafe(F.col("d"))) & (F.col("first.copy") == F.col("c")) & (F.col("first.lo") == F.col("l"))
    joined = often.withColumnRenamed("h", "k").join(source, (F.col("k") == F.col("h")) & same)
    words = F.slice("content", F.col("first.start") - F.col("l") + 1, F.lit(WIDTH))
    return joined.select("h", "w", words.alias("words"), F.col("first.doc_id").alias("doc_id"), F.col("first.copy").alias("copy"), F.col("first.start").alias("start"))


def _later_occurrences(patterns: pa.Table, texts: pa.Table) -> pa.Table:
    """Occurrences in the texts that are not a pattern's first place."""
    names: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    places = zip(patterns.column("doc_id").to_pylist(), patterns.column("copy").to_pylist(), patterns.column("start").to_pylist(), strict=True)
    for words, where in zip(patterns.column("words").to_pylist(), places, strict=True):
        automaton.add_word(tuple([names.setdefault(w, len(names) + 1) for w in words]), where)
    doc, copy, lo = [], [], []
    if len(patterns):
        automaton.make_automaton()
        for row_doc, row_copy, row_lo, words in zip(*[texts.column(n).to_pylist() for n in ("doc_id", "copy", "lo", "content")], strict=True):
            known = names.get
            for end, where in automaton.iter(tuple([known(w, 0) for w in words])):
                start = row_lo + end + 1 - WIDTH
                if where != (row_doc, row_copy, start):
                    doc.append(row_doc)
                    copy.append(row_copy)
                    lo.append(start)
    return pa.table([pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(lo, pa.int32())], names=["doc_id", "copy", "lo"])


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every occurrence of a pattern in the texts but its first: ``doc_id``, ``copy``, ``lo``."""
    shards = 1 + max(texts.count(), patterns.count()) // SHARD_BLOCKS
    shard = F.pmod("h", F.lit(shards)).cast("long")
    many = F.expr(f"1 + n div {2 * SHARD_BLOCKS}").cast("long")
    sizes = patterns.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.select("shard", many.alias("buckets")), "shard-patterns")
    own = texts.withColumn("shard", shard).join(sizes, "shard")
    names = ("shard", "bucket", "doc_id", "copy", "lo", "content")
    whole = own.where("buckets = 1").withColumn("bucket", F.lit(0).cast("long")).select(*names)
    divided = stage(_in_buckets(own.where("buckets > 1")).select(*names), "divided-blocks")
    blocks_of = whole.unionByName(divided)
    loads = blocks_of.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    loads = stage(loads.select("shard", "bucket", many.alias("copies")), "shard-loads")
    dealt = blocks_of.join(loads, ["shard", "bucket"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "lo"), F.col("copies")))
    copied = patterns.withColumn("shard", shard).join(sizes, "shard").withColumn("bucket", F.pmod("w", "buckets"))
    copied = copied.join(loads, ["shard", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = copied.select("shard", "bucket", "part", "words", "doc_id", "copy", "start").groupBy("shard", "bucket", "part")
    right = dealt.select(*names, "part").groupBy("shard", "bucket", "part")
    return left.cogroup(right).applyInArrow(_later_occurrences, "doc_id long, copy long, lo int")


def repeated_phrases(documents: DataFrame) -> DataFrame:
    """Windows (``doc_id``, ``copy``, ``lo``, ``size``) whose words also start earlier."""
    found = blocks.candidates(blocks.block_table(documents, _symbols, SHAPE))
    again = blocks.repeats_of(found).where(~blocks.place().eqNullSafe(F.col("rep"))).select("doc_id", "copy", "lo", "size")
    texts = stage(blocks.with_texts(found.mixed, documents, _cut, "array<string>"), "block-words")
    patterns = stage(confirmed(texts), "patterns")
    later = occurrences(texts, patterns).withColumn("size", F.lit(1))
    return again.unionByName(later)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by one space).

    A word goes if a window of ``WIDTH`` words that covers it has its words earlier too: in a
    document with a smaller ``doc_id`` or further ahead in the same one, judged on the input.
    Rows without ``doc_id`` come before all others. Rows that repeat a ``doc_id`` with another
    text are told apart by a hash of the text; where both are equal, they are one document at
    one place. A null text has no words.
    """
    rows = blocks.with_ranges(documents, stage(repeated_phrases(documents), "phrase-ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                kept, sizes, lost = [], [], []
                for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("ranges"), strict=True):
                    words = (text.as_py() or b"").split()
                    gone = blocks.covered(ranges.values if ranges.is_valid else None, WIDTH, len(words))
                    kept.append(b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out]))
                    sizes.append(len(words))
                    lost.append(int(gone.sum()))
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def phrase_digests(documents: DataFrame) -> DataFrame:
    return without_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_digests(spark.read.parquet(f"{folder}/documents.parquet"))


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s : s + 19], ' ')) AS k FROM docs, LATERAL (SELECT unnest(range(1, len(words) - 18)) AS s)
),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM windows),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE nth > 1)
),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
