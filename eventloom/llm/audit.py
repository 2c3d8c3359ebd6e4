"""How quality filters interact: every order of them, from wide packed counters.

Each document fails a set of filters, its mask. For every mask there is one big integer whose
fields of 64 bits hold the outcome of each step of each order. The integers of a part are
summed; a field counts rows, so 64 bits never overflow into the next one. At the end each
sum is unpacked into its fields.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import stage

#: Filters in the order of their bits; the one of repeated texts comes last.
FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
_STEPS = len(ORDERS) * len(FILTERS)
_OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_FIELD_BYTES = 8
_BYTES = _STEPS * len(_OUTCOMES) * _FIELD_BYTES
#: Bits of a row's key above those of the filters.
_GOOD, _TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Parts whose sums a task holds at once (24 KB each), and tasks' sums are merged in so many groups first.
_HELD, _SALTS = 256, 64
#: Stands for a missing id: such rows come after all others.
_NO_ID = (1 << 63) - 1

COUNTS = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@cache
def packed(key: int) -> int:
    """The integer of a key: its bits are the failed filters, a good and a toxic label."""
    out, field = 0, 0
    for order in ORDERS:
        gone = False
        for name in order:
            fails = bool(key >> FILTERS.index(name) & 1)
            removed = fails and not gone
            outcomes = (not fails and not gone, removed, fails and gone, removed and key & _GOOD, removed and key & _TOXIC)
            for outcome in outcomes:
                out |= bool(outcome) << (8 * _FIELD_BYTES * field)
                field += 1
            gone = gone or fails
    return out


def unpacked(total: int) -> np.ndarray:
    """Counts by step (in the order of ``ORDERS``) and outcome."""
    fields = np.frombuffer(total.to_bytes(_BYTES, "little"), "<u8")
    return fields.astype(np.int64).reshape(_STEPS, len(_OUTCOMES))


def failures(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` of the filters A to D, and ``digest`` of every row's text."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        words < 200,
        100 * distinct < 50 * words,
        100 * capitals > 3 * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _any(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def keys(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``key`` of every row of ``documents``."""
    rows = stage(failures(documents), "filter-failures")
    order = F.coalesce("doc_id", F.lit(_NO_ID))
    texts = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    repeated = stage(texts.where("rows > 1").select("digest", "first"), "repeated-texts")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(_any(F.col("quality") == 1).alias("good"), _any(F.col("toxic") == 1).alias("toxic"))
    copy = F.when(order > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    labelled = F.coalesce(F.col("good"), F.lit(0)) * _GOOD + F.coalesce(F.col("toxic"), F.lit(0)) * _TOXIC
    found = rows.join(repeated, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    return found.join(marks, "doc_id", "left").select("part", (F.col("mask") + labelled).alias("key"))


def _total(table: pa.Table) -> int:
    return sum(int.from_bytes(value.as_py(), "little") for value in table.column("total"))


def _bytes(total: int) -> pa.Array:
    return pa.array([total.to_bytes(_BYTES, "little")], pa.binary())


def sums(rows: DataFrame) -> DataFrame:
    """``part``, ``salt`` and ``total``: the sum of the rows' integers, one row a salt and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        salt = TaskContext.get().partitionId() % _SALTS

        def held() -> pa.RecordBatch:
            parts = list(totals)
            columns = [pa.array(parts, pa.string()), pa.array([salt] * len(parts), pa.int32()), pa.concat_arrays([_bytes(totals[p]) for p in parts])]
            totals.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "salt", "total"])

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            names = parts.dictionary.to_pylist()
            pairs = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 * _GOOD + batch.column("key").to_numpy(zero_copy_only=False)
            # equal integers are added at once, as a multiple
            for pair, count in zip(*(x.tolist() for x in np.unique(pairs, return_counts=True)), strict=True):
                name = names[pair // (4 * _GOOD)]
                totals[name] = totals.get(name, 0) + count * packed(pair % (4 * _GOOD))
                if len(totals) >= _HELD:
                    yield held()
        if totals:
            yield held()

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part")[:1], "salt": table.column("salt")[:1], "total": _bytes(_total(table))})

    schema = "part string, salt int, total binary"
    return rows.mapInArrow(run, schema).groupBy("part", "salt").applyInArrow(merge, schema)


def _rows(table: pa.Table) -> pa.Table:
    """All steps of all orders of one part."""
    counts = dict(zip(_OUTCOMES, unpacked(_total(table)).T, strict=True))
    own = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    removed = counts["removed"]
    # what the last filter of an order removes fails no other one
    last = np.arange(_STEPS) % len(FILTERS) == len(FILTERS) - 1
    unique = np.array([removed[last & (own == f)][0] for f in range(len(FILTERS))])
    shapley = np.array([removed[own == f].sum() for f in range(len(FILTERS))])
    return pa.table(
        {
            "part": pa.chunked_array([table.column("part")[:1].combine_chunks().take(pa.array(np.zeros(_STEPS, np.int64)))]),
            "filter_order": np.repeat(ORDERS, len(FILTERS)),
            "step": pa.array(np.arange(_STEPS) % len(FILTERS) + 1, pa.int32()),
            "kept": counts["kept"],
            "removed": removed,
            "redundant": counts["redundant"],
            "unique_fails": unique[own],
            "good_lost": counts["good_lost"],
            "toxic_lost": counts["toxic_lost"],
            "shapley": shapley[own],
        }
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every step of every order of the five filters, by language.

    A null text is empty; a null language is the part of the empty string. A document fails E if
    its text is that of any smaller ``doc_id``: of rows with the least id, none does, and rows without an
    id come after all others. A document is good or toxic if any of its labels says so; rows
    that repeat a ``doc_id`` have the same labels, rows without one have none. An empty table has
    no parts and so no rows. Other columns are not read.
    """
    found = sums(keys(documents, labels))
    return found.groupBy("part").applyInArrow(_rows, f"part string, filter_order string, step int, {COUNTS}")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(*(spark.read.parquet(f"{folder}/{table}.parquet") for table in ("documents", "labels")))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > first OR (w.doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END) AS fails
  FROM words w JOIN firsts f ON f.t = w.t LEFT JOIN marks m ON m.doc_id = w.doc_id
),
masks AS (SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
steps AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
outcomes AS (
  SELECT part, o, s, x, n, good, toxic, contains(fails, x) AS own, fails = x AS sole,
    translate(fails, before, '') <> fails AS gone
  FROM masks, steps
),
counted AS (
  SELECT part, o, s, x,
    coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT gone AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0) AS toxic_lost
  FROM outcomes GROUP BY part, o, s, x
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""
