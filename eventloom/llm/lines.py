"""Line dedup over levelled sorted runs of line hashes.

The lines of a batch of documents become one sorted run of hashes with the number of
documents and the largest document that hold each. A new batch is anti-joined against the
runs: lines that no earlier batch had enter with the batch's own numbers, known ones with those of
the runs added. The batch becomes a run of its own; when a level is full, its runs are merged into
one run of the next level. Column expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import literal_rows, stage, staging_path, write_freeing

KEY = ["h1", "h2"]
_RUN = "h1 long, h2 long, docs long, max_doc long"
_MANIFEST = "batches int, level int, place int, path string"
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.btrim(F.translate(line, _UPPER, _LOWER), F.lit(_SPACE))


def split_lines(text: Column) -> Column:
    """All lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(documents: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """Every line whose key has at least ``min_chars`` code points, by 128 bits of hash.

    ``copy`` tells rows with the same ``doc_id`` but other text apart. All rows of a document
    are in one batch.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("copy"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return (
        rows.withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select(
            "doc_id",
            "copy",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), F.col("key")).alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        )
    )


class LineRuns:
    """The runs, by level. Every run is a written table sorted by hash, with at most one row a hash.

    A row has the number of documents and the largest document that hold the line in all batches up to
    its own, so that the newest row of a hash is its verdict. A manifest below ``folder`` names the runs
    after each batch; ``LineRuns.open`` goes on from the last one.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3):
        self.spark = spark
        self.folder = folder or staging_path(spark, "line-runs")
        self.fanout = fanout
        self.batches = 0
        self.levels: list[list[str]] = [[]]

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = 3) -> LineRuns:
        """The runs that the last finished batch left in ``folder``."""
        out = cls(spark, folder, fanout)
        written = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
        last = written.agg(F.max("batches")).first()[0]
        out.batches = last
        # one row a run: at most fanout a level
        for row in written.where(F.col("batches") == last).orderBy("level", "place").collect():
            while len(out.levels) <= row["level"]:
                out.levels.append([])
            out.levels[row["level"]].append(row["path"])
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def rows(self) -> DataFrame | None:
        """All rows of all runs; None before the first batch."""
        paths = [path for level in self.levels for path in level]
        return self._read(paths) if paths else None

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``long_lines``; its documents must not be in an earlier batch."""
        own = (
            lines.select(*KEY, "doc_id")
            .distinct()
            .groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("max_doc"))
        )
        seen = self.totals()
        if seen is not None:
            own = stage(own, "line-batch")
            seen = stage(seen.join(own.select(*KEY), KEY, "left_semi"), "line-known")
            fresh = own.join(seen, KEY, "left_anti")
            before = seen.withColumnsRenamed({"docs": "docs_before", "max_doc": "max_before"})
            known = own.join(before, KEY).select(
                *KEY, (F.col("docs") + F.col("docs_before")).alias("docs"), F.greatest("max_doc", "max_before").alias("max_doc")
            )
            own = fresh.unionByName(known)
        self._put(0, own)
        self.batches += 1
        rows = [(self.batches, level, place, path) for level, paths in enumerate(self.levels) for place, path in enumerate(paths)]
        literal_rows(self.spark, _MANIFEST, rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        path = f"{self.folder}/run-{self.batches}-{level}-{uuid.uuid4().hex}"
        write_freeing(rows.select(*KEY, "docs", "max_doc").repartitionByRange(*KEY).sortWithinPartitions(*KEY), path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, newest(self._read(full)))

    def totals(self) -> DataFrame | None:
        """The newest row of each hash over all runs."""
        rows = self.rows()
        return None if rows is None else newest(rows)


def newest(runs: DataFrame) -> DataFrame:
    """Documents and the largest one only grow from batch to batch."""
    return runs.groupBy(*KEY).agg(F.max("docs").alias("docs"), F.max("max_doc").alias("max_doc"))


def repeated_positions(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """``doc_id``, ``copy`` and the sorted positions (from 0) of the lines that a document loses.

    A line goes if at least ``min_docs`` documents hold its key and one of them has a larger
    ``doc_id``. Rows without ``doc_id`` are one document, smaller than all others; rows that
    repeat a ``doc_id`` are one document. Documents that lose nothing have no row.

    The documents are added to ``runs`` in ``batches``, by hash of their ids. Runs of earlier calls
    count too: only the runs and the new documents are read, and only the new documents are judged.
    An id of an earlier call must not come again.
    """
    lines = stage(long_lines(documents, min_chars, batches), "long-lines")
    runs = runs or LineRuns(documents.sparkSession)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    often = runs.totals().where((F.col("docs") >= min_docs) & F.col("max_doc").isNotNull()).select(*KEY, "max_doc")
    lost = lines.join(often, KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("max_doc")))
    return lost.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def drop_repeated(documents: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Every row of ``documents`` with its kept text, ``n_lines`` and ``n_dropped``.

    Columns: ``doc_id``, ``carry``, ``text`` (kept lines, joined by a line break), and the two
    counts. Options as of ``repeated_positions``.
    """
    others = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "text")]
    lost = repeated_positions(documents, **options).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), "lost")
    rows = documents.select("doc_id", *others, split_lines(F.col("text")).alias("__lines"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__row"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__copy")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get("__lines", i)))
    return joined.select(
        "doc_id",
        *others,
        F.concat_ws("\n", kept).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digests(documents: DataFrame) -> DataFrame:
    kept = drop_repeated(documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digests(spark.read.parquet(f"{folder}/documents.parquet"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\x0c\r') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
often AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (SELECT l.doc_id, i, line, max_doc IS NOT NULL AND l.doc_id < max_doc AS gone FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
