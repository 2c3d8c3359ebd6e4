"""Incremental ingestion of crawled call batches.

Arriving batch files are cleaned and appended as history, each micro-batch under its id. The
latest record of each event goes into a state table split by key bucket. The rows of the buckets that a
micro-batch touches are written to a fresh version folder; one small file, added to the
manifest at the end, makes them live at once. Of a bucket's live versions only the newest that are not
much larger are merged into a new one, so that a record is written again a few times, however many
batches follow. A run that dies in between leaves the old state as it was. Merging the same batch twice changes nothing, so a repeated batch after a
failure leaves the result exact.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.cleaning import clean_wikicfp
from eventloom.operators.quality import upsert
from eventloom.session import stage
from eventloom.sources.schemas import CALL

CLEANED = ["eventId", "acronym", "title", "locality", "seriesId", "startDate", "endDate", "url", "wikiCfpId", "source", "year"]
_FIELDS = ", ".join(f"{c} {'date' if c.endswith('Date') else 'int' if c in ('wikiCfpId', 'year') else 'string'}" for c in CLEANED)
#: ``rows`` is what the version holds at most in the bucket; it takes the place of the versions from ``since`` on.
_MANIFEST = "bucket int, number bigint, version string, rows bigint, since bigint"
#: A version is merged into the next one unless it has more than this many times its rows.
_LARGER = 2
_ARRIVAL = "struct<batch:bigint,modified:timestamp,number:bigint,path:string,block:bigint,position:bigint>"


def _arrival(batch_id: int) -> Column:
    """Order of records: micro-batch, then the file's time, number and name, then the place in it.

    Files of one micro-batch may be read in any order; their own data put them in order.
    """
    name = F.element_at(F.split("_file.file_path", "/"), -1)
    number = F.regexp_extract(F.col("_file.file_path"), r"[A-Za-z_](\d+)-\d+(?:/[^/]*)?$", 1).try_cast("bigint")
    return F.struct(
        F.lit(batch_id).cast("bigint").alias("batch"),
        F.col("_file.file_modification_time").alias("modified"),
        F.coalesce(number, F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")).alias("number"),
        F.col("_file.file_path").alias("path"),
        F.col("_file.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )


def ingest(spark: SparkSession, incoming: str, table: str, checkpoint: str, files_per_batch: int = 100, buckets: int = 64) -> int:
    """Take in all files not seen before; returns the number of micro-batches run.

    The streaming checkpoint remembers finished files. ``buckets`` must stay the same for a
    table; a bucket should be small enough to be written in one task.
    """
    files = spark.readStream.schema(CALL).option("maxFilesPerTrigger", files_per_batch).json(incoming)
    calls = files.select("*", F.col("_metadata").alias("_file"))
    done: set[int] = set()

    def merge(batch: DataFrame, batch_id: int) -> None:
        cleaned = clean_wikicfp(batch).select(*CLEANED, _arrival(batch_id).alias("arrival"))
        cleaned.write.mode("overwrite").parquet(f"{table}/history/batch={batch_id}")
        arrived = batch.sparkSession.read.schema(f"{_FIELDS}, arrival {_ARRIVAL}").parquet(f"{table}/history/batch={batch_id}")
        keyed = arrived.where("eventId IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("eventId"), F.lit(buckets)).cast("int"))
        new = stage(_latest(keyed), "arrived")
        counts = {row["bucket"]: row["count"] for row in new.groupBy("bucket").count().collect()}  # at most ``buckets``
        number, entries, paths = _plan(batch.sparkSession, table, counts)
        merged = new
        if paths:
            merged = new.unionByName(_state(batch.sparkSession, table, paths))
        version = f"{batch_id}-{uuid.uuid4().hex}"
        _latest(merged.repartition("bucket")).write.partitionBy("bucket").parquet(f"{table}/state/version={version}")
        _commit(batch.sparkSession, table, [(bucket, number, version, *entry) for bucket, entry in entries.items()])
        done.add(batch_id)

    query = calls.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return len(done)


def _latest(records: DataFrame) -> DataFrame:
    """The last record of each event."""
    others = [c for c in records.columns if c not in ("eventId", "bucket")]
    last = F.max_by(F.struct(*others), "arrival")
    return records.groupBy("eventId", "bucket").agg(last.alias("r")).select("eventId", *[f"r.{c}" for c in others], "bucket")


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """All cleaned records ever taken in, with their arrival order."""
    return spark.read.schema(f"{_FIELDS}, arrival {_ARRIVAL}").parquet(f"{table}/history").drop("batch")


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    """None if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _plan(spark: SparkSession, table: str, counts: dict[int, int]) -> tuple[int, dict[int, tuple[int, int]], list[str]]:
    """The next number, (rows, since) of each touched bucket's new version, and the folders that are merged into it."""
    live = versions(spark, table)
    rows = [] if live is None else live.collect()  # a few a bucket
    number = 1 + max((row["number"] for row in rows), default=0)
    entries = {bucket: (count, number) for bucket, count in counts.items()}
    paths = []
    stopped: set[int] = set()
    for row in reversed(rows):
        bucket = row["bucket"]
        if bucket not in entries or bucket in stopped:
            continue
        held, _ = entries[bucket]
        if row["rows"] > _LARGER * held:
            stopped.add(bucket)
            continue
        entries[bucket] = (held + row["rows"], row["number"])
        paths.append(_folder(table, row))
    return number, entries, paths


def _commit(spark: SparkSession, table: str, rows: list[tuple]) -> None:
    """Make a version a live one of its buckets, by one more file of the manifest."""
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{table}/manifest")


def versions(spark: SparkSession, table: str) -> DataFrame | None:
    """The live versions of each bucket, oldest first; what other versions hold may be deleted. None before the first."""
    manifest = _read(spark, _MANIFEST, f"{table}/manifest")
    if manifest is None:
        return None
    # a manifest written without them names one live version a bucket
    manifest = manifest.withColumns({"rows": F.coalesce("rows", F.lit(0)), "since": F.coalesce("since", F.lit(0))})
    later = W.partitionBy("bucket").orderBy("number").rowsBetween(1, W.unboundedFollowing)
    kept = manifest.withColumn("_since", F.min("since").over(later)).where("_since IS NULL OR _since > number")
    return kept.drop("_since").orderBy("bucket", "number")


def _folder(table: str, row: Row) -> str:
    return f"{table}/state/version={row['version']}/bucket={row['bucket']}"


def _state(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    schema = f"{_FIELDS}, arrival {_ARRIVAL}, version string, bucket int"
    return spark.read.schema(schema).option("basePath", f"{table}/state").parquet(*paths).drop("version")


def latest(spark: SparkSession, table: str) -> DataFrame | None:
    """The state: the latest cleaned record of each event with its arrival; None before the first."""
    live = versions(spark, table)
    rows = [] if live is None else live.collect()  # a few a bucket
    if not rows:
        return None
    state = _state(spark, table, [_folder(table, row) for row in rows])
    return state if len({row["bucket"] for row in rows}) == len(rows) else _latest(state)


def current_state(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """The table after all arrived records (history or state) were merged in by event id."""
    return upsert(existing, arrived.drop("bucket"), "eventId", "arrival")
