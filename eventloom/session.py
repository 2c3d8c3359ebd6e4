"""Session helpers: a local session for tests, and the shared staging folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_staging: str | None = None


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.sql.files.openCostInBytes", "512k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Workers import the functions of a plan by name, wherever they were started.
    """
    context = spark.sparkContext
    if getattr(context, "_eventloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="eventloom-"), "eventloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("eventloom", os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._eventloom_shipped = True


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    global _local_staging
    if _local_staging is None or not os.path.isdir(_local_staging):
        _local_staging = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, _local_staging, ignore_errors=True)
    return _local_staging


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging folder."""
    return f"{staging_root(spark)}/eventloom/{name}-{uuid.uuid4().hex}"


def write_freeing(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``df`` as Parquet, by the session's codec if none is given; Spark lets go of its shuffle files when the write has ended."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Cuts the lineage, pins rows that depend on their partition, survives the loss of
    executors, and gives the planner exact file sizes for its broadcast decision.
    """
    path = staging_path(df.sparkSession, name)
    write_freeing(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for each task of :func:`spread`.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` to as many tasks as the input files call for, so that the share of a
    task stays the same however large they are. The groupings and joins by these keys that follow need no exchange.

    Without input files (rows made in the session) the session's number of tasks is used.
    """
    paths = df.inputFiles()
    if not paths:
        return df.repartition(*keys)
    size = df.sparkSession.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0]
    return df.repartition(1 + int(size) // TASK_BYTES, *keys)


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of fixed values as an inlined relation, without a Python-side job."""
    text = ", ".join(f"`{field.split()[0]}`" for field in schema.split(","))
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    casts = [F.col(f"`{f.split()[0]}`").cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(",")]
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({text})").select(*casts)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def is_blank(column: Column) -> Column:
    """True for null or empty text."""
    return column.isNull() | (column == "")
