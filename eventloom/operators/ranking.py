"""Numbering and running sums over a whole table without one big window.

Rows are range-partitioned by the full order, numbered inside their partition, and
written to the staging folder, which pins the partition borders. One small row per
partition then gives the offsets. No task ever holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import stage

_POSITION_BITS = (1 << 33) - 1


def global_running(df: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """Add ``rowNumber`` and, with a weight, ``before`` and ``total`` of the weight.

    ``order`` has to be a total order; end it with a unique column, so that equal leading
    values spread over several ranges.
    """
    weighted = df.withColumn("_weight", weight if weight is not None else F.lit(1).cast("bigint"))
    ranged = weighted.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(
        ranged.withColumns(
            {
                "_part": F.spark_partition_id(),
                "_position": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)),
            }
        ),
        "ranked",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_weight").alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one row per range partition: never more than the number of shuffle partitions
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rowsBefore"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sumBefore"),
        F.sum("_sum").over(everything).alias("total"),
    )
    joined = placed.join(F.broadcast(offsets), "_part").withColumn(
        "rowNumber", F.col("_rowsBefore") + F.col("_position") + 1
    )
    technical = ["_part", "_position", "_weight", "_rowsBefore", "_sumBefore"]
    if weight is None:
        return joined.drop(*technical, "total")
    inside = W.partitionBy("_part").orderBy("_position").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_sumBefore") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    return joined.withColumn("before", before).drop(*technical)


def coverage_cut(df: DataFrame, column: str, percent: float, limit: int | None = None) -> DataFrame:
    """Most frequent values until their share exceeds ``percent``, the crossing one included."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    running = global_running(counts, [F.desc("n"), F.asc(column)], F.col("n"))
    covered = running.where(F.col("before") * 100.0 <= F.lit(percent) * F.col("total"))
    if limit is not None:
        covered = covered.where(F.col("rowNumber") <= limit)
    share = F.round((F.col("before") + F.col("n")) * 100.0 / F.col("total"), 6)
    return covered.select("rowNumber", column, "n", share.alias("coveredPercent"))


def sample_per_kind(
    df: DataFrame, kind: str, key: str, n: int, prefixed_kinds: list[str], plain_kinds: list[str], prefix: str
) -> DataFrame:
    """The first ``n`` records of each listed kind; prefixed kinds only with a fitting key.

    Spark limits every map task to ``n`` rows per kind before the shuffle.
    """
    wanted = F.col(kind).isin(plain_kinds) | (F.col(kind).isin(prefixed_kinds) & F.col(key).startswith(prefix))
    number = F.row_number().over(W.partitionBy(kind).orderBy(key))
    return df.where(wanted).withColumn("number", number).where(F.col("number") <= n)
