"""Ratings, title checks and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import is_blank


def rate(records: DataFrame, columns: list[str], entity_type: str, id_column: str, years: tuple[int, int] | None = None) -> DataFrame:
    """One rating per record: the worst of its signature columns.

    Missing values hurt most, invalid ones less, anything else is fine. Invalid are blank
    texts, numbers below one, and years outside ``years`` if that is given.
    """
    types = dict(records.dtypes)

    def rule(at: int, name: str) -> Column:
        column = F.col(name)
        if name == "year" and years is not None:
            invalid = ~column.between(*years)
        elif types[name] == "string":
            invalid = F.trim(column) == ""
        elif types[name] in ("int", "bigint"):
            invalid = column < 1
        else:
            invalid = F.lit(False)

        def found(pain: int, reason: str) -> Column:
            return F.struct(
                F.lit(pain).alias("pain"), F.lit(-at).alias("at"), F.lit(reason).alias("reason"), F.lit(name).alias("hint")
            )

        return F.when(column.isNull(), found(7, "missing")).when(invalid, found(5, "invalid"))

    fine = F.struct(F.lit(0).alias("pain"), F.lit(0).alias("at"), F.lit("ok").alias("reason"), F.lit("").alias("hint"))
    # the greatest struct: most pain, then the first column in the list
    worst = F.array_max(F.array(fine, *[rule(at, name) for at, name in enumerate(columns)]))
    return records.select(
        worst.alias("r"), F.lit(entity_type).alias("entityType"), F.col(id_column).alias("entityId"), "source"
    ).select("r.pain", "r.reason", "r.hint", "entityType", "entityId", "source")


def title_check(records: DataFrame, kind: str) -> DataFrame:
    """Records of a kind without a title, with the reason."""
    reason = F.when(F.col("title").isNull(), "missing").otherwise("empty")
    return records.where((F.col("kind") == kind) & is_blank(F.col("title"))).withColumn("reason", reason)


def upsert(existing: DataFrame, updates: DataFrame, key: str, position: str, present: str | None = None) -> DataFrame:
    """Apply updates by primary key in order.

    A known record takes every column an update holds, nulls included; unknown keys are
    added; updates without a key are ignored. ``present`` names an array column with the
    columns each update holds; without it an update holds all columns it has. Updates are
    first reduced per key by map-side aggregates, so a key updated very often is harmless.
    """
    columns = [c for c in updates.columns if c not in (key, position, present)]

    def held(name: str) -> Column:
        return F.lit(True) if present is None else F.array_contains(present, name)

    latest = (
        updates.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(held(c), F.col(position))).alias(f"_new_{c}") for c in columns])
    )
    names = [c for c in existing.columns if c != key] + [c for c in columns if c not in existing.columns]

    def merged(name: str) -> Column:
        old = F.col(name) if name in existing.columns else F.lit(None)
        if name not in columns:
            return old.alias(name)
        new = F.col(f"_new_{name}")
        return F.when(new.isNotNull(), new["v"]).otherwise(old).alias(name)

    return existing.join(latest, key, "full_outer").select(key, *[merged(c) for c in names])


def first_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first record of every key."""
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.col(position))
    return df.groupBy(key).agg(first.alias("_r")).select(key, "_r.*")


def with_duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """All records with the number of records of their key; keys are counted before the join."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("duplicates"))
    return df.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
