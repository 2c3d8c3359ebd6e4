"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, lines, mixing, near_duplicates, quality
from eventloom.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the forest rejects."""
    statistics = stage(quality.rule_statistics(docs), "rule-statistics")
    model = quality.fit(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(quality.rule_statistics(docs, carry=COLUMNS, forest=model.forest), model, COLUMNS)
    return judged.where(F.col("kept")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; ``n_chars`` follows the text."""
    kept = lines.drop_repeated(docs, carry=COLUMNS)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least ``doc_id``.

    Repeated and missing ids are told apart by their texts, see ``near_duplicates.first_copies``;
    documents without words all stay.
    """
    return near_duplicates.first_copies(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated or left out as the mixture's budgets say; rows without ``doc_id`` by their texts."""
    return mixing.mixed_documents(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and a digest of the text that they decode to; a null text is empty."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    keys = ("doc_id", "lang", "source")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keys=keys)
    decoded = bpe.decode(encoded, path, keys=keys, carry=("token_ids",))
    return decoded.select(*keys, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))
