"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import audit, bpe, language_id, language_model, lines, mixing, near_duplicates, neighbours, phrases, quality, simhash, suffixes, whitening
from eventloom.session import stage


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    model = language_model.train(documents.where(language_model.remainder(7) != 2), order=3)
    return language_model.score(documents, model, ["doc_id", (language_model.remainder(7) == 2).alias("held_out")])


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(_read(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    encoded = bpe.encode(documents, path, pattern)
    digested = encoded.select(
        "doc_id",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    decoded = bpe.decode(digested, path, carry=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(_read(spark, folder, "documents"), *tokenizer())


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    held_out = language_model.remainder(4) == 2
    model = language_id.train(documents.where(~held_out))
    return language_id.predict(documents, model, ["doc_id", held_out.alias("held_out")])


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    statistics = stage(quality.rule_statistics(_read(spark, folder, "documents")), "rule-statistics")
    model = quality.fit(statistics, _read(spark, folder, "labels"))
    return quality.judge(statistics, model, ("doc_id",)).select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_substring_dedup": phrases.op2_substring_dedup,
    "op3_language_model": op3_language_model,
    "op4_near_dedup": op4_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_simhash_dedup": simhash.op11_simhash_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffixes.OP1_SQL,
    "op2_substring_dedup": phrases.OP2_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op10_mix_sources": mixing.oracle(),
    "op13_filter_audit": audit.OP13_SQL,
}
