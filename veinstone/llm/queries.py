"""The operators as queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, html_text, jaccard, leaks, licenses, mixing, prefix_trie, quality, repeats, secrets, toolcalls, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_conversations(table(spark, sf_dir, "conversations"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    margins = [F.col(f"_{m}").alias(m) for m in mixing.MARGINS]
    shown = [F.round("_expected", 6).alias("expected"), F.round("_rate", 6).alias("probability"), F.col("_keep").alias("keep"), F.col("_copies").alias("copies")]
    return mixed.select("doc_id", *margins, F.col("_tokens").alias("tokens"), *shown)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_audio_features, op3_decontamination, op4_license_scan, op5_tool_calls, op6_jaccard_join, op7_source_mix, op8_url_filter, op9_main_text, op10_quality, op11_whitening, op12_prefix_trie, op13_suffix_dedup)}
ORACLE_SQL = {"op5_tool_calls": toolcalls.ORACLE_SQL, "op7_source_mix": mixing.oracle_sql(), "op8_url_filter": urls.oracle_sql(), "op12_prefix_trie": prefix_trie.ORACLE_SQL}
