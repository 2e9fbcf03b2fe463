"""The opN_ queries: each applies one operator, with production parameters, to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filter_audit, licenses, media_columns, mixing, ngram_join, packing, periodic, quality, secret_scan, sharding, warc
from .common import materialize, read, spread, word_count

SHARDS = 24


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mixing.taken_words(sized, mixing.Mix())


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(read(spark, sf_dir, "pages"))


def op3_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    sized = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    out = sharding.shard_by_bytes(materialize(sized, "sized"), ["doc_id", "text_crc32"], "size", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spread(read(spark, sf_dir, "documents")))


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write(packing.pack(spread(read(spark, sf_dir, "documents"))))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(read(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(spread(read(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return periodic.digests(periodic.find_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(spread(read(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_shard_bytes": op3_shard_bytes,
    "op4_decontaminate": op4_decontaminate,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_pack_tokens": op6_pack_tokens,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_media_columns": op12_media_columns,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": pipeline,
}
