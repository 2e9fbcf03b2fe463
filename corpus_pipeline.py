"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as Parquet into the shared
folder and reads them back as the next one's documents. All but the last return the columns of documents; other columns are
dropped. In every stage a row is a document of its own, judged by its own text whatever its doc_id: rows that share a number, or have
none, never speak for each other. A null text counts as empty, and empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm import decontam, mixing, ngram_join, quality, sharding
from speechlake.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the base test or a certified rule of their language rejects go."""
    return quality.keep(docs.select(*COLUMNS), read(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each class of linked documents the one with the smallest doc_id (null last) stays; texts without words all stay."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: contaminated documents go."""
    return decontam.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row per document, pass and run of blocks that the mix takes of it; a row's text is whole, or a run's words.
    Texts without words are in no block, and so in no row."""
    return mixing.mixed_documents(docs.select(*COLUMNS), mixing.Mix()).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every row, with shard and slot, in contiguous shards of near-equal bytes; equal rows are interchangeable."""
    d = docs.select(*COLUMNS, sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    return sharding.shard_by_bytes(d, ["doc_id", "text_crc32"], "size", SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The mixing stage draws from hashes that SQL doesn't have; its stages are tested against plain versions instead.
ORACLE_SQL: str | None = None
