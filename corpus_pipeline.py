"""Corpus pipeline: quality rules, near dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns documents;
the last returns a row for each document of the token files. The order of the mix is the row order
of the table that the fourth stage writes, and the fifth writes ids in that order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold.llm import decontamination, jaccard, mixing, quality, token_files
from verifold.llm.storage import shared_folder, write_settings

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): the one with the smallest doc_id."""
    return jaccard.keep_first(docs, similarity=0.8, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in rows ordered by the mix of their sources."""
    return mixing.mix_in_order(docs).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in row order, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/verifold/{uuid.uuid4().hex}/tokens"
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    try:
        placed = docs.select("doc_id", "text", number.alias("file_number"), F.col("_metadata.file_name").alias("file_of_row"), F.col("_metadata.row_index").alias("row_of_file"))
    except AnalysisException as e:
        raise ValueError("row order is that of files: give documents read from the table that the mix was written to") from e
    order = (F.col("file_number"), F.col("file_of_row"), F.col("row_of_file"))
    with write_settings(spark):
        token_files.write_ids(placed, path, public_tokenizers.path(TOKENIZER), order)
    return token_files.read_ids(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: Estimates, fingerprints and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/verifold/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        with write_settings(spark):
            done.write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{i}_{name}")
    return docs
