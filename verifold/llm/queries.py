"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold.llm import decontamination, hard_negatives, katz, lexical_search, licenses, mixing, packing, quality, secrets, simhash, substring_dedup, token_files, urls
from verifold.llm.storage import shared_folder, write_settings


REPEATS_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i FROM win JOIN least USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), distance=4, shingle=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("row_key")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)) == 2
    scored, _ = katz.score(docs.select("doc_id", "text", (~held_out).alias("train")), order=2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("row_key")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/verifold/{uuid.uuid4().hex}/tokens"
    with write_settings(spark):
        token_files.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_ids(spark, path)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), width=50, period=31)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(e.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_license_scans": op5_license_scans,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_token_output": op7_token_output,
        "op8_url_filters": op8_url_filters,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_source_mixing": op10_source_mixing,
        "op11_lexical_search": op11_lexical_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": urls.oracle_sql(), "op9_substring_dedup": REPEATS_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
