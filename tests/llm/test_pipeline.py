"""The corpus pipeline, stage by stage, against brute force."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_words_ops import brute_counts

import corpus_pipeline as P
from verifold.llm import mixing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage read and wrote."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, f in P.STAGES:
        done = f(spark, docs, sf_dir)
        done.write.parquet(str(base / name))
        out[name] = (docs, spark.read.parquet(str(base / name)))
        docs = out[name][1]
    return out


def shingles_of(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "token_output":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages):
    before, after = stages["quality_rules"]
    kept = set(ids(after))
    for r in before.collect():
        assert not (brute_counts(r.text)[5] and r.doc_id in kept)
    assert len(kept) >= 0.7 * before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    rows = [(r.doc_id, set(shingles_of(r.text))) for r in before.collect()]
    least = {i: i for i, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if len(a & b) >= 0.8 * len(a | b):
            i, j = find(i), find(j)
            least[max(i, j)] = min(i, j)
    assert ids(after) == sorted({find(i) for i, _ in rows}) and len(set(ids(after))) < len(rows)


def test_near_dedup_edge(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d e f g h"), (None, "a b"), (None, "z"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key_a", F.lit(1)).withColumn("kept_key_a", F.lit(2)).withColumn("Kept_Key_B", F.lit("x"))
    got = P.near_dedup(spark, df, "")
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == [("1", "a b"), ("1", "c d e f g h"), ("2", ""), ("None", "z")] and got.columns == df.columns


def test_decontamination(spark, stages, sf_dir):
    before, after = stages["benchmark_decontamination"]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in before.collect() if any(t in r.text for t in texts)}
    gone = set(ids(before)) - set(ids(after))
    assert bad <= gone and len(gone - bad) <= 0.02 * before.count()


def test_mixing(stages):
    before, after = stages["source_mixing"]
    assert ids(before) == ids(after)
    rows = after.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    want = mixing.mix(before).orderBy(*mixing.order()).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]


def test_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    before, after = stages["token_output"]
    at, want = 0, []
    for r in before.select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect():
        x = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert [tuple(r) for r in after.orderBy("start").collect()] == want


def test_columns_of_the_caller_stay(spark, tmp_path):
    df = spark.createDataFrame([(2, "a b"), (1, "c")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("file_of_row", "row_of_file", "file_number", "mix_rank", "source", "lang")})
    df.write.parquet(str(tmp_path / "d"))
    assert P.token_output(spark, spark.read.parquet(str(tmp_path / "d")), "").count() == 2
    assert P.source_mixing(spark, df.drop("mix_rank"), "").columns == df.drop("mix_rank").columns


def test_run(spark, stages, sf_dir):
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, stages["token_output"][1].collect()))


def test_empty(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0


def test_sql_of_registered_queries(spark, sf_dir):
    from verifold.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(r) for r in want)
