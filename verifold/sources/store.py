"""The document store: one JSON document a file below <case>/<type>/, and its sinks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold.functions.text import sanitize_path, text

#: Suffixes with a known type.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a new local folder if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scan_document_store(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """case_id, doc_type, file_name, path and raw JSON text of each stored document, below <case>/<type>/."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)$", i)
    return files.select(part(1).alias("case_id"), part(2).alias("doc_type"), part(3).alias("file_name"), path.alias("path"), F.col("value").alias("raw"))


def classify_read(df: DataFrame) -> DataFrame:
    """Adds data (VARIANT object or null) and read_error: invalid_json, data_not_dict or null.

    Null data is an empty object. Needs column raw.
    """
    whole = F.try_parse_json("raw")
    is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    staged = df.withColumn("whole", whole).withColumn("inner", F.try_variant_get("whole", "$.data", "variant"))
    bad = F.col("whole").isNull() | ~is_object(F.col("whole"))
    empty = F.col("inner").isNull() | (F.schema_of_variant("inner") == "VOID")
    error = F.when(bad, F.lit("invalid_json")).when(~empty & ~is_object(F.col("inner")), F.lit("data_not_dict"))
    return staged.withColumn("read_error", error).withColumn(
        "data", F.when(F.col("read_error").isNotNull(), F.lit(None)).when(empty, F.parse_json(F.lit("{}"))).otherwise(F.col("inner"))).drop("whole", "inner")


def mime_type(path: Column) -> Column:
    suffix, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(suffix == k, F.lit(v)).otherwise(out)
    return out


def document_envelope(df: DataFrame, now: Column) -> DataFrame:
    """Adds text_len, mime_type, raw_b64_len, created_at and parse_error. Needs text, file_name, raw_len; now is given."""
    return df.withColumns({
        "text_len": F.length(text("text")),
        "mime_type": mime_type(F.col("file_name")),
        "raw_b64_len": (4 * F.ceil(F.col("raw_len") / 3)).cast("long"),
        "created_at": now,
        "parse_error": parse_outcome("text"),
    })


def parse_outcome(c: str, data: Column | None = None) -> Column:
    """Error struct for a document without text (ExtractorError) or, with ``data``, one whose fields are all null (ParserError); else null.

    A bad document never stops the others: extraction gives nulls where it can't read.
    """
    error = lambda kind, message: F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"))
    out = F.when(F.trim(text(c)) == "", error("ExtractorError", "no text"))
    return out if data is None else out.when(F.to_json(data) == "{}", error("ParserError", "no field found"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, mime_type, n_bytes and encoded length of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select("path", mime_type(F.col("path")).alias("mime_type"), F.col("length").alias("n_bytes"), (4 * F.ceil(F.col("length") / 3)).cast("long").alias("raw_b64_len"))


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file: file_name, text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def append_documents(df: DataFrame, path: str, by: str = "doc_type") -> None:
    """Append documents, partitioned by type or another column; nothing is ever updated."""
    df.write.mode("append").partitionBy(by).parquet(path)


#: Session settings while a VARIANT store is written: frequent fields become Parquet columns of their own.
SHREDDING = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


def append_variants(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append classified documents (``data`` is VARIANT) to a Parquet store, by type and with their fields shredded: readers of single fields skip the rest."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SHREDDING}
    for k, v in SHREDDING.items():
        conf.set(k, v)
    try:
        df.write.mode(mode).partitionBy("doc_type").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


# A tree of single files: listed first, and only what is needed is opened


def list_documents(spark: SparkSession, root: str, doc_type: str | None = None, pattern: str = "*.json") -> DataFrame:
    """case_id, doc_type, file_name, path, n_bytes of the files below <case>/<type>/; of one type, only its folders are listed. No file is opened."""
    # The column content is not asked for, so this source reads metadata alone.
    files = spark.read.format("binaryFile").load(f"{root}/*/{doc_type or '*'}/{pattern}").select("path", "length")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    return files.select(part(1).alias("case_id"), part(2).alias("doc_type"), part(3).alias("file_name"), "path", F.col("length").alias("n_bytes"))


def newest_documents(listed: DataFrame) -> DataFrame:
    """The file with the greatest name of each case and type, and n_docs, how many there are."""
    best = listed.groupBy("case_id", "doc_type").agg(F.max_by(F.struct("file_name", "path", "n_bytes"), "file_name").alias("x"), F.count("*").alias("n_docs"))
    return best.select("case_id", "doc_type", "x.*", "n_docs")


def read_listed(listed: DataFrame) -> DataFrame:
    """Adds raw, the contents of listed files; no other file is opened. Their paths come to the driver, so give a bounded number."""
    spark = listed.sparkSession
    kept = listed.toArrow()
    rows = spark.createDataFrame(kept, listed.schema)
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in kept.column("path").to_pylist()]
    if not paths:
        return rows.withColumn("raw", F.lit(None).cast("string"))
    texts = spark.read.text(paths, wholetext=True).select("_metadata.file_path", F.col("value").alias("raw"))
    name = F.regexp_extract(F.url_decode(F.regexp_replace("file_path", r"\+", "%2B")), r"([^/]+/[^/]+/[^/]+)$", 1)
    own = F.concat_ws("/", "case_id", "doc_type", "file_name")
    return texts.join(F.broadcast(rows), name == own).select(*rows.columns, "raw")


def ingest_newest(spark: SparkSession, root: str, path: str, doc_type: str | None = None, pattern: str = "*.json", batch_files: int = 10_000) -> DataFrame:
    """Read the newest file of each case and type below ``root`` into a VARIANT store at ``path``; older files are counted, not opened.

    The listing is written first, and files are read in batches of about ``batch_files``, each into a folder of its
    own, so that a job that is run again goes on with the same files and writes over what was not complete.
    """
    listing = f"{path}/_listing"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{listing}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        newest_documents(list_documents(spark, root, doc_type, pattern)).write.mode("overwrite").parquet(listing)
    listed = spark.read.parquet(listing)
    batches = max(1, -(-listed.count() // batch_files))
    for b in range(batches):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows = read_listed(listed.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == b))
            append_variants(classify_read(rows).drop("raw"), f"{path}/batch={b}", "overwrite")
    return spark.read.parquet(path).drop("batch")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")


def write_reports(df: DataFrame, path: str, buckets: int = 256) -> None:
    """One report a case as JSON, in a partition by hash of the case; touched partitions must be whole.

    A directory for each case doesn't hold at scale, so cases are dealt to ``buckets``, a number to
    choose by the cases there will be and to keep; each bucket is written by one task as one file.
    """
    placed = df.withColumn("bucket", bucket_of(buckets)).repartition("bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def load_report_inputs(reports: DataFrame, store: DataFrame) -> DataFrame:
    """Stored documents that reports point at: case_id, doc_type, path, data. inputs: map of type to path."""
    wanted = reports.select("case_id", F.explode("inputs").alias("doc_type", "path"))
    return wanted.join(store.withColumn("path", sanitize_path("path")).select("path", "data"), "path").select("case_id", "doc_type", "path", "data")
