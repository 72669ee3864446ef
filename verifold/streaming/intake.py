"""New documents arrive; only the cases they touch are evaluated again. The result equals a batch run.

Two streaming queries read the same files. One appends documents to the store, each once. The other
keeps, as state by case, the latest document of each type; in update mode a micro-batch gives back
just the cases it touched, with all that rules need, so neither the store nor the other cases are read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verifold.plans.rules import TYPES, public_type
from verifold.sources.generations import publish
from verifold.sources.store import bucket_of

KEY = ["case_id", "doc_type", "file_name"]
#: State goes to disk, since it grows with the number of cases.
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Intake(NamedTuple):
    """The running queries."""

    append: StreamingQuery
    refresh: StreamingQuery

    def awaitTermination(self) -> None:
        for q in self:
            q.awaitTermination()


def touched_cases(arriving: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """One row for each case with its latest document of each type and its distinct files: a streaming aggregation, whose state is one document a type.

    Of files of one name the one that arrived first counts. Needs case_id, doc_type, file_name and more
    columns; documents of other types are left out.
    """
    rest = [c for c in arriving.columns if c not in ("case_id", "doc_type")]
    rows = arriving.withColumn("doc_type", public_type(F.col("doc_type"))).where(F.col("doc_type").isin(*types))
    rows = rows.withColumn("arrived", F.unix_micros(F.current_timestamp()))  # one moment a batch, the same when it runs again
    order = F.struct("file_name", -F.col("arrived"), F.xxhash64(*rest))
    latest = [F.max_by(F.struct(*rest), F.when(F.col("doc_type") == t, order)).alias(t) for t in types]
    return rows.groupBy("case_id").agg(*latest, F.collect_set(F.struct("doc_type", "file_name")).alias("files"))


def documents_of(touched: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """The latest documents of touched cases as rows of a store, and n_docs, the files of that type so far."""
    n = lambda t: F.size(F.filter("files", lambda f: f["doc_type"] == t)).cast("long")
    each = F.array(*(F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("doc_type"), F.col(t).alias("x"), n(t).alias("n_docs"))) for t in types))
    rows = touched.select("case_id", F.explode(F.filter(each, lambda d: d.isNotNull())).alias("d"))
    return rows.select("case_id", "d.doc_type", "d.x.*", "d.n_docs")


def stream_intake(spark: SparkSession, incoming: str, schema: str, store: str, reports: str, evaluate: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = 256, files_per_batch: int | None = None, types: tuple[str, ...] = TYPES) -> Intake:
    """Start the queries that append the files of ``incoming`` to ``store`` and refresh ``reports``.

    evaluate: rows of a store (case_id, doc_type, file_name, ..., n_docs), the latest of each type of the
    touched cases, to reports (one row a case, with case_id). They are published as a generation
    of ``reports`` (``generations.current`` reads them), named after the query and its batch: a batch that
    is run again after a failure writes the same or, if it was complete, nothing. The store is
    Parquet in hash buckets of cases, with the log of Spark's file sink, so it also has each batch once. A
    document is told apart by (case_id, doc_type, file_name); one that comes again changes nothing.
    """

    def arriving() -> DataFrame:
        source = spark.readStream.schema(schema)
        return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).json(incoming)

    def refresh(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        publish(evaluate(documents_of(batch, types)), reports, f"{query}-{number}")

    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, before or ROCKSDB)
    try:
        once = arriving().dropDuplicates(KEY).withColumn("bucket", bucket_of(buckets)).writeStream.partitionBy("bucket").format("parquet")
        append = once.option("path", store).option("checkpointLocation", f"{checkpoint}/append").outputMode("append").trigger(availableNow=True).start()
        changed = touched_cases(arriving(), types).writeStream.outputMode("update").foreachBatch(refresh)
        return Intake(append, changed.option("checkpointLocation", f"{checkpoint}/refresh").trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(STATE)
