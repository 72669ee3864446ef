"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a task that is lost later is
recomputed from these files, never from an executor's own disk.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Session settings that hold while an intermediate table is written: the shuffle files of a
#: finished write are removed at once, batches for Python stay small when rows are large, and the
#: driver keeps no more than so many characters of each plan's description.
WRITE_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.maxPlanStringLength": "4000",
}


class Table(NamedTuple):
    """A written table: its rows and its place."""

    df: DataFrame
    path: str


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a new local folder if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def write_settings(spark: SparkSession):
    """WRITE_CONF for the time of a write, then what was there before."""
    before = {k: spark.conf.get(k, None) for k in WRITE_CONF}
    for k, v in WRITE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), row_group_bytes: int | None = None) -> Table:
    """Write ``df`` once to the shared folder and read it back. row_group_bytes: for rows so large that each has to be counted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/verifold/{uuid.uuid4().hex}/{name}"
    with write_settings(spark):
        # Version 2 pages store sorted keys by their differences.
        out = df.write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes or 128 << 20)
        if row_group_bytes:
            # Else the writer first looks at the size of pages and groups after 100 rows, whatever they hold.
            out = out.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1)
        out.partitionBy(*partition_by).parquet(path)
    return Table(spark.read.schema(df.schema).parquet(path), path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def free(spark: SparkSession, *tables: Table) -> None:
    """Delete tables that nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
