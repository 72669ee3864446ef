"""Reports in generations: each write adds one, and readers see it whole or not at all.

Below a store's path, ``data`` holds a folder for each generation and ``_committed`` an empty
file for each that is complete; its name tells order, kind and folder. A delta holds some cases
and replaces their earlier reports; a base holds all cases, so readers need nothing before it.
Creating a file is atomic in any store that Spark writes to. One writer at a time.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold.sources.store import bucket_of


class Generation(NamedTuple):
    number: int
    kind: str
    name: str


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, path: str) -> list[Generation]:
    """The committed generations in order."""
    fs, p = _fs(spark, f"{path}/_committed")
    if not fs.exists(p):
        return []
    names = (re.fullmatch(r"(\d+)\.(base|delta)\.(.+)", f.getPath().getName()) for f in fs.listStatus(p))
    return sorted(Generation(int(m[1]), m[2], m[3]) for m in names if m)


def _live(found: list[Generation]) -> list[Generation]:
    """The last base and what came after it."""
    at = max((i for i, g in enumerate(found) if g.kind == "base"), default=0)
    return found[at:]


def publish(df: DataFrame, path: str, name: str, kind: str = "delta") -> bool:
    """Add reports (one row a case, with case_id) as a generation. False if one of that name is there already.

    What an earlier try under the same name left is written over; readers never saw it.
    """
    spark = df.sparkSession
    found = generations(spark, path)
    if any(g.name == name for g in found):
        return False
    number = found[-1].number + 1 if found else 0
    df.withColumn("generation", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/data/{name}")
    fs, marker = _fs(spark, f"{path}/_committed/{number:012d}.{kind}.{name}")
    fs.create(marker, False).close()
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest report of each case, with the number of its generation. Without deltas since the last base, nothing is shuffled."""
    live = _live(generations(spark, path))
    if not live:
        raise FileNotFoundError(f"no committed generation in {path}")
    rows = spark.read.parquet(*(f"{path}/data/{g.name}" for g in live))
    if len(live) == 1:
        return rows
    columns = [c for c in rows.columns if c != "case_id"]
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*columns), "generation").alias("x")).select("case_id", "x.*").select(rows.columns)


def compact(spark: SparkSession, path: str, buckets: int = 256) -> bool:
    """Write all current reports as a base, a file for each hash bucket of cases, sorted so that a lookup of one case skips most of it. False if there is nothing to fold."""
    live = _live(generations(spark, path))
    if len(live) < 2:
        return False
    rows = current(spark, path).drop("generation").repartition(buckets, bucket_of(buckets)).sortWithinPartitions("case_id")
    return publish(rows, path, f"base-{live[-1].number}", "base")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete generations that the last base replaces, and their marks first. Only when no reader still works on them. Returns how many."""
    found = generations(spark, path)
    old = found[: len(found) - len(_live(found))]
    for g in old:
        for part in (f"{path}/_committed/{g.number:012d}.{g.kind}.{g.name}", f"{path}/data/{g.name}"):
            fs, p = _fs(spark, part)
            fs.delete(p, True)
    return len(old)
