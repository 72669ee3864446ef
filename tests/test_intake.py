"""Streamed intake and report generations: only touched cases are evaluated, readers see whole generations, and batches that run twice change nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from verifold.plans import report, rules
from verifold.sources import generations as G
from verifold.sources import store as S
from verifold.streaming.intake import stream_intake

SCHEMA = "case_id string, doc_type string, file_name string, raw string"


@pytest.fixture
def intake(spark, tmp_path):
    class Intake:
        path = str(tmp_path)
        seen = []

        def arrive(self, n, rows):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("case_id", "doc_type", "file_name", "raw"), r))) for r in rows))

        def evaluate(self, rows):
            return report.master_report(S.classify_read(rows.withColumn("path", F.concat_ws("/", "case_id", "file_name"))), F.lit("t"), [rules.identity_check]).select("case_id", "overall_status", F.size("checks").alias("n"), F.col("meta.docs").alias("docs"))

        def noted(self, rows):
            self.seen.append({(r.case_id, r.doc_type) for r in rows.select("case_id", "doc_type").collect()})
            return self.evaluate(rows)

        def run(self, files=None):
            stream_intake(spark, f"{self.path}/in", SCHEMA, f"{self.path}/store", f"{self.path}/reports", self.noted, f"{self.path}/ck", 4, files).awaitTermination()

        def reports(self):
            return {r.case_id: (r.overall_status, r.n, r.docs) for r in G.current(spark, f"{self.path}/reports").collect()}

        def batch(self):
            return {r.case_id: (r.overall_status, r.n, r.docs) for r in self.evaluate(spark.read.parquet(f"{self.path}/store")).collect()}

    Intake.seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state stores
    yield Intake()
    spark.conf.set("spark.sql.shuffle.partitions", before)


def doc(case, kind, data, name="a.json"):
    return case, kind, name, json.dumps({"data": data})


def test_only_touched_cases(spark, intake):
    intake.arrive(1, [doc(f"c{i}", "proposta_daycoval", {"nome_financiado": "A B", "data_nascimento": "1"}) for i in range(8)])
    intake.run()
    assert intake.reports() == intake.batch() and len(intake.reports()) == 8
    intake.arrive(2, [doc("c3", "cnh", {"nome": "A B", "data_nascimento": "1"}), doc("c9", "atpv", {})])
    intake.run()
    # The second batch: the documents of two cases, the earlier one of c3 among them, and no others.
    assert intake.seen[1:] == [{("c3", "proposal"), ("c3", "licence"), ("c9", "transfer")}]
    assert intake.reports() == intake.batch() and len(intake.reports()) == 9
    before = intake.reports()
    intake.run()
    assert intake.reports() == before and len(intake.seen) == 2


def test_repeats_and_versions(spark, intake):
    """A newer file replaces an older one, an older one that comes late doesn't, and a file that comes again changes nothing."""
    intake.arrive(1, [doc("c", "cnh", {"nome": "OLD NAME"}, "2.json"), doc("c", "proposta_daycoval", {"nome_financiado": "A B"})])
    intake.run()
    intake.arrive(2, [doc("c", "cnh", {"nome": "LATE NAME"}, "1.json")])
    intake.arrive(3, [doc("c", "cnh", {"nome": "OTHER CONTENT"}, "2.json")])
    intake.run(files=1)
    assert spark.read.parquet(f"{intake.path}/store").count() == 3
    assert intake.reports() == intake.batch() and intake.reports()["c"][2]["licence"] == 2
    intake.arrive(4, [doc("c", "cnh", {"nome": "A B"}, "3.json")])
    intake.run()
    assert intake.reports() == intake.batch() and intake.reports()["c"][2]["licence"] == 3


def test_killed_batch(spark, intake):
    """What an evaluation that fails, or a writer that dies before its mark, leaves behind is not seen; the next run makes up for it."""
    intake.arrive(1, [doc("c1", "proposta_daycoval", {"nome_financiado": "A B"})])
    intake.run()
    before = intake.reports()
    intake.arrive(2, [doc("c2", "cnh", {"nome": "A B"})])
    good, failing = intake.noted, lambda rows: intake.evaluate(rows).withColumn("n", F.raise_error(F.lit("killed")).cast("int"))
    intake.noted = failing
    with pytest.raises(Exception, match="killed"):
        intake.run()
    assert intake.reports() == before
    intake.noted = good
    intake.run()
    assert intake.reports() == intake.batch() and set(intake.reports()) == {"c1", "c2"}


def test_generations(spark, tmp_path):
    path, get = str(tmp_path / "r"), lambda: {r.case_id: r.v for r in G.current(spark, str(tmp_path / "r")).collect()}
    rows = lambda **x: spark.createDataFrame([*x.items()], "case_id string, v int")
    with pytest.raises(FileNotFoundError):
        G.current(spark, path)
    assert G.publish(rows(a=1, b=1, c=1), path, "q-0") and get() == {"a": 1, "b": 1, "c": 1}
    old = G.current(spark, path)
    rows(b=9).withColumn("generation", F.lit(1).cast("long")).write.parquet(f"{path}/data/q-1")  # a writer that dies before its mark
    assert get() == {"a": 1, "b": 1, "c": 1}
    assert G.publish(rows(b=2, d=2), path, "q-1") and not G.publish(rows(b=7), path, "q-1")
    assert get() == {"a": 1, "b": 2, "c": 1, "d": 2}
    assert G.compact(spark, path, 3) and not G.compact(spark, path, 3) and get() == {"a": 1, "b": 2, "c": 1, "d": 2}
    assert "Exchange" not in G.current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert G.publish(rows(a=3), path, "q-2") and get()["a"] == 3
    assert {r.case_id: r.v for r in old.collect()} == {"a": 1, "b": 1, "c": 1}  # a reader from before
    assert G.vacuum(spark, path) == 2 and get() == {"a": 3, "b": 2, "c": 1, "d": 2} and len(os.listdir(f"{path}/data")) == 2


def test_one_batch_with_a_document_twice(spark, intake):
    intake.arrive(1, [doc("c", "cnh", {})] * 3)
    intake.run()
    assert spark.read.parquet(f"{intake.path}/store").count() == 1 and intake.reports()["c"][2] == {"licence": 1}
