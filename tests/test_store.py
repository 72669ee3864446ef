"""VARIANT at rest, and trees of files of which only the newest are opened."""

import json

from pyspark.sql import functions as F

from verifold.plans import report, rules
from verifold.sources import store as S


def test_variant_store(spark, tmp_path):
    rows = [("c1", "cnh", "1.json", "p1", json.dumps({"data": {"nome": "A B", "x": {"y": [1, None]}, "big": "z" * 400}})), ("c1", "proposta_daycoval", "1.json", "p2", json.dumps({"data": {"nome_financiado": "A B", "salario": None}})), ("c2", "cnh", "1.json", "p3", "[1"), ("c2", "atpv", "1.json", "p4", '{"data": null}')]
    read = S.classify_read(spark.createDataFrame(rows, "case_id string, doc_type string, file_name string, path string, raw string")).drop("raw")
    before = spark.conf.get("spark.sql.variant.writeShredding.enabled")
    S.append_variants(read, str(tmp_path / "s"))
    assert spark.conf.get("spark.sql.variant.writeShredding.enabled") == before
    back = spark.read.parquet(str(tmp_path / "s"))
    shown = lambda df: sorted((r.case_id, r.doc_type, r.read_error, r.j) for r in df.select("case_id", "doc_type", "read_error", F.to_json("data").alias("j")).collect())
    key = lambda x: tuple(map(str, x))
    assert sorted(shown(back), key=key) == sorted(shown(read), key=key)
    build = lambda: F.concat(*(f().cast(rules.CHECK) for f in rules.FAMILIES))
    asked = rules.asked_fields(build)
    assert "nome" in asked["licence"] and "salario" in asked["proposal"]
    small, whole = (report.master_report(back, F.lit("t"), only_asked=x) for x in (True, False))
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))
    # The scan asks for single fields, not for the whole VARIANT.
    plan = small._jdf.queryExecution().executedPlan().toString()
    schema = next(x for x in plan.split("ReadSchema: ")[1:])
    assert "data:struct<0:" in schema and "data:variant" not in schema


def test_only_newest_are_opened(spark, tmp_path):
    root = tmp_path / "in"
    def put(case, kind, name, data):
        (root / case / kind).mkdir(parents=True, exist_ok=True)
        (root / case / kind / name).write_text(json.dumps({"data": data}))

    for i in range(5):
        for j in range(3):
            put(f"c {i}", "cnh", f"{j} [a]+%41.json", {"nome": f"N{i}{j}"})
    put("c 0", "atpv", "1.json", {"placa": "P"})
    listed = S.list_documents(spark, str(root))
    assert listed.count() == 16 and S.list_documents(spark, str(root), "atpv").count() == 1
    newest = S.newest_documents(listed)
    opened = S.read_listed(newest)
    assert len(opened.inputFiles()) == 6 and sum(r.n_bytes for r in newest.collect()) == sum(len(r.raw) for r in opened.collect())
    # Older files may be gone by then.
    for i in range(5):
        (root / f"c {i}" / "cnh" / "0 [a]+%41.json").unlink()
    got = S.ingest_newest(spark, str(root), str(tmp_path / "store"), batch_files=2)
    name = F.coalesce(F.try_variant_get("data", "$.nome", "string"), F.try_variant_get("data", "$.placa", "string"))
    want = sorted([(f"c {i}", "cnh", 2, f"N{i}2") for i in range(5)] + [("c 0", "atpv", 1, "P")])
    assert sorted((r.case_id, r.doc_type, r.n_docs, r.x) for r in got.select("case_id", "doc_type", "n_docs", name.alias("x")).collect()) == want
    # Run again: the same listing and batches.
    put("c 9", "cnh", "1.json", {"nome": "late"})
    assert S.ingest_newest(spark, str(root), str(tmp_path / "store"), batch_files=2).count() == 6
    assert report.master_report(got, F.lit("t"), [rules.identity_check]).where("case_id = 'c 0'").first().meta.docs == {"licence": 2, "transfer": 1}
