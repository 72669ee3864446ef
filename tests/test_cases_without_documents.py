"""Checks of cases that no document came for: every customer is a case, whatever was stored."""

import duckdb
import pytest

from verifold import queries
from verifold.plans import rules


@pytest.fixture(scope="module")
def few(tmp_path_factory, sf_dir):
    """Customers of sf_dir, and three whose keys give no document of any type."""
    path = tmp_path_factory.mktemp("few")
    duckdb.sql(f"COPY (FROM '{sf_dir}/nation.parquet') TO '{path}/nation.parquet'")
    keys = "c_custkey + CASE c_custkey WHEN 0 THEN 3281 WHEN 1 THEN 6712 WHEN 2 THEN 11859 ELSE 0 END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({keys} AS c_custkey) FROM '{sf_dir}/customer.parquet') TO '{path}/customer.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["v8_identity_check", "v9_income_checks"])
def test_all_cases_are_checked(spark, few, name):
    got = sorted(map(tuple, queries.QUERIES[name](spark, few).select("case_id", "check_id", "status").collect()))
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS FROM '{few}/{t}.parquet'")
    assert got == sorted(con.execute(f"SELECT case_id, check_id, status FROM ({queries.SQL[name]})").fetchall())
    assert {x[0] for x in got} >= {"c000003281", "c000006713", "c000011861"}


def test_wide_cases(spark):
    docs = spark.sql("SELECT 'a' AS case_id, 'cnh' AS doc_type, 'x' AS file_name, 'p/x' AS path, parse_json('{}') AS data")
    cases = spark.createDataFrame([("a",), ("b",), ("b",)], "case_id string")
    rows = {r.case_id: r for r in rules.wide_cases(docs, cases).select("case_id", "present", "inputs", "counts", "vehicle_type").collect()}
    assert rows["a"].present == ["licence"] and rows["a"].counts == {"licence": 1}
    assert len(rows) == 2 and (rows["b"].present, rows["b"].inputs, rows["b"].counts, rows["b"].vehicle_type) == ([], {}, {}, None)
