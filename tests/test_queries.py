"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from verifold import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    got = df.collect()
    if name not in queries.oracle_sql():
        assert got
        return
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    a = sorted(tuple(shown(r[c]) for c in cols) for r in got)
    b = sorted(tuple(shown(v) for v in r) for r in want)
    assert len(a) == len(b) and a == b
    assert got
