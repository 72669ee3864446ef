"""Hard negatives against all pairs, and that boxes are left out."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verifold.llm import hard_negatives as H


def brute(rows, is_anchor, positives=5, negatives=10):
    """All pairs, by plain loops. rows: (id, label, vector)."""
    own = [(i, y, [int(np.floor(256 * float(c))) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in sorted({(i, y, tuple(v)) for i, y, v in own if is_anchor(i)}):
        scored = [(-dot(v, w), j, z) for j, z, w in own]
        for s, j, _ in sorted(x for x in scored if x[2] == y and x[1] != i)[:positives]:
            p = -s
            fits = sorted((n, k) for n, k, z in scored if z != y and 30 * p <= -100 * n <= 90 * p)[:negatives]
            out += [(i, j, r + 1, k, p, -n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1)})
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, **how).collect())


def test_random_rows(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, int(rnd.integers(0, 4)), rnd.normal(0, 1, 6).round(2).tolist()) for i in range(900)]
    got = mined(spark, rows, tile_rows=200, block_anchors=30)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 2000


def test_odd_rows(spark):
    """Nulls, values that are not finite, vectors of several lengths, ties, copies and repeated rows."""
    rnd = np.random.default_rng(6)
    rows = [(i, i % 3, rnd.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 2, [1.0, 1.0, 0.5]) for i in range(300)]  # one vector in a third of the rows
    rows += [(None, 1, [1.0]), (2000, None, [1.0]), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [float("nan")]), (2040, 0, [float("inf"), 1.0]), (2050, 1, []), (2060, 2, [1.0]), (2070, 1, [1.0] * 5)]
    rows += [(5, 2, rows[5][2])] * 3 + [(20, 2, rows[20][2])] * 2
    got = mined(spark, rows, tile_rows=64, block_anchors=20)
    assert got == brute(rows, lambda i: i % 10 == 0) and got


def test_large_components(spark):
    """Scores beyond 53 bits are exact; components whose scores would not fit are refused."""
    rnd = np.random.default_rng(7)
    rows = [(i, i % 2, (rnd.normal(0, 1, 4) * 30_000).tolist()) for i in range(80)]
    assert mined(spark, rows, scale=256) == brute(rows, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="32 bits"):
        mined(spark, [*rows, (81, 1, [1e9] * 4)])
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [*rows, (81, 1, [6e6] * 4)])


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(10, 1, [1.0])]) == [] and mined(spark, [(10, 1, []), (11, 1, []), (12, 2, [])]) == brute([(10, 1, []), (11, 1, []), (12, 2, [])], lambda i: i % 10 == 0)


def test_boxes_are_left_out():
    """On rows that lie in clusters few leaves are opened."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(0, 1000, (64, 8))
    v = np.concatenate([c + rnd.normal(0, 20, (64, 8)) for c in centres]).astype(np.int64)
    labels = np.repeat(np.arange(64), 64)
    t = H.open_tile(np.arange(len(v)), labels, v.astype("<i4").tobytes(), 8, np.float64)
    n = 100
    at = rnd.integers(0, len(v), n)
    low, high = np.full(n, H.NEVER), np.full(n, -H.NEVER)
    for same in (True, False):
        best = H.Best(n, 5, np.float64)
        opened = H.search(t, H.Queries(v[at].astype(np.int32), labels[at], at, low, high, same, 5), best)
        scores = v[at] @ v.T
        fits = labels[at][:, None] == labels if same else labels[at][:, None] != labels
        fits &= at[:, None] != np.arange(len(v))
        for i in range(n):
            want = sorted((-s, j) for j, (s, f) in enumerate(zip(scores[i], fits[i])) if f)[:5]
            assert [(-s, j) for s, j in zip(best.scores[i], best.ids[i])] == want
        assert opened < (2 if same else 8) * n


def test_query_and_sql(spark, sf_dir):
    from verifold.llm import queries

    got = queries.queries()["op12_hard_negatives"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
