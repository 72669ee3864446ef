"""Ranked lexical search against scoring every document, and that blocks are left out."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verifold.llm import lexical_search as X
from verifold.llm.storage import save

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "n": F.lit("x")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit(1))
    return sorted((tuple(r) for r in X.search(d, i, k).collect()), key=str)


def test_rows(spark):
    docs = [(1, "Hello, hello world"), (2, None), (3, ""), (4, " .,;! "), (None, "hello"), (5, "ÄÖ Äö straße_NAÏVE"), (6, "hello"), (6, "hello"), (7, "world " * 3000 + "rare"), (8, "x\x7fy\x00z a-b_c 12.5"), (9, "HELLO hello"), (10, "hello world")]
    items = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "RARE"), (4, "ÄÖ äö naÏve"), (5, "nothing of this"), (6, "y Z 12 5 c"), (7, "hello hello")]
    for k in (50, 3):
        assert ranked(spark, docs, items, k) == brute(docs, items, k)


@pytest.mark.parametrize("pass_items", [1024, 4])
def test_random(spark, monkeypatch, pass_items):
    """Small shards and blocks; one text is in a third of the rows, so that many scores are equal."""
    monkeypatch.setattr(X, "PASS_ITEMS", pass_items)
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    chance = 1 / np.arange(1, 301)
    chance /= chance.sum()
    docs = [(i, " ".join(rnd.choice(words, int(rnd.integers(1, 80)), p=chance))) for i in range(600)] + [(1000 + i, "w1 w2 w3 w50") for i in range(300)]
    items = [(i, " ".join(rnd.choice(words, 8, p=chance))) for i in range(12)] + [(50, "w50 w1")]
    assert ranked(spark, docs, items, 20) == brute(docs, items, 20)


def test_blocks():
    """Blocks of similar documents: bounds hold, a stored shard reads back equal, most blocks are left out, and the result is exact."""
    rnd = np.random.default_rng(4)
    topics, size, v = 40, 50, 800
    rows = []
    for t in range(topics):
        for _ in range(size):
            rows.append(np.unique(np.concatenate([t * 20 + rnd.integers(0, 20, 12), rnd.integers(0, v, 2), [0]])))
    owner, flat = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows)
    impacts = rnd.integers(1, 1_000_000, len(flat))
    s = X.build_shard(np.arange(len(rows)), owner, flat, impacts, rnd.normal(size=(v, X.DIMS)).astype(np.float32))
    back = X.opened(X.stored(s))
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(s, back, strict=True))
    numbers = np.cumsum(~s.short) - 1
    for b in np.flatnonzero(~s.short):
        docs = X.docs_of(s, np.array([b]))
        assert 0 < len(docs) <= X.BLOCK_DOCS and ((s.summary[numbers[b]] - 1.0) * s.steps < (m := s.dense[docs].max(axis=0))).all() and (s.summary[numbers[b]] * s.steps >= m).all()
    weights = rnd.integers(1, 9000, v)
    items = X.Items(list(range(topics)), [np.unique(np.append(t * 20 + rnd.integers(0, 20, 5), 0)) for t in range(topics)], weights)
    best = X.Best(topics, 10)
    visited = X.search_shard(s, items, best)
    listed = sum(len(X.lists_of(s, t, weights, numbers).blocks) for t in items.terms)
    for i, t in enumerate(items.terms):
        scores = s.dense[:, np.searchsorted(s.columns, t)].astype(np.int64) @ weights[t]
        want = sorted((-x, d) for d, x in enumerate(scores.tolist()) if x)[:10]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == want
    assert visited < 0.5 * listed


def test_long_documents():
    """Long documents that share most terms of long items: a shard's summaries stay small, and the result is exact."""
    rnd = np.random.default_rng(5)
    rows = [np.flatnonzero(rnd.random(3000) < np.minimum(1, 1500 / np.arange(1, 3001))) for _ in range(150)]
    owner, flat, weights = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows), rnd.integers(1, 9000, 3000)
    s = X.build_shard(np.arange(len(rows)), owner, flat, rnd.integers(1, 1_000_000, len(flat)), rnd.normal(size=(3000, X.DIMS)).astype(np.float32))
    assert s.summary.size <= 16 << 20
    items = X.Items([0, 1], [np.unique(rnd.integers(0, 3000, 400)), np.array([2999])], weights)
    best = X.Best(2, 10)
    X.search_shard(X.opened(X.stored(s)), items, best)
    for i, t in enumerate(items.terms):
        scores = s.dense[:, np.searchsorted(s.columns, t)].astype(np.int64) @ weights[t]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == sorted((-x, d) for d, x in enumerate(scores.tolist()) if x)[:10]


@pytest.mark.parametrize("cells", [0, 4000, 8000])
def test_few_summaries(monkeypatch, cells):
    """Whatever number of lists has summaries, the result is exact and the summaries keep to their cells."""
    rnd = np.random.default_rng(6)
    monkeypatch.setattr(X, "SUMMARY_CELLS", cells)
    rows = [np.flatnonzero(rnd.random(40) < np.minimum(1, 8 / np.arange(1, 41))) for _ in range(300)]
    owner, flat, weights = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows), rnd.integers(1, 9000, 40)
    s = X.build_shard(np.arange(len(rows)), owner, flat, rnd.integers(1, 1_000_000, len(flat)), rnd.normal(size=(40, X.DIMS)).astype(np.float32))
    assert s.summary.size <= cells and (s.summary.size > 0) == (cells > 0)
    items = X.Items([0, 1, 2], [np.arange(3), np.array([0, 20, 39]), np.arange(40)], weights)
    best = X.Best(3, 10)
    X.search_shard(X.opened(X.stored(s)), items, best)
    for i, t in enumerate(items.terms):
        scores = s.dense[:, t].astype(np.int64) @ weights[t]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == sorted((-x, d) for d, x in enumerate(scores.tolist()) if x)[:10]


def test_empty(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, None)]) == []


def test_long_text(spark):
    """A text of several MB, and an item as long as a pass."""
    docs = [(1, "some words of it " * 200_000), (2, "words"), (3, "other")]
    items = [(1, "words it"), (2, " ".join(f"t{i}" for i in range(200_000)) + " other")]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_large_rows(spark):
    """Rows as large as a shard's: row groups keep their size, though a file has few rows."""
    rows = spark.range(0, 20, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [i], "x": [np.random.default_rng(i).bytes(1 << 20)]}) for b in batches for i in b.column(0).to_pylist()), "id long, x binary")
    table = save(rows, "large", row_group_bytes=4 << 20)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.df.inputFiles()]
    sizes = [m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)]
    assert sum(sizes) > 20 << 20 and max(sizes) < 6 << 20
    assert sorted((r["id"], bytes(r["x"])) for r in table.df.collect()) == [(i, np.random.default_rng(i).bytes(1 << 20)) for i in range(20)]


def test_query_and_sql(spark, sf_dir):
    from verifold.llm import queries

    base = sf_dir.replace("0.001", "0.01")
    got = queries.queries()["op11_lexical_search"](spark, base)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op11_lexical_search']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
