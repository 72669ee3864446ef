"""Near duplicates by Jaccard similarity against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_words_ops import EDGE, WORD, brute_fingerprint, lower

import corpus_pipeline as P
from verifold.llm import jaccard


def brute_set(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute_first(rows):
    """Smallest id of each component; ids are not null."""
    sets, left, out = {i: brute_set(t) for i, t in rows}, sorted(i for i, _ in rows), []
    while left:
        queue, first = [left.pop(0)], len(out)
        out.append(queue[0])
        while queue:
            x = queue.pop()
            near = [y for y in left if similar(sets[x], sets[y])]
            queue += near
            left = [y for y in left if y not in near]
        assert len(out) == first + 1
    return out


def graded(seed=7):
    """Texts of 200 words, each with copies at similarities about 0.95, 0.9, 0.85 and 0.7, and a chain of copies of copies."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 100_000)}"
    rows, at = [], 0
    for _ in range(20):
        base = [word() for _ in range(200)]
        for changed in (0, 1, 2, 3, 8):
            copy = list(base)
            for p in rng.choice(38, changed, replace=False):
                copy[5 * p + 2] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    for step in range(12):
        base[15 * step + 5] = word()
        rows.append((at, " ".join(base)))
        at += 1
    return rows


def kept(spark, rows):
    return sorted(r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())


def test_near_copies_beyond_four_bits(spark):
    rows = graded()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert any((fps[i] ^ fps[i + 3]).bit_count() > 4 for i in range(0, 100, 5))
    want = brute_first(rows)
    assert 40 <= len(want) < 50 and kept(spark, rows) == want


def test_any_order_gives_the_same(spark, monkeypatch):
    """All shingles as common as each other, and no link from SimHash."""
    monkeypatch.setattr(jaccard, "_levels", lambda distinct: (np.zeros(1 << 16, np.uint8), 16))
    monkeypatch.setattr(jaccard, "_simhash_pairs", lambda distinct, distance: distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    rows = graded(8)
    assert kept(spark, rows) == brute_first(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with up to nine words changed: few pairs of the group are looked at, none is lost."""
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    rng = np.random.default_rng(3)
    base, rows, compared = [f"w{i}" for i in range(150)], [], []
    for i in range(400):
        copy = list(base)
        for p in rng.choice(140, rng.integers(0, 10), replace=False):
            copy[p + 3] = f"x{rng.integers(0, 100_000)}"
        rows.append((i, " ".join(copy)))
    similar_of = jaccard._similar
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, *more: compared.append(pairs.count()) or similar_of(pairs, *more))
    assert kept(spark, rows) == brute_first(rows)
    assert sum(compared) < 400 * 399 / 2 / 20


@pytest.mark.parametrize("few", [2, 256])
def test_common_shingles_in_parts(spark, monkeypatch, few):
    """Texts of one common passage that are not alike, and some that are: buckets in many parts, by order and by parts."""
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "PART_LEVEL", 1)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(common + [f"w{rng.integers(0, 10_000)}" for _ in range(16 if i % 3 else 3)])))
    turns, pivots = [], jaccard._pivots
    monkeypatch.setattr(jaccard, "_pivots", lambda live, turn: turns.append(live.agg(F.max("spread")).first()[0]) or pivots(live, turn))
    assert kept(spark, rows) == brute_first(rows)
    assert turns and max(turns) > 2


def test_stage_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert kept(spark, rows) == brute_first(rows)


@pytest.mark.parametrize("shingle", [1, 5])
def test_sets(shingle):
    import pyarrow as pa

    texts = [t for _, t in EDGE]
    got = jaccard.shingle_sets(pa.array(texts, pa.string()), shingle)
    assert [len(s) for s in got] == [len(brute_set(t, shingle)) for t in texts]
