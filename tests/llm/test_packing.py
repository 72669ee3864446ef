"""Packing: every id once, no gaps, little padding, balanced costs; the assignment against a plain search over all sequences."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verifold.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in rows]


def verify(got, rows, capacity):
    """All that the result promises, against the library's own ids. Returns padding."""
    want = expected(rows)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    wanted = {}
    for (i, _), ids in zip(rows, want, strict=True):
        wanted.setdefault(i, []).append(ids)
    assert set(by_doc) == set(wanted)
    for i, pieces in by_doc.items():
        crcs = [x for ids in wanted[i] for x in [(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.start + p.length <= len(ids) and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]]
        assert all((p.start, p.length, p.ids_crc32, p.doc_tokens) in crcs for p in pieces)
        if len(wanted[i]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(wanted[i][0])
                at += p.length
            assert at == len(wanted[i][0])
        assert sum(p.length for p in pieces) == sum(map(len, wanted[i]))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


ROWS = [(1, "a few words"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "long text " * 4000), (5, "in<|endoftext|>side"), (6, "same row"), (6, "same row"), *((i, "word " * (i * 7 % 300)) for i in range(10, 200))]


@pytest.mark.parametrize("capacity,group", [(64, 1000), (1024, 1 << 20), (100, 5000), (1, 10)])
def test_pack_rows(spark, capacity, group):
    rows = ROWS if capacity > 1 else ROWS[:9]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("x")}).repartition(3)
    got = packing.pack(df, TOKENIZER, capacity=capacity, group_ids=group).collect()
    assert verify(got, rows, capacity) == 0
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, TOKENIZER).collect()
    assert verify(got, rows, 1024) == 0
    # Each cut closes a sequence.
    assert len(got) - len(rows) <= len({r.sequence_id for r in got})


def test_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(2)
    rows = packing.sequences(packing.pack(docs, TOKENIZER, ids=True)).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {i: x for (i, _), x in zip(texts, expected(texts), strict=True)}
    n = 0
    for s in rows:
        assert len(s.ids) in (1024, s.n_tokens) and sum(s.lengths) == s.n_tokens == len(s.ids)
        n += s.n_tokens
        at = 0
        for d, length in zip(s.doc_ids, s.lengths, strict=True):
            own = ids[d]
            assert any(own[k : k + length] == s.ids[at : at + length] for k in range(len(own) - length + 1))
            at += length
    assert n == sum(map(len, ids.values()))


def test_padding(spark):
    one = spark.createDataFrame([(1, 5, 0, 1, [7] * 5), (2, 8, 0, 2, [7] * 8)], "sequence_id long, length long, offset long, doc_id long, ids array<int>")
    got = {r.sequence_id: r.ids for r in packing.sequences(one, capacity=16, pad_id=9).collect()}
    assert got[1] == [7] * 5 + [9] * 11 and got[2] == [7] * 8


def plain(lengths, capacity, linear, quadratic):
    """The same rule by looking at all sequences each time."""
    room = packing.capacities(sum(lengths), capacity)
    cost = [linear * (capacity - r) for r in room]
    todo = sorted((-n, i) for i, n in enumerate(lengths) if n)
    out, more = [], len(lengths)
    while todo:
        n = -todo[0][0]
        _, i = todo.pop(0)
        fits = [(cost[s], r, s) for s, r in enumerate(room) if r >= n]
        if not fits:
            fits = [(cost[s], r, s) for s, r in enumerate(room) if 0 < r]
        c, r, s = min(fits)
        take = min(n, r)
        if take < n:
            todo = sorted([*todo, (-(n - take), more)])
            more += 1
        out.append((s, take))
        cost[s], room[s] = cost[s] + linear * take + quadratic * take * take, r - take
    return out


@pytest.mark.parametrize("seed", range(6))
def test_assign(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 5, 17, 40, 63, 64, rnd.randint(1, 64)]) for _ in range(200)]
    pieces = [packing.Piece(i, 0, np.arange(n, dtype="<u4"), n) for i, n in enumerate(lengths)]
    got = packing.assign(pieces, 64, linear=10, quadratic=1)
    assert [(s, len(p.ids)) for s, _, p in got] == plain(lengths, 64, 10, 1)


def test_balance():
    """Costs of full sequences lie near each other: far nearer than when descending documents fill one after the other."""
    rnd = random.Random(1)
    lengths = sorted((min(300, int(rnd.lognormvariate(4, 1)) + 1) for _ in range(3000)), reverse=True)
    pieces = [packing.Piece(i, 0, np.zeros(n, dtype="<u4"), n) for i, n in enumerate(lengths)]
    squares = {}
    for s, _, p in packing.assign(pieces, 1024):
        squares[s] = squares.get(s, 0) + len(p.ids) ** 2
    plain_order, room, s = {}, 1024, 0
    for n in lengths:
        while n:
            take = min(n, room)
            plain_order[s] = plain_order.get(s, 0) + take * take
            n, room = n - take, room - take
            if not room:
                room, s = 1024, s + 1
    spread = lambda x: np.std(list(x.values())) / np.mean(list(x.values()))
    assert spread(squares) < 0.3 * spread(plain_order)


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_pack_long_text(spark):
    """One text of several MB."""
    rows = [(1, "some words of a very long text, " * 150_000), (2, "short")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert verify(got, rows, 1024) == 0
