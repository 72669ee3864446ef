"""SimHash near duplicates: segment popcounts, a grid range join under Manhattan distance, exact check.

A fingerprint is cut into segments and mapped to their bit counts. The Manhattan distance of two
such vectors is never more than the Hamming distance of the fingerprints, so it is a lower bound
that no link escapes. The segments form ``groups``; two fingerprints within ``distance`` bits are
within ``distance // groups`` of each other in one group at least, and so their vectors there,
moved by half of that each, meet in one cell of the integer grid. Equal cells are an equi-join;
inside a cell the links are checked exactly by Hamming distance.

Work is on distinct fingerprints, so exact copies cost one row. A cell gives a spanning forest of
its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm import components
from verifold.llm.storage import save
from verifold.llm.words import split_words, tidy

SEED = 42
#: Cells with more members than this are split by equal bits, in these steps: how many stretches of bits are equal.
CELL_ROWS, STEPS = 8192, (1, 2, 4, 8)
#: A step deals a member to this many smaller cells at most; for links of more than four bits some steps are left out.
MOST_WAYS = 500
#: Fingerprints with more than one in HOT rows are joined by broadcast; there are HOT at most.
HOT = 1000
_RUN = 4096


def document_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _RUN):
        bits = np.unpackbits(hashes[at : at + _RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    starts, flat = split_words(pc.ascii_lower(texts))
    flat = flat.cast(pa.large_binary())
    n = max(0, len(flat) - shingle + 1)
    space = pa.scalar(b" ", pa.large_binary())
    shingles = pc.binary_join_element_wise(*(flat.slice(i, n) for i in range(shingle)), space)
    hashes = np.fromiter((digest(x, SEED) for x in _values(shingles)), dtype=np.uint64, count=n)
    power, out = np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if b - a >= shingle:
            mine = hashes[a : b - shingle + 1]
        elif b > a:
            mine = np.array([digest(b" ".join(flat.slice(a, b - a).to_pylist()), SEED)], dtype=np.uint64)
        else:
            continue
        out[i] = (power * (2 * document_bits(mine) > len(mine))).sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the 64-bit fingerprint (signed long) of each row's whole text.

    Words are runs without ASCII white space after A-Z became a-z; shingles of ``shingle`` words,
    repeats included; fewer words make one shingle, no word or null text the fingerprint zero. A
    bit is one if it is set in over half the shingles' XXH64 (seed 42).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps = pa.array(_fingerprints(part.column("text"), shingle).view(np.int64))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": fps})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _values(words: pa.Array, step: int = 1 << 16) -> Iterator[bytes]:
    for at in range(0, len(words), step):
        yield from words.slice(at, step).to_pylist()


def segment_counts(fps: np.ndarray, segment: int = 2) -> np.ndarray:
    """Bits set in each segment of each fingerprint, 64 / segment columns."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), -1, segment).sum(axis=2, dtype=np.int64)


def cells(fps: np.ndarray, distance: int, segment: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells that each fingerprint takes part in: (cell keys, row of fps)."""
    counts = segment_counts(fps, segment)
    width = counts.shape[1] // groups
    reach = -(-(distance // groups) // 2)
    base = segment + 3
    keys, rows = [], []
    every = np.arange(len(fps))
    for g in range(groups):
        part = counts[:, g * width : (g + 1) * width if g < groups - 1 else counts.shape[1]]
        power = np.array([pow(base, i, 1 << 64) for i in range(part.shape[1])], dtype=np.uint64)
        key = (part.astype(np.uint64) * power).sum(axis=1, dtype=np.uint64)
        found = [(key, part, every)]
        at = found
        for _ in range(reach):  # one step along one axis, kept inside the range of the axis
            moved = []
            for k, p, r in at:
                for axis in range(p.shape[1]):
                    for step in (1, -1):
                        ok = (p[:, axis] + step >= 0) & (p[:, axis] + step <= segment)
                        q = p[ok].copy()
                        q[:, axis] += step
                        moved.append((k[ok] + power[axis] if step > 0 else k[ok] - power[axis], q, r[ok]))
            found, at = found + moved, moved
        k, r = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
        if reach > 1:  # the same cell can be met on several ways
            k, r = (x.ravel() for x in np.split(np.unique(np.stack([k, r.astype(np.uint64)]), axis=1), 2))
        keys.append(_spread(k, g))
        rows.append(r.astype(np.int64))
    return np.concatenate(keys), np.concatenate(rows)


def _spread(keys: np.ndarray, group: int) -> np.ndarray:
    x = (keys + np.uint64(group + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest over fingerprints at most ``distance`` bits apart."""
    left = fps.copy()
    links = []
    queue: list[np.ndarray] = []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node[0]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                links.append((np.full(len(found), node[0]), found))
                queue += [found[i : i + 1] for i in range(len(found))]
    return links


def _cell_links(batches: Iterator[pa.RecordBatch], distance: int, most: float) -> Iterator[pa.RecordBatch]:
    """Links inside each cell; rows come sorted by cell. Members of cells above ``most`` are handed on as rows with a cell."""
    key, held, over = None, [], False

    def close(out: list) -> None:
        fps = np.unique(np.concatenate(held))
        if len(fps) == 2:
            if int(fps[0] ^ fps[1]).bit_count() <= distance:
                out.append((fps[:1], fps[1:]))
        elif len(fps) > 2:
            out += forest(fps, distance)

    for batch in batches:
        keys, fps = (batch.column(c).to_numpy().view(np.uint64) for c in ("cell", "fp"))
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(cuts[1:], len(keys))
        out: list = []
        beyond: list = []
        single = (ends - cuts) == 1
        if len(single) > 2:  # most cells have one member: skip them at once
            single[[0, -1]] = False
        for a, b in zip(cuts[~single].tolist() if len(single) > 2 else cuts.tolist(), ends[~single].tolist() if len(single) > 2 else ends.tolist(), strict=True):
            if key is None or keys[a] != key:
                if held and not over:
                    close(out)
                key, held, over = keys[a], [], False
            if over:
                beyond.append((keys[a:b], fps[a:b]))
                continue
            held.append(fps[a:b])
            if sum(map(len, held)) > most:
                mine = np.concatenate(held)
                beyond.append((np.full(len(mine), key), mine))
                held, over = [], True
        yield _link_batch(out, beyond)
    out = []
    if held and not over:
        close(out)
    yield _link_batch(out, [])


def _link_batch(links: list, beyond: list) -> pa.RecordBatch:
    empty = np.zeros(0, dtype=np.uint64)
    a, b = (np.concatenate([empty, *(x[i] for x in links)]) for i in (0, 1))
    if len(a):
        a, b = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([a, b]), axis=1)
        a, b = both[0], both[1]
    c, f = (np.concatenate([empty, *(x[i] for x in beyond)]) for i in (0, 1))
    return pa.RecordBatch.from_pydict({
        "cell": pa.array(np.concatenate([np.zeros(len(a), np.uint64), c]).view(np.int64), mask=np.arange(len(a) + len(c)) < len(a)),
        "a": pa.array(np.concatenate([a, f]).view(np.int64)),
        "b": pa.array(np.concatenate([b, f]).view(np.int64)),
    })


LINK_SCHEMA = "cell long, a long, b long"


def links(distinct: DataFrame, distance: int = 4, segment: int = 2, groups: int = 2) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at most ``distance`` bits apart.

    ``distinct``: column fp, no value twice.
    """
    if 64 % segment or groups < 1 or not 0 <= distance < 64:
        raise ValueError("segment must divide 64, groups be 1 or more, and distance from 0 to 63")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, rows = cells(fps, distance, segment, groups)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(keys.view(np.int64)), "fp": pa.array(fps[rows].view(np.int64))})

    placed = distinct.select("fp").mapInArrow(spread, "cell long, fp long")
    found = [save(_linked(placed, distance, CELL_ROWS), "links").df]
    steps = [e for e in STEPS if e == 1 or comb(distance + e, e) <= MOST_WAYS]
    for equal in steps:
        large = found[-1].where("cell is not null").select(F.col("a").alias("fp")).distinct()
        if large.isEmpty():
            break
        found.append(save(_linked(_by_equal_bits(large, distance, equal), distance, CELL_ROWS if equal < steps[-1] else float("inf")), "links").df)
    return reduce(DataFrame.unionByName, (x.where("cell is null").select("a", "b") for x in found)).distinct()


def _linked(placed: DataFrame, distance: int, most: float) -> DataFrame:
    return placed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(lambda it: _cell_links(it, distance, most), LINK_SCHEMA)


def _by_equal_bits(large: DataFrame, distance: int, equal: int) -> DataFrame:
    """Members of large cells in smaller ones: cell, fp. A member of several large cells is dealt once.

    Of ``distance + equal`` stretches of bits ``equal`` are the same in both ends of a link, so its ends
    meet again where these are, and no two blocks of a cell have to be crossed. For links of four bits the last
    step has eight of twelve stretches equal, of five bits or more, so at least 40 bits are the same, and a cell holds 2 ** 24 members at most.
    """
    n = min(distance + equal, 64)
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    bits = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long")) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    keys = (F.xxhash64(F.lit(i), *(bits[j] for j in chosen)) for i, chosen in enumerate(combinations(range(n), n - distance)))
    return large.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def grouped_fingerprints(marked: DataFrame, distance: int = 4, segment: int = 2, groups: int = 2) -> DataFrame:
    """fp, first (its smallest doc_id), n (its rows) and root (one fingerprint for each component) of each distinct fingerprint."""
    distinct = save(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct").df
    roots = components.connected(links(distinct, distance, segment, groups))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, segment: int = 2, groups: int = 2) -> DataFrame:
    """Fingerprint and component of each row: doc_id, fingerprint (16 hex digits), component_id.

    Two rows are linked if their fingerprints differ in ``distance`` bits or fewer; component_id is
    the smallest doc_id that links reach, null only where no row reached has a doc_id. Needs
    columns doc_id and text; others are ignored. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows come back as often.
    """
    marked = save(fingerprints(docs, shingle), "fingerprints").df
    grouped = grouped_fingerprints(marked, distance, segment, groups)
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = save(grouped.join(least, "root").select("fp", "component_id", "n"), "named").df
    # A fingerprint of more than one row in HOT would fill one task: those few, HOT at most, are sent to all.
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id")))
    cold = named.where(F.col("n") * HOT <= total).select("fp", "component_id")
    rows = marked.join(hot.withColumnRenamed("fp", "hot_fp"), F.col("fp") == F.col("hot_fp"), "left")
    rest = rows.where("hot_fp is null").select("doc_id", "fp").join(cold, "fp").select("doc_id", "fp", "component_id")
    done = rows.where("hot_fp is not null").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
