"""Blocks of documents, and sums over keys that all blocks share.

A corpus-wide statistic of very many keys (word windows, n-grams) is gathered like this:

1. ``pack`` writes the documents as blocks of a few MB of text.
2. Each block is reduced to its distinct 64-bit keys with a value each, cut into key ranges and
   sent as one packed row for each (block, range): ``request_rows``.
3. Rows of one range meet in one task and are merged: ``merge``. A key comes from each block once
   at most, however often it occurs, so no key is hot; ranges follow hashed keys and are even.
4. The totals go back to each block in the order of its keys: ``replies`` of ``cogroup``.

Only keys and counts move, not a row for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of this size up to SMALL_BYTES of text; then they grow with the square root, so that a
#: (block, range) row keeps ROW_KEYS keys or more while a range stays small.
BLOCK_BYTES, SMALL_BYTES, ROW_KEYS = 4 << 20, 64 << 30, 64
#: Keys that one merge task should hold.
RANGE_KEYS = 1_000_000
BLOCK_SCHEMA = "block long, n_bytes long, data binary"
REQUEST_SCHEMA = "part int, block long, n int, keys binary, vals array<binary>"
REPLY_SCHEMA = "kind string, part int, block long, vals array<binary>, keys array<long>, counts array<long>, weights array<double>"


def packed(values: np.ndarray) -> bytes:
    """Values of one dtype as byte planes, compressed."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=dtype)
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def block_size(total: int) -> int:
    """Bytes of a block for so many bytes of text."""
    return int(BLOCK_BYTES * max(1.0, (total / SMALL_BYTES) ** 0.5))


def pack(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Rows of ``docs`` (a column named text among them) as blocks; a longer document is one block."""
    if block_bytes is None:
        block_bytes = block_size(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, 0
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for x in held:
                    out.write_batch(x)
            data = zstandard.compress(sink.getvalue(), 3)
            return pa.RecordBatch.from_pydict({"block": pa.array([first + number], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > block_bytes:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield block()
                    held, size, number, at = [], 0, number + 1, i
                size += n
            if batch.num_rows > at:
                held.append(batch.slice(at))
        if held:
            yield block()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def documents_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    found = table.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Key range of each key: grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def request_rows(block: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """One row for each key range; keys are distinct and ascending."""
    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    rows = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    return pa.RecordBatch.from_pydict({
        "part": pa.array(rows, pa.int32()),
        "block": pa.array([block] * len(rows), pa.int64()),
        "n": pa.array([int(cuts[p + 1] - cuts[p]) for p in rows], pa.int32()),
        "keys": pa.array([packed(keys[cuts[p] : cuts[p + 1]]) for p in rows], pa.binary()),
        "vals": pa.array([[packed(v[cuts[p] : cuts[p + 1]]) for v in values] for p in rows], pa.list_(pa.binary())),
    })


def ask(blocks: DataFrame, keyed: Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]], parts: int) -> DataFrame:
    """Requests of all blocks; ``keyed`` gives a block's distinct ascending keys and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                yield request_rows(block, *keyed(documents_of(data.as_buffer())), parts)

    return blocks.select("block", "data").mapInArrow(run, REQUEST_SCHEMA)


def merge(requests: DataFrame, dtypes: list, combine: Callable, table: Callable | None = None) -> DataFrame:
    """Merge each key range.

    ``combine(starts, order, values)`` gets the sorted order of all requests and where each
    distinct key starts, and returns arrays per distinct key; each block gets these for its keys
    in rows of kind 'reply'. ``table(keys, totals)`` may return rows to keep: (kind, keys, counts) or also weights.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        part, blocks, sizes = group.column("part")[0].as_py(), group.column("block").to_pylist(), group.column("n").to_pylist()
        keys = np.concatenate([unpacked(x, np.uint64) for x in group.column("keys").to_pylist()])
        vals = group.column("vals").to_pylist()
        values = [np.concatenate([unpacked(x[i], t) for x in vals]) for i, t in enumerate(dtypes)]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(first)
        totals = combine(starts, order, values)
        back = np.empty(len(keys), dtype=np.int64)
        back[order] = np.cumsum(first) - 1
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        extra = table(ranked[starts], totals) if table else []
        owner = np.zeros(len(keys), dtype=np.uint8)
        owner[order[starts]] = 1
        replies = [[packed(t[back[a:b]]) for t in totals] + [packed(owner[a:b])] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n, m = len(blocks), len(extra)
        return pa.table({
            "kind": pa.array(["reply"] * n + [x[0] for x in extra], pa.string()),
            "part": pa.array([part] * (n + m), pa.int32()),
            "block": pa.array([*blocks, *[None] * m], pa.int64()),
            "vals": pa.array([*replies, *[None] * m], pa.list_(pa.binary())),
            "keys": pa.array([*[None] * n, *[x[1].view(np.int64) for x in extra]], pa.list_(pa.int64())),
            "counts": pa.array([*[None] * n, *[x[2] for x in extra]], pa.list_(pa.int64())),
            "weights": pa.array([*[None] * n, *[x[3] if len(x) > 3 else None for x in extra]], pa.list_(pa.float64())),
        })

    return requests.groupBy("part").applyInArrow(run, REPLY_SCHEMA)


def reply_of(rows: list[tuple[int, list[bytes]]], dtypes: list) -> list[np.ndarray]:
    """A block's totals in the order of its keys, from (part, vals) rows."""
    rows = sorted(rows, key=lambda x: x[0])
    return [np.concatenate([np.zeros(0, t), *(unpacked(x[1][i], t) for x in rows)]) for i, t in enumerate(dtypes)]


def cogroup(blocks: DataFrame, replies: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(block, documents, answers)`` for each block, where ``answers[name]`` holds (part, vals) rows.

    ``replies``: columns name, part, block, vals. Each group is one block and its own answers.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers: dict[str, list] = {}
        for name, part, vals in zip(*(right.column(c).to_pylist() for c in ("name", "part", "vals")), strict=True):
            answers.setdefault(name, []).append((part, vals))
        done = [work(block, documents_of(data), answers) for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist(), strict=True)]
        return pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in done])

    return (
        blocks.select("block", "data")
        .groupBy("block")
        .cogroup(replies.select("name", "part", "block", "vals").groupBy("block"))
        .applyInArrow(run, schema)
    )


def parts_for(blocks: DataFrame, keys_per_byte: float) -> int:
    """Key ranges for the text there is: 12 at least, of about RANGE_KEYS keys, but not so many that rows of a block get short."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(12, min(-(-int(total * keys_per_byte) // RANGE_KEYS), int(block_size(total) * keys_per_byte) // ROW_KEYS))
