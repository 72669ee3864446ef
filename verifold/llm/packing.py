"""Packing of documents into training sequences of equal length and balanced attention cost.

Attention over a piece of n ids costs about ``linear * n + quadratic * n * n``. Pieces of a group are
taken in descending length, and each goes to the cheapest sequence that still has room for it. A
group has exactly as many sequences as its ids fill, so a piece is cut only when no sequence
has room for the whole of it.

A task packs its own documents in groups of about ``group_ids`` ids; what a group doesn't fill waits
for the next one. There is no shuffle, and a task holds one group, not its partition.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verifold.llm.token_files import encoder
from verifold.llm.words import tidy

CAPACITY = 1024
GROUP_IDS = 1 << 20
#: Cost of an id by itself and of each pair of ids of a piece: the layers of a model of width w take
#: 12 w w operations an id and 2 w a pair, here for w = 1024.
LINEAR, QUADRATIC = 6 * 1024, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NONE = np.iinfo(np.int64).max


class Piece(NamedTuple):
    """Consecutive ids of one document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


def capacities(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that ``total`` ids fill: full ones, and powers of two for the rest, which need no padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(pieces: list[Piece], capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> list[tuple[int, int, Piece]]:
    """(sequence, offset, piece) for all ids of ``pieces``; sequences are numbered from 0 and filled without a gap."""
    room = capacities(sum(len(p.ids) for p in pieces), capacity)
    size = list(room)
    # Sequences by the room that is left: the cheapest of each heap stands in ``least``. Short ones
    # start with the cost of the ids that they lack, or they would draw the longest pieces.
    heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for s, n in enumerate(room):
        heaps[n].append((linear * (capacity - n), s))
    least = np.full(capacity + 1, _NONE, dtype=np.int64)
    for n, h in enumerate(heaps):
        heapq.heapify(h)
        if h:
            least[n] = h[0][0]
    waiting = [(-len(p.ids), i, p) for i, p in enumerate(pieces) if len(p.ids)]
    heapq.heapify(waiting)
    out, more = [], len(pieces)
    while waiting:
        _, _, piece = heapq.heappop(waiting)
        n = len(piece.ids)
        at = n + int(least[n:].argmin())
        if least[at] == _NONE:
            # Nobody has room for all of it: the cheapest sequence is filled up with its start.
            at = 1 + int(least[1:n].argmin())
            piece, rest = piece.cut(at)
            heapq.heappush(waiting, (-len(rest.ids), more, rest))
            n, more = at, more + 1
        cost, s = heapq.heappop(heaps[at])
        least[at] = heaps[at][0][0] if heaps[at] else _NONE
        out.append((s, size[s] - at, piece))
        if at > n:
            cost += linear * n + quadratic * n * n
            heapq.heappush(heaps[at - n], (cost, s))
            least[at - n] = heaps[at - n][0][0]
    return out


class Packer:
    """Packs a stream of documents group by group; ``rows`` gives what is done so far."""

    def __init__(self, first: int, capacity: int, group_ids: int, linear: int, quadratic: int):
        self.next, self.capacity, self.group_ids, self.linear, self.quadratic = first, capacity, max(group_ids, capacity), linear, quadratic
        self.held: list[Piece] = []
        self.size = 0
        self.done: list[tuple[int, int, Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Full sequences are cut from the start of a long document; the rest waits for its group."""
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self.done.append((self.next, 0, Piece(doc_id, at, ids[at : at + self.capacity], len(ids))))
            self.next += 1
        if full < len(ids):
            self.held.append(Piece(doc_id, full, ids[full:].copy(), len(ids)))
            self.size += len(ids) - full
            if self.size >= self.group_ids:
                self.close()

    def close(self, last: bool = False) -> None:
        """Pack what waits; but for the last group, the ids beyond full sequences wait on."""
        over = 0 if last else self.size % self.capacity
        rest: list[Piece] = []
        while over:
            piece = self.held.pop()
            n = len(piece.ids)
            if n > over:
                piece, tail = piece.cut(n - over)
                self.held.append(piece)
                rest.append(tail)
                over = 0
            else:
                rest.append(piece)
                over -= n
        placed = assign(self.held, self.capacity, self.linear, self.quadratic)
        self.done += ((self.next + s, at, p) for s, at, p in placed)
        self.next += 1 + max((s for s, _, _ in placed), default=-1)
        self.held, self.size = rest[::-1], sum(len(p.ids) for p in rest)

    def rows(self, ids: bool) -> pa.RecordBatch:
        done, self.done = self.done, []
        longs = lambda values: pa.array(values, pa.int64())
        out = {
            "doc_id": longs([p.doc_id for _, _, p in done]), "start": longs([p.start for _, _, p in done]), "length": longs([len(p.ids) for _, _, p in done]),
            "ids_crc32": longs([zlib.crc32(p.ids.astype("<u4", copy=False).tobytes()) for _, _, p in done]), "doc_tokens": longs([p.doc_tokens for _, _, p in done]),
            "sequence_id": longs([s for s, _, _ in done]), "offset": longs([at for _, at, _ in done]),
        }
        if ids:
            out["ids"] = pa.array([p.ids.astype(np.int32) for _, _, p in done], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False, group_ids: int = GROUP_IDS, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """One row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset; ids (array of int) if asked for.

    Needs columns doc_id and text; others are left out. A document is its ids and ``end_id``, so a null
    or empty text has one id. Each id lies in one piece; a sequence's pieces follow each other from
    offset 0. All sequences have ``capacity`` ids but for the last group of each task, whose rest fills
    sequences of a power of two. A document over ``capacity`` ids is cut from its start. Repeated
    rows, and rows without doc_id, are packed like others, each by itself. No document, no row.

    Sequence ids are unique, and grow within a task; they follow the order of the rows in their
    partition, so give rows from files or a written table if lost tasks shall repeat them.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer, tok = Packer((context.partitionId() if context else 0) << 33, capacity, group_ids, linear, quadratic), encoder(tokenizer)
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 3000):
                part = batch.slice(at, 3000)
                flat, sizes = tok.encode(part.column("text"))
                for doc, own in zip(part.column("doc_id").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    packer.add(doc, np.append(own, end))
                if packer.done:
                    yield packer.rows(ids)
        packer.close(last=True)
        if packer.done:
            yield packer.rows(ids)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, SCHEMA + ", ids array<int>" * ids)


def padded_length(n: Column, capacity: int = CAPACITY) -> Column:
    """Length of a sequence with its padding: ``capacity``, but a power of two stays."""
    return F.when(F.bit_count(n) == 1, n).otherwise(F.greatest(n, F.lit(capacity).cast("long")))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Rows to train on, from ``pack`` with ids: sequence_id, ids (padded), lengths of the pieces in order, doc_ids, n_tokens and cost.

    A sequence has ``capacity`` ids at most, so its row is small.
    """
    one = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    n = F.sum("length")
    rows = pieces.groupBy("sequence_id").agg(one.alias("p"), n.alias("n_tokens"), F.sum(F.col("length") * LINEAR + F.col("length") * F.col("length") * QUADRATIC).alias("cost"))
    pad = F.array_repeat(F.lit(pad_id).cast("int"), (padded_length(F.col("n_tokens"), capacity) - F.col("n_tokens")).cast("int"))
    get = lambda k: F.transform("p", lambda x: x[k])
    return rows.select("sequence_id", F.concat(F.flatten(get("ids")), pad).alias("ids"), get("length").alias("lengths"), get("doc_id").alias("doc_ids"), "n_tokens", "cost")
