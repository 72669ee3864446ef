"""Token ids in bit-plane shuffled files.

Documents are dealt to range partitions by their order and encoded there, so each task writes one
ascending run of whole documents. A file row is a chunk: whole documents of about ``CHUNK_IDS``
ids, cut into blocks of ``block_ids``; each block is transposed into byte planes (or bit planes)
and each plane is compressed with zstandard. The chunk index holds documents, lengths and the
first id of each chunk. The container is Parquet, so any store that Spark reaches will do, and
Spark's commit protocol makes lost tasks harmless.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verifold.llm.words import tidy

CHUNK_IDS = 1 << 20
BLOCK_IDS = 1 << 16
#: How many encoded parts of texts a Python worker keeps, and how long they may be.
PIECES, PIECE_CHARS = 1_000_000, 48
#: Marks that are never in one token with a letter or digit before them.
MARKS = ".,;:!?"
CHUNK_SCHEMA = "shard int, chunk int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, block_ids int, mode string, n_planes int, planes array<binary>"


def gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``flat``, which is cut into runs of ``sizes``, one after the other, and the length of each."""
    begins = np.cumsum(sizes) - sizes
    length = sizes[at]
    ends = np.cumsum(length)
    return flat[np.repeat(begins[at] - ends + length, length) + np.arange(ends[-1] if len(at) else 0)], length


def _mask(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False)


def _last(texts: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(texts, -1)


def _after(mark: str, texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(mark, texts.type))


class Encoder:
    """Ids of whole texts by the tokenizers library as it reads the file: a special string gives its id.

    A byte-level tokenizer with the usual pattern starts a new piece at a space that a character
    other than white space follows. So texts are cut there and their distinct pieces into parts; each
    part is encoded once, and its ids are kept for the next texts. Texts where more white space follows a space, texts that
    hold a special string, and tokenizers of another kind, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.tok.get_added_tokens_decoder().values()})
        kind = re.sub(r"\s", "", str(self.tok.pre_tokenizer))
        self.by_piece = self.tok.normalizer is None and kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind
        #: Known parts, their ids one after the other, how many each has, and the turn of its last use.
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.used, self.turn = np.zeros(0, dtype=np.int64), 0
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        #: Whether an id starts with a space or line feed, as the first id of a part does.
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for w, i in vocabulary.items() if w.startswith(("Ġ", "Ċ"))]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts that recur more often than whole pieces, and the piece of each.

        A piece is cut before its first line feed, unless white space stands before that, and before a
        mark at an end after a letter or digit: the tokenizer's pattern cuts there as well.
        """
        owner, place = np.arange(len(pieces)), np.zeros(len(pieces), dtype=np.int64)
        rows = np.flatnonzero(pc.find_substring(pieces, "\n").to_numpy() > 0)
        halves = pc.split_pattern(pieces.take(pa.array(rows)), "\n", max_splits=1).flatten()
        left, right = (halves.take(pa.array(np.arange(i, len(halves), 2))) for i in (0, 1))
        good = ~_mask(pc.utf8_is_space(_last(left)))
        rows, left, right = rows[good], left.filter(pa.array(good)), right.filter(pa.array(good))
        keep = np.ones(len(pieces), dtype=bool)
        keep[rows] = False
        parts = pa.concat_arrays([pieces.filter(pa.array(keep)), left, _after("\n", right)])
        owner, place = np.concatenate([owner[keep], rows, rows]), np.concatenate([place[keep], place[rows], place[rows] + 2])

        last = _last(parts)
        rows = np.flatnonzero(_mask(pc.is_in(last, value_set=pa.array(list(MARKS), last.type))))
        heads = pc.utf8_slice_codeunits(parts.take(pa.array(rows)), 0, -1)
        good = _mask(pc.utf8_is_alnum(_last(heads)))
        rows, heads = rows[good], heads.filter(pa.array(good))
        keep = np.ones(len(parts), dtype=bool)
        keep[rows] = False
        parts = pa.concat_arrays([parts.filter(pa.array(keep)), heads, last.take(pa.array(rows))])
        owner, place = np.concatenate([owner[keep], owner[rows], owner[rows]]), np.concatenate([place[keep], place[rows], place[rows] + 1])
        order = np.argsort(4 * owner + place, kind="stable")
        return parts.take(pa.array(order)), owner[order]

    def _learn(self, new: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The new parts in another order, their ids, and how many each has.

        Parts that open with their only space or line feed are encoded some hundred in one text; the
        ids that open a part tell them apart.
        """
        opening = pc.or_(pc.starts_with(new, " "), pc.starts_with(new, "\n"))
        single = pc.equal(pc.add(pc.count_substring(new, " "), pc.count_substring(new, "\n")), 1)
        plain = pc.and_(pc.and_(opening, single), pc.invert(pc.utf8_is_space(_last(new))))
        many, others = new.filter(plain), new.filter(pc.invert(plain))
        bounds = np.append(np.arange(0, len(many), 500), len(many))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), many), pa.scalar("", many.type)).to_pylist()
        flat, sizes = [np.zeros(0, dtype="<u4")], []
        for a, b, ids in zip(bounds[:-1].tolist(), bounds[1:].tolist(), self._whole(texts), strict=True):
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == b - a and cuts[0] == 0:
                flat.append(ids)
                sizes.extend(np.diff(cuts, append=len(ids)).tolist())
            else:
                each = self._whole(many[a:b].to_pylist())
                flat.extend(each)
                sizes.extend(map(len, each))
        each = self._whole(others.to_pylist())
        return pa.concat_arrays([many, others]), np.concatenate(flat + each), np.array(sizes + list(map(len, each)), dtype=np.int64)

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        parts, owner = self._cut(pieces)
        at = pc.index_in(parts, value_set=self.known)
        absent = _mask(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        unknown = parts.filter(pa.array(absent))
        new, flat, sizes = self._learn(pc.unique(unknown))
        at[absent] = len(self.known) + pc.index_in(unknown, value_set=new).to_numpy().astype(np.int64)
        words, flat, sizes = pa.concat_arrays([self.known, new]), np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        self.turn += 1
        used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
        used[at] = self.turn
        out, length = gather(flat, sizes, at)

        keep = np.ones(len(words), dtype=bool)
        keep[len(self.known) :] = pc.utf8_length(new).to_numpy() <= PIECE_CHARS
        if keep.sum() > PIECES:
            # The parts not used for the longest time go: rare ones, of which there is no end.
            keep[np.argsort(-used, kind="stable")[PIECES // 2 :]] = False
        if not keep.all():
            flat, _ = gather(flat, sizes, np.flatnonzero(keep))
            words, sizes, used = words.filter(pa.array(keep)), sizes[keep], used[keep]
        self.known, self.flat, self.sizes, self.used = words, flat, sizes, used
        return out, np.bincount(owner, weights=length, minlength=len(pieces)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has. No text is null."""
        n = len(texts)
        if not self.by_piece:
            done = self._whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, dtype="<u4"), *done]), np.array(list(map(len, done)), dtype=np.int64)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        pieces = lists.flatten()
        coded = pieces.dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        head = pc.utf8_slice_codeunits(distinct, 0, 1)
        odd = _mask(pc.or_(pc.equal(head, ""), pc.utf8_is_space(head)))
        first = starts[:-1]
        rest = np.ones(len(at), dtype=bool)
        rest[first] = False
        owner = np.repeat(np.arange(n), np.diff(starts))
        whole = np.zeros(n, dtype=bool)
        whole[owner[rest & odd[at]]] = True
        for mark in self.special:
            whole |= _mask(pc.match_substring(texts, mark))
        rest &= ~whole[owner]
        used = np.zeros(len(distinct), dtype=bool)
        used[at[rest]] = True
        # Ids of the used pieces, of those at the starts of texts, and of whole texts: gathered for each place in the texts.
        heads = pieces.take(pa.array(first[~whole])).dictionary_encode()
        flat, sizes = self._ids_of(pa.concat_arrays([_after(" ", distinct.filter(pa.array(used))), heads.dictionary]))
        done = self._whole(texts.filter(pa.array(whole)).to_pylist())
        at = (np.cumsum(used) - 1)[at]
        at[first[~whole]] = used.sum() + heads.indices.to_numpy()
        at[first[whole]] = len(sizes) + np.arange(len(done))
        rest[first] = True
        ids, length = gather(np.concatenate([flat, *done]), np.concatenate([sizes, np.array(list(map(len, done)), dtype=np.int64)]), at[rest])
        return ids, np.bincount(owner[rest], weights=length, minlength=n).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of one block of 32-bit ids, lowest first, each compressed; empty high planes are left out."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    keep = max(1, max((i + 1 for i in range(len(planes)) if planes[i].any()), default=1))
    return [zstandard.compress(p.tobytes(), 3) for p in planes[:keep]]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The block of ``n`` ids again."""
    rows = np.stack([np.frombuffer(zstandard.decompress(p), dtype=np.uint8) for p in planes])
    if mode == "bit":
        bits = np.zeros((32, n), dtype=np.uint8)
        bits[: len(rows)] = np.unpackbits(rows, axis=1, count=n)
        return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()
    raw = np.zeros((n, 4), dtype=np.uint8)
    raw[:, : len(rows)] = rows.T
    return raw.view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, tokenizer: str, order: tuple[Column, ...] = (), end_id: int = 0, mode: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS) -> None:
    """Write all ids of ``docs`` below ``path`` (chunks, shards).

    Needs columns doc_id and text; others are used only by ``order`` (default doc_id ascending,
    nulls first). Ties follow a hash of the text, so that rows of one doc_id can be dealt to several
    tasks. Null text counts as empty; each document gets ``end_id`` appended, so an empty one has
    one id. Repeated rows are written as often.
    """
    if mode not in ("byte", "bit") or block_ids < 1 or block_ids % 8:
        raise ValueError("mode must be byte or bit, block_ids a multiple of 8")
    order = order or (F.col("doc_id"),)
    keyed = docs.select(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by = [*(f"o{i}" for i in range(len(order))), "tie"]
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = encoder(tokenizer), TaskContext.get().partitionId()
        chunk, start, names, held, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blocks = [to_planes(ids[i : i + block_ids], mode) for i in range(0, len(ids), block_ids)]
            most = max(map(len, blocks))
            planes = [p for b in blocks for p in [*b, *[None] * (most - len(b))]]
            one = {"shard": shard, "chunk": chunk, "shard_start": start, "n_ids": size, "doc_ids": list(names), "lengths": list(map(len, held)), "block_ids": block_ids, "mode": mode, "n_planes": most, "planes": planes}
            return pa.RecordBatch.from_pylist([one], schema=_chunk_arrow())

        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 3000):
                part = batch.slice(at, 3000)
                ids, sizes = tok.encode(part.column("text"))
                for doc, own in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    names.append(doc)
                    held.append(np.append(own, end))
                    size += len(held[-1])
                    if size >= chunk_ids:
                        yield close()
                        chunk, start, names, held, size = chunk + 1, start + size, [], [], 0
        if held:
            yield close()

    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    dealt.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    # One row for each shard, however many documents there are; shards follow the order.
    shards = docs.sparkSession.read.parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/shards")


def _chunk_arrow() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", longs), ("lengths", longs), ("block_ids", pa.int32()), ("mode", pa.string()), ("n_planes", pa.int32()), ("planes", pa.list_(pa.binary()))])


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (array of int) if asked for, from the files.

    Chunks hold whole documents, so each is decoded by itself.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                k, size = r["n_planes"], r["block_ids"]
                blocks = [[p for p in r["planes"][j : j + k] if p is not None] for j in range(0, len(r["planes"]), k)]
                flat = np.concatenate([from_planes(b, min(size, r["n_ids"] - j * size), r["mode"]) for j, b in enumerate(blocks)])
                cuts = np.concatenate([[0], np.cumsum(r["lengths"])])
                raw = memoryview(flat.astype("<u4").tobytes())
                out = {
                    "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "start": pa.array(cuts[:-1] + r["shard_start"] + r["first"], pa.int64()),
                    "n_tokens": pa.array(r["lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                }
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    chunks = spark.read.parquet(f"{path}/chunks").withColumnRenamed("shard", "at")
    # As many rows as the write had tasks: small enough to send to every executor.
    shards = F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "first"))
    wanted = chunks.join(shards, F.col("at") == F.col("shard")).select("first", "shard_start", "n_ids", "doc_ids", "lengths", "block_ids", "mode", "n_planes", "planes")
    return wanted.mapInArrow(run, schema)
