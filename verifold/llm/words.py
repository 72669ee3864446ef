"""Words of Arrow text columns and rolling hashes of word windows, vectorised per batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Fixed odd multipliers of the rolling hash and its finaliser.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def tidy(batches: Iterator) -> Iterator:
    """The same batches; memory that a batch needed goes back to the system, so idle workers stay small."""
    pool = pa.default_memory_pool()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        trim = lambda _: None
    for batch in batches:
        yield batch
        pool.release_unused()
    trim(0)
    pool.release_unused()


class Words(NamedTuple):
    """Words of several documents, one after the other.

    starts: first word of each document, and the end (int64, documents + 1);
    ids: each word as an index of vocabulary (int32); vocabulary: distinct words.
    """

    starts: np.ndarray
    ids: np.ndarray
    vocabulary: pa.Array


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Maximal runs without ASCII white space, flattened, and where each text's words start."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        flat = flat.filter(pa.array(full))
    return starts, flat


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; null counts as empty. lower: A-Z become a-z first."""
    starts, flat = split_words(pc.ascii_lower(texts) if lower else texts)
    coded = flat.dictionary_encode()
    return Words(starts, coded.indices.to_numpy().astype(np.int32), coded.dictionary)


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word's UTF-8 bytes."""
    digest = xxhash.xxh64_intdigest
    values = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter((digest(x, seed) for x in values), dtype=np.uint64, count=len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; values are 64-bit hashes already."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(BASE, len(values)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _powers(pow(BASE, -1, 1 << 64), n))


def window_starts(starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over the windows of the joined documents: true where a window stays in one document."""
    n = int(starts[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return owner[:n] == owner[width - 1 :]
