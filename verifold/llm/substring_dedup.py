"""Substring dedup with difference-cover anchors.

A set D of residues modulo v is a difference cover if any two positions i, j can be moved by one
common shift below v so that both residues are in D. So if two documents share a run of
``width`` words, then some window of ``width - v + 1`` words of that run starts at a cover
position in both. Step one hashes windows at cover positions only and finds the anchors that two
documents or more hold. Step two extends: only the ``width``-word windows around a shared anchor
are keyed in full, and the smallest doc_id of each key decides.

Keys are 64-bit hashes; two different windows meet with probability 2**-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm import blocks as B
from verifold.llm.storage import save
from verifold.llm.words import hashes_of, window_hashes, window_starts, words_of

#: Perfect difference sets, each residue difference occurs once.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
FAR = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def difference_cover(period: int) -> np.ndarray:
    """A perfect difference set where one is listed, else 0..r-1 and the multiples of r, r*r >= period."""
    if period in COVERS:
        return np.array(COVERS[period])
    r = max(1, int(np.ceil(np.sqrt(period))))
    return np.array(sorted({*range(min(r, period)), *range(0, period, r)}))


class _Windows:
    """Word windows of the documents of one block that have a doc_id."""

    def __init__(self, docs: pa.Table, width: int, period: int):
        self.width, self.anchor = width, width - period + 1
        self.words = words_of(B.column(docs, "text"))
        ids = B.column(docs, "doc_id")
        self.named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, FAR).to_numpy(zero_copy_only=False)
        starts = self.words.starts
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        self.hashed = hashes_of(self.words.vocabulary)[self.words.ids] if len(self.words.ids) else np.zeros(0, np.uint64)
        inside = window_starts(starts, self.anchor)
        place = np.arange(len(inside)) - starts[self.owner[: len(inside)]]
        cover = np.zeros(period, dtype=bool)
        cover[difference_cover(period)] = True
        self.at = np.flatnonzero(inside & cover[place % period] & self.named[self.owner[: len(inside)]])
        self.anchors = window_hashes(self.hashed, self.anchor)[self.at]

    def keyed(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, the index of each window's key, and each key's smallest and largest doc_id."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids = self.ids[self.owner[at]]
        low, high = np.full(len(keys), FAR), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, ids)
        np.maximum.at(high, back, ids)
        return keys, back, low, high

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold a shared anchor; shared is for each anchor."""
        n = len(self.hashed)
        edge = np.zeros(n + 1, dtype=np.int32)
        hits = self.at[shared]
        np.add.at(edge, np.maximum(hits - (self.width - self.anchor), 0), 1)
        np.add.at(edge, hits + 1, -1)
        inside = window_starts(self.words.starts, self.width)
        return np.flatnonzero(inside & (np.cumsum(edge)[: len(inside)] > 0))

    def shared(self, answers: dict) -> np.ndarray:
        keys, back = np.unique(self.anchors, return_inverse=True)
        (found,) = B.reply_of(answers.get("anchors", []), [np.uint8])
        return found.astype(bool)[back] if len(keys) else np.zeros(0, dtype=bool)


def remove_repeats(docs: DataFrame, width: int = 50, period: int = 31) -> DataFrame:
    """Remove words covered by a ``width``-word window that also starts in a document with a smaller doc_id.

    Needs columns doc_id and text; others are ignored. Null text counts as empty. A document
    without doc_id is neither smaller nor larger than another: it stays whole and removes nothing.
    Repeats inside one document, or between rows of the same doc_id, stay. Texts of fewer than
    ``width`` words stay whole. Returns one row per input row: doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and kept_sha256.
    """
    if not 1 <= period <= width:
        raise ValueError("period must be from 1 to width")
    stored = save(B.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), "blocks")
    parts = B.parts_for(stored.df, len(difference_cover(period)) / period / 6)

    def anchors(table: pa.Table):
        x = _Windows(table, width, period)
        keys, _, low, high = x.keyed(x.anchors, x.at)
        return keys, [low, high]

    def in_two(starts, order, values):
        low, high = (v[order] for v in values)
        return [(np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts)).astype(np.uint8)]

    first = save(B.merge(B.ask(stored.df, anchors, parts), [np.int64, np.int64], in_two).select(F.lit("anchors").alias("name"), "part", "block", "vals"), "anchors")

    def extended(block: int, table: pa.Table, answers: dict):
        x = _Windows(table, width, period)
        at = x.candidates(x.shared(answers))
        keys, _, low, _ = x.keyed(window_hashes(x.hashed, width)[at], at)
        return B.request_rows(block, keys, [low], parts)

    def smallest(starts, order, values):
        return [np.minimum.reduceat(values[0][order], starts)]

    asked = B.cogroup(stored.df, first.df, extended, B.REQUEST_SCHEMA)
    second = save(B.merge(asked, [np.int64], smallest).select(F.lit("windows").alias("name"), "part", "block", "vals"), "windows")

    def cut(block: int, table: pa.Table, answers: dict):
        x = _Windows(table, width, period)
        at = x.candidates(x.shared(answers))
        keys, back = np.unique(window_hashes(x.hashed, width)[at], return_inverse=True)
        (least,) = B.reply_of(answers.get("windows", []), [np.int64])
        hit = at[least[back] < x.ids[x.owner[at]]] if len(keys) else at
        edge = np.zeros(len(x.hashed) + 1, dtype=np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept = x.words.vocabulary.take(pa.array(x.words.ids[~gone])).cast(pa.string())
        removed = np.bincount(x.owner[gone], minlength=len(x.ids))
        counts = np.diff(x.words.starts)
        cuts = np.concatenate([[0], np.cumsum(counts - removed)])
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), kept), " ")
        return pa.table({
            "doc_id": B.column(table, "doc_id"),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": texts,
            "kept_sha256": pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()),
        })

    return B.cogroup(stored.df, first.df.unionByName(second.df), cut, SCHEMA)
