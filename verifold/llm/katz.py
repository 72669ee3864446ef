"""Katz backoff n-gram model: Good-Turing discounts, exactly normalised backoff weights.

Training and scoring share one set of rounds over blocks of documents (see blocks.py). For every
order the counts of each block's distinct n-grams are summed over the corpus, kept as a table of
key ranges, and the totals go back to the blocks that hold the n-gram. A further round sums, for
each history, the discounted mass of its seen followers and their mass under the next lower
order; these give the backoff weight. Each block then scores its tokens recursively.

Tokens of a document: its words, then one end token. Histories start with a start symbol, which
is never predicted. All words unseen in training are one unknown event, so the probabilities of
the vocabulary, the end and the unknown event sum to one after every history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm import blocks as B
from verifold.llm.storage import Table, save
from verifold.llm.words import hashes_of, mixed, words_of

#: Counts above this are not discounted (Katz 1987 takes 5).
K = 5
#: Fixed keys of the end token and the start symbol.
END, START = np.uint64(0x5D1E3C8F2B7A9461), np.uint64(0x2F6B8E4D1C937A50)
SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factor for a count of 0..K, and 1 for more (index K + 1).

    Good-Turing as by Katz; where the counts of counts give no factor inside (0, 1), the factor is
    (r - 0.5) / r.
    """
    n = [0, *counts_of_counts]
    d = np.ones(K + 2)
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, K + 1)]


class _Tokens:
    """Tokens of a block: each word by its hash, then the end, with start symbols before it."""

    def __init__(self, table: pa.Table, order: int):
        words = words_of(B.column(table, "text"), lower=True)
        keys = np.concatenate([hashes_of(words.vocabulary), [END]]).astype(np.uint64)
        sizes = np.diff(words.starts) + 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.full(self.starts[-1], len(keys) - 1, dtype=np.int64)
        inner = np.ones(len(self.ids), dtype=bool)
        inner[self.starts[1:] - 1] = False
        self.ids[inner] = words.ids
        self.hashed = keys[self.ids]
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.ids)) - self.starts[self.owner]
        self.train = pc.fill_null(B.column(table, "train"), False).to_numpy(zero_copy_only=False)[self.owner]
        #: histories[m]: key of the m tokens before each token; grams[m]: the same with the token.
        self.histories = [np.zeros(len(self.ids), dtype=np.uint64)]
        for m in range(1, order):
            before = np.full(len(self.ids), START, dtype=np.uint64)
            before[m:] = np.where(self.place[m:] >= m, self.hashed[:-m], START)
            self.histories.append(mixed(self.histories[-1] * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(m)))
        self.grams = [mixed(h ^ (x * np.uint64(0xD6E8FEB86659FD93))) if m else self.hashed for m, (h, x) in enumerate(zip(self.histories, [self.hashed] * order, strict=True))]

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each token's place among them, and counts in training."""
        found, back = np.unique(keys, return_inverse=True)
        return found, back, np.bincount(back, weights=self.train, minlength=len(found)).astype(np.int64)


class _Scores:
    """Probabilities of a block's tokens, from the answers so far."""

    def __init__(self, tokens: _Tokens, answers: dict, stats: list[dict]):
        self.t, self.answers, self.stats = tokens, answers, stats

    def total(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each token's gram of m + 1 tokens, and whether this block speaks for it."""
        _, back = np.unique(self.t.grams[m], return_inverse=True)
        rows = self.answers.get(f"count{m}", [])
        count = B.reply_of(rows, [np.int64])[0]
        owner = B.reply_of(rows, [np.int64, np.uint8])[1] if rows and len(rows[0][1]) > 1 else np.zeros(len(count), np.uint8)
        at = np.zeros(len(count), dtype=np.int64)
        at[back[::-1]] = np.arange(len(back))[::-1]
        spoken = np.zeros(len(back), dtype=bool)
        spoken[at[owner.astype(bool)]] = True
        return count[back], spoken

    def unigram(self) -> np.ndarray:
        s = self.stats[0]
        count, _ = self.total(0)
        if not s["unknown"]:
            return np.where(count > 0, count, 1) / (s["total"] + 1)
        return np.where(count > 0, discounted(count, s["d"]) / max(1, s["total"]), s["unknown"])

    def probability(self, m: int) -> np.ndarray:
        """Of each token after the m tokens before it, recursively from the lower order."""
        if m == 0:
            return self.unigram()
        lower = self.probability(m - 1)
        count, _ = self.total(m)
        _, back = np.unique(self.t.histories[m], return_inverse=True)
        whole, alpha = (x[back] for x in B.reply_of(self.answers.get(f"history{m}", []), [np.int64, np.float64]))
        own = discounted(count, self.stats[m]["d"]) / np.maximum(whole, 1)
        return np.where(whole == 0, lower, np.where(count > 0, own, alpha * lower))


def _stats(merged: DataFrame) -> dict:
    """Counts of counts, total and number of distinct grams: a dozen numbers, summed on executors."""
    sums = merged.where("kind = 'stats'").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    n = [0] * (K + 3)
    for r in sums:
        n[r["pos"]] = int(r["n"])
    d = discounts(n[: K + 1])
    total = n[K + 1]
    missing = sum((1 - d[r]) * r * n[r - 1] for r in range(1, K + 1))
    unknown = missing / total if total else 1.0
    return {"d": d, "total": total, "distinct": n[K + 2], "unknown": unknown, "floor": unknown or 1 / (total + 1)}


def _count_table(keys: np.ndarray, totals: list[np.ndarray]) -> list:
    count = totals[0]
    few = np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]
    seen = count > 0
    return [("stats", np.zeros(0, np.uint64), np.array([*few, count.sum(), seen.sum()])), ("table", keys[seen], count[seen])]


def score(docs: DataFrame, order: int = 2) -> tuple[DataFrame, list[Table]]:
    """Train on the rows where column ``train`` is true and score all rows.

    Needs columns doc_id, text and train; others are ignored. Null text counts as empty (its only
    token is the end), null train as false. Repeated rows count and score each for itself. With
    nothing to train on every probability is that of the unknown event, 1.

    Returns one row per input row: doc_id, train, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-one unigram) and score, both log10; and the count tables, one for
    each order, partitioned by kind with a row of sorted keys and counts for each key range.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    stored = save(B.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("train").cast("boolean"))), "blocks")
    parts = B.parts_for(stored.df, 1 / 9)
    replies, stats, tables = None, [], []

    def told(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("kind = 'reply'").select(F.lit(name).alias("name"), "part", "block", "vals")

    for m in range(order):
        def counted(table: pa.Table, m=m):
            t = _Tokens(table, order)
            keys, _, count = t.counts(t.grams[m])
            return keys, [count.astype(np.uint32)]

        def summed(starts, rank, values):
            return [np.add.reduceat(values[0][rank].astype(np.int64), starts)]

        table = save(B.merge(B.ask(stored.df, counted, parts), [np.uint32], summed, _count_table), f"count{m}", ("kind",))
        tables.append(table)
        stats.append(_stats(table.df))
        new = told(table.df, f"count{m}")
        replies = new if replies is None else replies.unionByName(new)
        if m == 0:
            continue

        def followers(block: int, table: pa.Table, answers: dict, m=m, stats=tuple(stats)):
            t = _Tokens(table, order)
            s = _Scores(t, answers, stats)
            count, spoken = s.total(m)
            spoken &= count > 0
            keys, back = np.unique(t.histories[m], return_inverse=True)
            at = back[spoken]
            seen, low = (np.bincount(at, weights=w, minlength=len(keys)) for w in (count[spoken], s.probability(m - 1)[spoken]))
            # Followers seen r times, for the counts that are discounted: small whole numbers, which pack well.
            few = [np.bincount(at[count[spoken] == r], minlength=len(keys)).astype(np.uint32) for r in range(1, K + 1)]
            return B.request_rows(block, keys, [seen.astype(np.int64), low, *few], parts)

        def weighed(starts, rank, values, least=stats[0]["floor"] if m == 1 else 1e-12, d=stats[m]["d"]):
            """Denominator and backoff weight of each history; both 0 if unseen in training."""
            seen, low, *few = (np.add.reduceat(v[rank], starts) for v in values)
            kept = seen - sum((1 - d[r]) * r * n for r, n in enumerate(few, 1))
            # Where no follower is discounted, one count is set aside for the others.
            whole = np.where((seen > 0) & (kept >= seen), seen + 1, seen)
            return [whole, (whole - kept) / np.maximum(whole, 1) / np.maximum(1 - low, least)]

        def weights(keys, totals):
            seen = totals[0] > 0
            return [("table", keys[seen], totals[0][seen], totals[1][seen])]

        table = save(B.merge(B.cogroup(stored.df, replies, followers, B.REQUEST_SCHEMA), [np.int64, np.float64, *[np.uint32] * K], weighed, weights), f"history{m}", ("kind",))
        tables.append(table)
        replies = replies.unionByName(told(table.df, f"history{m}"))

    def scored(block: int, table: pa.Table, answers: dict):
        t = _Tokens(table, order)
        s = _Scores(t, answers, stats)
        count, _ = s.total(0)
        n, v = stats[0]["total"], stats[0]["distinct"]
        docs_n = len(t.starts) - 1
        per_doc = [np.bincount(t.owner, weights=w, minlength=docs_n) for w in (count > 0, np.log10((count + 1) / (n + v + 1)), np.log10(s.probability(order - 1)))]
        return pa.table({
            "doc_id": B.column(table, "doc_id"),
            "train": pc.fill_null(B.column(table, "train"), False),
            "n_tokens": pa.array(np.diff(t.starts), pa.int64()),
            "n_known": pa.array(per_doc[0].astype(np.int64)),
            "train_tokens": pa.array(np.full(docs_n, n), pa.int64()),
            "base_score": pa.array(per_doc[1]),
            "score": pa.array(per_doc[2]),
        })

    # Scoring needs no owner flags: of the answers only the totals move again.
    needed = replies.withColumn("vals", F.expr("slice(vals, 1, size(vals) - 1)"))
    return B.cogroup(stored.df, needed, scored, SCHEMA), tables
