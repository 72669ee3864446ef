"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

Only terms of the items matter, so documents are reduced to these terms first. They are then
gathered into shards of some thousand documents. In a shard the posting list of each term
is clustered by the likeness of its documents (each goes to the pivot of the list whose projected
impacts fit best), and a cluster's documents form blocks. A block keeps the greatest impact of each
term among its documents, in 255 steps of the term's greatest impact in the shard and rounded up. The
weighted sum of these is a bound that no document of the block exceeds: a block is left out only if
its bound is strictly below the last score that an item keeps.

Each shard also keeps the scores of its most promising block for each item. The last of the best
of these over all shards is a score that enough documents reach, so every task starts with it.
Shards are cut by documents, so a common term is spread over all of them, and only the best
documents of each task for each item are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verifold.llm.blocks import packed, unpacked
from verifold.llm.storage import Table, free, save
from verifold.llm.words import split_words, tidy

#: Documents of a shard: so many that a table of documents and terms has CELLS cells, between the two bounds.
CELLS, LEAST_DOCS, MOST_DOCS = 4 << 20, 64, 4096
#: Documents of a block, and the longest list that has no summaries: its documents are scored at once.
BLOCK_DOCS, SHORT_LIST = 64, 16
#: Cells of a shard's summaries at most, so that its row stays small: where the longest lists fill them, all others count as short.
SUMMARY_CELLS = 16 << 20
#: Dimensions of the projection that tells similar documents.
DIMS = 16
#: Bounds of one pass over the documents.
PASS_ITEMS, PASS_BYTES = 1024, 1 << 20
#: What term bytes become: A-Z lower case, all that is no letter or digit of ASCII a space, others stay.
TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
FORWARD_SCHEMA = "doc_id long, n long, terms array<int>, tfs array<int>"
INDEX_SCHEMA = "shard long, n_docs int, columns binary, doc_ids binary, doc_ends binary, doc_terms binary, impacts binary, lists binary, list_ends binary, postings binary, block_ends binary, steps binary, summary binary, seed_items array<int>, seed_scores array<long>"
RESULT_SCHEMA = "item_id long, rank int, doc_id long, score long"
#: Stands for a null doc_id: before all others.
NO_ID = np.iinfo(np.int64).min


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of all texts one after the other, and where each text's terms start."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    clean = data[int(ends[0]) : int(ends[-1])].to_pybytes().translate(TABLE) if data and len(texts) else b""
    return split_words(pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends - ends[:1]), pa.py_buffer(clean)]))


class Items(NamedTuple):
    """A pass's items: their terms as places in the pass's vocabulary, and the weights of these."""

    numbers: list[int]
    terms: list[np.ndarray]
    weights: np.ndarray


def reduced(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (all terms with repeats), and the vocabulary's terms with their numbers, for documents that have a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of PASS_BYTES of item texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                starts, flat = terms_of(part.column("text"))
                coded = flat.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
                n = np.diff(starts)
                owner = np.repeat(np.arange(len(n)), n)[ids >= 0]
                keys, tfs = np.unique(owner * max(1, len(known)) + ids[ids >= 0], return_counts=True)
                ends = np.searchsorted(keys // max(1, len(known)), np.arange(len(n) + 1)).astype(np.int32)
                has = n > 0
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))).filter(pa.array(has))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").filter(pa.array(has)), "n": pa.array(n[has], pa.int64()), "terms": lists(keys % max(1, len(known))), "tfs": lists(tfs)})

    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, FORWARD_SCHEMA)


def statistics(forward: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and each term's documents; each task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            counts[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            counts[size:] += (batch.num_rows, pc.sum(batch.column("n")).as_py() or 0)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "c": pa.array(counts[at], pa.int64())})

    out = np.zeros(size + 2, dtype=np.int64)
    for r in forward.select("n", "terms").mapInArrow(run, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():  # the vocabulary's size
        out[r["term"]] = r["c"]
    return int(out[size]), int(out[size + 1]), out[:size]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts_of(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard(NamedTuple):
    """A shard's documents and blocks.

    columns: terms of the shard, ascending; dense: impacts of documents by column; lists: columns that
    have a posting list, in blocks or (short) without; list_ends: blocks before the end of each list,
    postings: documents in the order of blocks; block_ends: postings before the end of each block;
    summary: greatest impacts of each block by column, in steps of ``steps`` and rounded up; a row for
    each block of a list that is not short.
    """

    columns: np.ndarray
    doc_ids: np.ndarray
    dense: np.ndarray
    list_ends: np.ndarray
    postings: np.ndarray
    block_ends: np.ndarray
    short: np.ndarray
    steps: np.ndarray
    summary: np.ndarray


def cluster(near: np.ndarray, size: int = BLOCK_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Order of a list's documents by cluster, and where each block ends: clusters cut after ``size`` documents. near: projected documents."""
    n = len(near)
    pivots = near[np.linspace(0, n - 1, -(-n // size)).astype(np.int64)]
    own = (near @ pivots.T).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own, minlength=len(pivots))
    starts = np.cumsum(sizes) - sizes
    ends = np.concatenate([np.append(np.arange(s + size, s + c, size), s + c) for s, c in zip(starts.tolist(), sizes.tolist(), strict=True) if c])
    return order, ends


def short_below(sizes: np.ndarray) -> int:
    """Documents of the longest list that gets no summaries; sizes: documents of each list."""
    falling = np.sort(sizes)[::-1]
    cells = np.cumsum(2 * -(-falling // BLOCK_DOCS)) * len(sizes)  # clusters are cut, so a list has twice as many blocks at most
    return max([SHORT_LIST, *falling[np.searchsorted(cells, SUMMARY_CELLS, "right") :][:1].tolist()])


def build_shard(doc_ids: np.ndarray, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, projection: np.ndarray) -> Shard:
    """owner: the document of each posting. projection: a row a term of the vocabulary."""
    columns, local = np.unique(terms, return_inverse=True)
    dense = np.zeros((len(doc_ids), len(columns)), dtype=np.int32)
    dense[owner, local] = impacts
    steps = -(-dense.max(axis=0, initial=0) // 255)
    near = dense.astype(np.float32) @ projection[columns]
    near /= np.linalg.norm(near, axis=1, keepdims=True) + 1e-30
    by_term = np.argsort(local, kind="stable")
    cuts = np.searchsorted(local[by_term], np.arange(len(columns) + 1))
    short_list = short_below(np.diff(cuts))
    postings, block_ends, list_ends, short, summary, before = [], [], [], [], [], 0
    for c in range(len(columns)):
        docs = owner[by_term[cuts[c] : cuts[c + 1]]]
        if len(docs) <= short_list:
            ends = np.array([len(docs)])
        else:
            order, ends = cluster(near[docs])
            docs = docs[order]
            greatest = np.maximum.reduceat(dense[docs], ends - np.diff(ends, prepend=0), axis=0)
            summary.append((-(-greatest // steps)).astype(np.uint8))
        short += [len(docs) <= short_list] * len(ends)
        postings.append(docs)
        block_ends.append(before + ends)
        before += len(docs)
        list_ends.append(len(ends))
    joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return Shard(columns, doc_ids, dense, np.cumsum(list_ends, dtype=np.int64), joined(postings), joined(block_ends), np.array(short, dtype=bool), steps, np.concatenate([np.zeros((0, len(columns)), np.uint8), *summary]))


def stored(s: Shard) -> dict[str, bytes]:
    doc, at = np.nonzero(s.dense)
    small = lambda x: packed(x.astype(np.uint32))
    return {
        "columns": small(s.columns), "doc_ids": packed(s.doc_ids), "doc_ends": small(np.searchsorted(doc, np.arange(len(s.doc_ids)), "right")), "doc_terms": small(at), "impacts": small(s.dense[doc, at]),
        "lists": packed(s.short.astype(np.uint8)), "list_ends": small(s.list_ends), "postings": small(s.postings), "block_ends": small(s.block_ends),
        "steps": small(s.steps), "summary": packed(s.summary.ravel()),
    }


def opened(row: dict[str, bytes]) -> Shard:
    get = lambda c, t=np.uint32: unpacked(row[c], t)
    wide = lambda c: get(c).astype(np.int64)
    columns, doc_ids, short = wide("columns"), get("doc_ids", np.int64), get("lists", np.uint8).astype(bool)
    dense = np.zeros((len(doc_ids), len(columns)), dtype=np.int32)
    dense[np.repeat(np.arange(len(doc_ids)), np.diff(wide("doc_ends"), prepend=0)), wide("doc_terms")] = get("impacts")
    summary = get("summary", np.uint8).reshape(int((~short).sum()), len(columns))
    return Shard(columns, doc_ids, dense, wide("list_ends"), wide("postings"), wide("block_ends"), short, wide("steps"), summary)


class Best:
    """The k best (score, id) of each item so far; scores at least ``floor`` of the item count."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.ones(n, dtype=np.int64) if floor is None else np.maximum(floor, 1)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def last(self, i: int) -> int:
        """What a document must reach."""
        return max(int(self.floor[i]), int(self.scores[i][-1])) if len(self.scores[i]) == self.k else int(self.floor[i])

    def merge(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.last(i)
        if good.any():
            s, d = np.concatenate([self.scores[i], scores[good]]), np.concatenate([self.ids[i], ids[good]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.ids[i] = s[order], d[order]


class Lists(NamedTuple):
    """What a shard has for one item: its columns and weights, blocks with summaries by falling bound, and documents of short lists."""

    columns: np.ndarray
    weights: np.ndarray
    blocks: np.ndarray
    bounds: np.ndarray
    docs: np.ndarray


def lists_of(s: Shard, terms: np.ndarray, weights: np.ndarray, numbers: np.ndarray) -> Lists:
    """numbers: the row in the summary of each block."""
    at = np.searchsorted(s.columns, terms)
    ok = at < len(s.columns)
    ok[ok] = s.columns[at[ok]] == terms[ok]
    at = at[ok]
    w = weights[terms[ok]]
    firsts = np.where(at > 0, s.list_ends[at - 1], 0)
    blocks = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(firsts.tolist(), s.list_ends[at].tolist(), strict=True))])
    long_ = blocks[~s.short[blocks]]
    bounds = s.summary[np.ix_(numbers[long_], at)].astype(np.int64) @ (w * s.steps[at])
    order = np.argsort(-bounds, kind="stable")
    return Lists(at, w, long_[order], bounds[order], docs_of(s, blocks[s.short[blocks]]))


def docs_of(s: Shard, blocks: np.ndarray) -> np.ndarray:
    """Documents of blocks, each once."""
    starts = np.where(blocks > 0, s.block_ends[blocks - 1], 0)
    seen = np.zeros(len(s.doc_ids), dtype=bool)
    for a, b in zip(starts.tolist(), s.block_ends[blocks].tolist(), strict=True):
        seen[s.postings[a:b]] = True
    return np.flatnonzero(seen)


def score(s: Shard, lists: Lists, docs: np.ndarray) -> np.ndarray:
    return s.dense[np.ix_(docs, lists.columns)].astype(np.int64) @ lists.weights


def search_shard(s: Shard, items: Items, best: Best) -> int:
    """Adds the shard's documents to the best of each item. Returns the number of blocks whose documents were scored."""
    visited, numbers = 0, np.cumsum(~s.short) - 1
    for i, terms in enumerate(items.terms):
        found = lists_of(s, terms, items.weights, numbers)
        done = np.zeros(len(s.doc_ids), dtype=bool)
        done[found.docs] = True
        best.merge(i, score(s, found, found.docs), s.doc_ids[found.docs])
        at, step = 0, 2
        while at < len(found.blocks) and found.bounds[at] >= best.last(i):
            # Bounds fall, so all further blocks end the search with this one.
            some = slice(at, min(at + step, int(np.searchsorted(-found.bounds, -best.last(i), "right"))))
            docs = docs_of(s, found.blocks[some])
            docs = docs[~done[docs]]
            done[docs] = True
            best.merge(i, score(s, found, docs), s.doc_ids[docs])
            visited, at, step = visited + some.stop - some.start, some.stop, step * 2
    return visited


def build_index(forward: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> Table:
    """Write the shards of reduced documents."""
    spark = forward.sparkSession
    sent = spark.sparkContext.broadcast(items)
    most = max(LEAST_DOCS, min(MOST_DOCS, CELLS // max(1, len(items.weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        projection = np.random.default_rng(1).normal(size=(len(given.weights), DIMS)).astype(np.float32) * np.sqrt(given.weights + 1.0).astype(np.float32)[:, None]
        number, seeds = TaskContext.get().partitionId() << 32, Best(len(given.terms), k)
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, n, terms, tfs = (pa.concat_arrays(t.column(c).chunks) for c in ("doc_id", "n", "terms", "tfs"))
            counts = np.diff(terms.offsets.to_numpy())
            owner = np.repeat(np.arange(len(counts)), counts)
            tf, flat = (x.flatten().to_numpy().astype(np.int64) for x in (tfs, terms))
            impacts = impacts_of(tf, n.to_numpy()[owner], n_docs, n_terms)
            s = build_shard(pc.fill_null(ids, NO_ID).to_numpy(), owner, flat, impacts, projection)
            numbers, seed_items, seed_scores = np.cumsum(~s.short) - 1, [], []
            for i, terms_ in enumerate(given.terms):
                found = lists_of(s, terms_, given.weights, numbers)
                docs = np.union1d(docs_of(s, found.blocks[:1]), found.docs)
                scores, least = score(s, found, docs), seeds.last(i)
                kept = np.sort(scores[scores >= least])[-k:]
                seeds.merge(i, scores, docs)
                seed_items += [i] * len(kept)
                seed_scores += kept.tolist()
            one = {"shard": number, "n_docs": len(counts), **stored(s), "seed_items": seed_items, "seed_scores": seed_scores}
            return pa.RecordBatch.from_pylist([one], schema=_INDEX_ARROW)

        for batch in tidy(batches):
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, most - size)
                held.append(part)
                size, start = size + part.num_rows, start + part.num_rows
                if size == most:
                    yield shard()
                    held, size, number = [], 0, number + 1
        if held:
            yield shard()

    some = forward.where(F.size("terms") > 0)  # others can't be found
    # Rows are large, so groups of few rows keep both ends of the table small in memory.
    return save(some.mapInArrow(run, INDEX_SCHEMA), "lexical_index", row_group_bytes=16 << 20)


_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("n_docs", pa.int32()), *((c, pa.binary()) for c in ("columns", "doc_ids", "doc_ends", "doc_terms", "impacts", "lists", "list_ends", "postings", "block_ends", "steps", "summary")), ("seed_items", pa.list_(pa.int32())), ("seed_scores", pa.list_(pa.int64()))])


def floors(index: DataFrame, n: int, k: int) -> np.ndarray:
    """A score that k documents reach, by item; 1 where fewer are known. Only the seeds are read."""
    pairs = index.select(F.explode(F.arrays_zip("seed_items", "seed_scores")).alias("x")).select("x.seed_items", "x.seed_scores")
    top = pairs.withColumn("r", F.row_number().over(Window.partitionBy("seed_items").orderBy(F.desc("seed_scores")))).where(F.col("r") <= k)
    out = np.ones(n, dtype=np.int64)
    for r in top.groupBy("seed_items").agg(F.min("seed_scores").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect():  # a row an item of the pass
        out[r["seed_items"]] = r["s"]
    return out


def search_index(index: DataFrame, items: Items, floor: np.ndarray, k: int) -> DataFrame:
    """item (its place in the pass), doc_id and score of its k best documents, with rank."""
    sent = index.sparkSession.sparkContext.broadcast((items, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, least = sent.value
        best = Best(len(given.terms), k, least)
        for batch in tidy(batches):
            for i in range(batch.num_rows):
                search_shard(opened({c: batch.column(c)[i].as_py() for c in batch.schema.names}), given, best)
        item = np.repeat(np.arange(len(best.scores)), list(map(len, best.scores)))
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (best.ids, best.scores))
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "score": pa.array(scores, pa.int64())})

    columns = [f.name for f in index.schema.fields if f.dataType.typeName() == "binary"]
    found = index.select(*columns).mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _passes(items: DataFrame) -> tuple[Table, int]:
    """Items with a number each, and into how many passes they are dealt."""
    rows = save(items.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    n, size = rows.df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return rows, max(1, -(-n // PASS_ITEMS), -(-(size or 0) // PASS_BYTES))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` the k documents with the highest score above 0.

    docs: doc_id and text; items: item_id and text; other columns are left out. Terms are runs of ASCII
    letters and digits and of characters beyond ASCII, A-Z lower-cased. A term's weight and a document's
    share of it are whole numbers, so scores are exact; equal ones are ranked by ascending doc_id, null first.
    Null and empty texts have no term: such documents are not counted, such items find nothing. Repeated
    documents are found as often; repeated items, and those without an id, are searched each by itself.

    Items go through the documents in passes of PASS_BYTES of their text, so the work of a task stays
    bounded for any number of items; a longer item is a pass by itself.
    """
    spark = docs.sparkSession
    given, passes = _passes(items)
    done = []
    for p in range(passes):
        rows = given.df.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == p).orderBy("number").toArrow()
        if not rows.num_rows:
            continue
        starts, flat = terms_of(pa.concat_arrays(rows.column("text").chunks))
        coded = flat.dictionary_encode()
        own = [np.unique(coded.indices.to_numpy()[a:b]).astype(np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        vocabulary = coded.dictionary
        forward = save(reduced(docs, vocabulary), "reduced")
        n_docs, n_terms, df = statistics(forward.df, len(vocabulary))
        weights = np.array([weight(n_docs, x) for x in df.tolist()], dtype=np.int64)
        queries = Items(rows.column("number").to_pylist(), own, weights)
        index = build_index(forward.df, queries, n_docs, max(1, n_terms), k)
        free(spark, forward)
        found = search_index(index.df, queries, floors(index.df, len(own), k), k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(own)), pa.int32()), "item_id": rows.column("item_id")}))
        named = found.join(F.broadcast(names), "item")  # PASS_ITEMS rows or so
        done.append(save(named.select("item_id", "rank", "doc_id", "score"), "ranked"))
        free(spark, index)
    free(spark, given)
    return reduce(DataFrame.unionByName, (t.df for t in done)) if done else empty(spark)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


ORACLE_SQL = r"""WITH src AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM src),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lens AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tot AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM tot) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM lens, tot),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50"""
