"""Near duplicates by Jaccard similarity of word shingles: SimHash links first, then an exact set join.

The first search is that of simhash.py: fingerprints few bits apart, each link checked by its sets. At a
similarity of 0.8 texts differ in about ten of 64 bits, beyond what a grid of segments can search, so
the links that are left come from prefixes. All shingles have one order, rare ones first; two sets
that reach the similarity ``t`` share one of their first n - ceil(t n) + 1 shingles. Sets with such a
shingle in common share a bucket. The place of the first common shingle in both bounds their overlap,
so most pairs of a bucket need no look at their sets, and members that no partner can suit leave it.
Members of a bucket are compared with its first ones, those with fewest rare shingles, then with the
next ones, four times as many in each round, until all that are left in it are of one component: no
pair is skipped unless links join it already.

A common shingle's bucket is dealt in parts of about a thousand members, by the level of the shingle;
what is compared with it goes to all its parts, so that no bucket is one task's.

Any order gives the same result. Which shingles are common is counted on one distinct set in SAMPLE,
so that the large groups go to the end of the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verifold.llm import components, simhash
from verifold.llm.storage import Table, free, fresh, save
from verifold.llm.words import hashes_of, split_words, tidy, window_hashes

SEED = 42
#: One distinct set in SAMPLE is counted for the order; bounds of the bits of a shingle that the table of levels knows.
SAMPLE, LEAST_BITS, MOST_BITS = 16, 16, 24
#: Buckets of shingles above this level (about 2 ** level * SAMPLE sets hold one) are dealt in parts; below FEW compared members a bucket takes them in order, then by parts.
PART_LEVEL, FEW = 6, 256
#: The part of its bucket that a member is in; spread is the binary logarithm of how many there are.
PART = "pmod(xxhash64(fp), shiftleft(1L, cast(spread as int)))"
SET_SCHEMA = "doc_id long, key_a long, key_b long, fp long, sim long, n int, sampled array<long>"


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text.

    Words are runs without ASCII white space after A-Z became a-z; fewer than ``shingle`` words make
    one shingle, no word or null text none.
    """
    starts, flat = split_words(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    values = hashes_of(coded.dictionary, SEED)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    hashed = window_hashes(values, shingle)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        mine = hashed[a : b - shingle + 1] if b - a >= shingle else window_hashes(values[a:b], b - a) if b > a else values[:0]
        out.append(np.unique(mine))
    return out


def _name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def marked_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, two hashes of the row, its shingle set by hash, fingerprint and size, and the set itself if it is in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("text"), shingle)
                names = [_name(s) for s in sets]
                power = np.uint64(1) << np.arange(64, dtype=np.uint64)
                sims = [int((power * (2 * simhash.document_bits(s) > len(s))).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("doc_id", "key_a", "key_b")} | {
                    "fp": _signed(names), "sim": _signed(sims), "n": pa.array([len(s) for s in sets], pa.int32()),
                    "sampled": pa.array([s.view(np.int64) if x % SAMPLE == 0 else None for x, s in zip(names, sets, strict=True)], pa.list_(pa.int64())),
                })

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.select("*", F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text").alias("key_b"))
    return rows.mapInArrow(run, SET_SCHEMA)


def _cells(values: DataFrame, cell: str, level: str, bits: int) -> np.ndarray:
    """A table of bytes, 2 ** bits long, with the largest level of each cell; made in pieces on the executors."""

    def piece(rows: pa.Table) -> pa.Table:
        held, at = np.zeros(1 << 13, dtype=np.uint8), rows.column("cell").to_numpy()
        np.maximum.at(held, at & 0x1FFF, rows.column("level").to_numpy().astype(np.uint8))
        return pa.table({"piece": pa.array([int(at[0]) >> 13], pa.int32()), "held": pa.array([held.tobytes()], pa.binary())})

    out = np.zeros(1 << bits, dtype=np.uint8)
    marked = values.groupBy(F.col(cell).alias("cell")).agg(F.max(level).cast("int").alias("level"))
    for r in marked.groupBy(F.shiftright("cell", 13).alias("p")).applyInArrow(piece, "piece int, held binary").collect():  # 2 ** MOST_BITS bytes at most
        out[r["piece"] << 13 : (r["piece"] + 1) << 13] = np.frombuffer(r["held"], dtype=np.uint8)
    return out


def _levels(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How common shingles are: the level of each cell of their first bits, and how many bits."""
    counts = distinct.select(F.explode("sampled").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    counts = save(counts.select("s", F.ceil(F.log2("c")).cast("int").alias("level")), "common")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * counts.df.count()).bit_length()))
    table = _cells(counts.df.withColumn("cell", F.shiftrightunsigned("s", 64 - bits).cast("int")), "cell", "level", bits)
    free(distinct.sparkSession, counts)
    return table, bits


def prefixes(docs: DataFrame, shingle: int, similarity: float, levels: np.ndarray, bits: int) -> DataFrame:
    """fp, n, pos, bucket and spread: the first shingles of each set in the order of (level, hash), once a task for equal sets."""
    whole = PART_LEVEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 500):
                fps, sizes, first, spread = [], [], [], []
                for s in shingle_sets(batch.column("text").slice(at, 500), shingle):
                    x = _name(s)
                    if len(s) and x not in seen:
                        seen.add(x)
                        level = levels[(s >> np.uint64(64 - bits)).astype(np.int64)]
                        order = np.lexsort((s, level))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                        fps.append(x)
                        sizes.append(len(s))
                        first.append(s[order].view(np.int64))
                        over = np.maximum(level[order].astype(np.int8) - whole, 0)
                        spread.append(over if over.any() else None)
                yield pa.RecordBatch.from_pydict({"fp": _signed(fps), "n": pa.array(sizes, pa.int32()), "first": pa.array(first, pa.list_(pa.int64())), "spread": pa.array(spread, pa.list_(pa.int8()))})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "fp long, n int, first array<long>, spread array<byte>")
    placed = rows.select("fp", "n", F.posexplode("first").alias("pos", "bucket"), F.col("spread").alias("spreads"))
    return placed.select("fp", "n", "pos", "bucket", F.coalesce(F.get("spreads", "pos"), F.lit(0).cast("byte")).alias("spread"))


def _sets_of(docs: DataFrame, distinct: DataFrame, needed: DataFrame, shingle: int) -> Table:
    """fp and set (bytes) of the needed sets, from one text each; texts do not move, a filter of their hashes finds them."""
    wanted = save(distinct.join(needed, "fp", "left_semi").select("fp", "key_b"), "wanted")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.df.count()).bit_length()))
    cell = F.shiftrightunsigned("key_b", 64 - bits).cast("int")
    passes = _cells(wanted.df.select(cell.alias("cell"), F.lit(1).alias("level")), "cell", "level", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in tidy(batches):
            keys = batch.column("key_b").to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.flatnonzero(passes[(keys >> np.uint64(64 - bits)).astype(np.int64)])
            texts = batch.column("text")
            for at in range(0, len(hit), 500):
                sets = shingle_sets(texts.take(pa.array(hit[at : at + 500])), shingle)
                names = [_name(s) for s in sets]
                new = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
                yield pa.RecordBatch.from_pydict({"fp": _signed([names[i] for i in new]), "set": pa.array([sets[i].tobytes() for i in new], pa.binary())})

    rows = docs.select(F.col("text").cast("string")).withColumn("key_b", F.xxhash64("text"))
    found = rows.mapInArrow(run, "fp long, set binary").join(wanted.df.select("fp"), "fp", "left_semi")
    done = save(found.groupBy("fp").agg(F.first("set").alias("set")), "sets")
    free(docs.sparkSession, wanted)
    return done


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _simhash_pairs(distinct: DataFrame, distance: int) -> DataFrame:
    """Pairs of sets that SimHash proposes: a forest over the fingerprints at most ``distance`` bits apart."""
    first = save(distinct.groupBy("sim").agg(F.min("fp").alias("rep")), "first").df
    same = distinct.join(first, "sim").where("fp <> rep").select("fp", "rep")
    near = simhash.links(first.select(F.col("sim").alias("fp")), distance).join(first.toDF("a", "rep_a"), "a").join(first.toDF("b", "rep_b"), "b")
    both = near.select(F.col("rep_a").alias("fp"), F.col("rep_b").alias("rep")).unionByName(same)
    return both.select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b")).distinct()


def _open(members: DataFrame, similarity: float) -> DataFrame:
    """Members of buckets with two components or more, without those that no partner in it can suit."""
    share = similarity / (1 + similarity)
    members = members.withColumn("part", F.expr(PART))
    least = members.groupBy("bucket").agg(F.min("n").alias("least_n"), F.max("spread").alias("spread"))
    suits = (F.col("n") - F.col("pos")) / share - F.col("n") >= F.col("least_n") - 1e-9
    left = members.join(_to_parts(least).drop("spread"), ["bucket", "part"]).where(suits).drop("least_n")
    mixed = left.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("mixed"), F.max("spread").alias("spread")).where("mixed")
    return left.join(_to_parts(mixed).select("bucket", "part"), ["bucket", "part"], "left_semi").select("fp", "n", "pos", "bucket", "spread", "root")


def _to_parts(rows: DataFrame) -> DataFrame:
    """Rows of buckets, once for each part of theirs."""
    return rows.withColumn("part", F.explode(F.expr("sequence(0L, shiftleft(1L, cast(spread as int)) - 1)")))


def _pivots(live: DataFrame, turn: int) -> DataFrame:
    """The members of each bucket that all others in it are compared with: the first ``turn``, or some parts of a bucket that has parts."""
    ranked = live.withColumn("part", F.expr(PART)).withColumn("inside", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("pos", "fp"))).where(
        (F.col("inside") <= turn) | (F.col("spread") > 0) & F.lit(turn >= FEW))
    if turn < FEW:
        first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("pos", "fp"))).where(F.col("rank") <= turn)
    else:
        first = ranked.where((F.col("spread") == 0) | (F.col("part") < turn // FEW))
    return first.select("fp", "n", "pos", "bucket", "spread", "root")


def roots_of(docs: DataFrame, marked: DataFrame, similarity: float, shingle: int, distance: int = 4) -> DataFrame:
    """node and root of each shingle set that has a link; all others are components of their own."""
    spark = docs.sparkSession
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    rooted = lambda members, roots: members.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    distinct = save(marked.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("sim").alias("sim"), F.min("key_b").alias("key_b"), F.first("sampled").alias("sampled")), "distinct")
    proposed = save(_simhash_pairs(distinct.df, distance), "proposed")
    needed = proposed.df.select(F.col("a").alias("fp")).unionByName(proposed.df.select(F.col("b").alias("fp"))).distinct()
    sets = _sets_of(docs, distinct.df, needed, shingle)
    links = save(_similar(proposed.df, sets.df, similarity), "links")
    tried = [proposed.df]
    roots = save(components.connected(links.df), "roots").df
    free(spark, sets, links)

    firsts = prefixes(docs, shingle, similarity, *_levels(distinct.df)).withColumn("part", F.expr(PART)).repartition("bucket", "part")
    firsts = firsts.groupBy("bucket", "part", "fp").agg(*(F.first(c).alias(c) for c in ("n", "pos", "spread")))
    # Most buckets have one member: they go before anything is written.
    placed = save(firsts.withColumn("m", F.count("*").over(Window.partitionBy("bucket", "part"))).where("m > 1 or spread > 0").drop("m", "part"), "buckets")
    live = save(_open(rooted(placed.df, roots), similarity), "live")
    free(spark, placed)
    sets = _sets_of(docs, distinct.df, live.df.select("fp").distinct(), shingle)
    free(spark, distinct)
    turn, share = 1, similarity / (1 + similarity)
    while not live.df.isEmpty():
        pivots = save(_pivots(live.df, turn), "pivots")
        first = _to_parts(pivots.df).select("bucket", "part", *(F.col(c).alias(f"c_{c}") for c in ("fp", "n", "pos", "root")))
        near = (F.col("root") != F.col("c_root")) & (F.least(F.col("n") - F.col("pos"), F.col("c_n") - F.col("c_pos")) >= share * (F.col("n") + F.col("c_n")) - 1e-9)
        pairs = live.df.withColumn("part", F.expr(PART)).join(first, ["bucket", "part"]).where(near).select(F.least("fp", "c_fp").alias("a"), F.greatest("fp", "c_fp").alias("b")).distinct()
        pairs = save(pairs.join(union(tried), ["a", "b"], "left_anti"), "pairs").df
        tried.append(pairs)
        links = save(_similar(pairs, sets.df, similarity), "links")
        roots = save(components.connected(roots.toDF("a", "b").unionByName(links.df)), "roots").df
        free(spark, links)
        rest = live.df.join(pivots.df.select("bucket", "fp"), ["bucket", "fp"], "left_anti").drop("root")
        now = save(_open(rooted(rest, roots), similarity), "live")
        free(spark, live, pivots)
        live, turn = now, turn * 4
    free(spark, live, sets)
    return roots


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest doc_id (rows without one come last), then of the smallest text hash.

    Rows are linked if the Jaccard similarity of their shingle sets is ``similarity`` or more; texts
    without a word are copies of each other. Columns as they were; equal rows count once.
    """
    by_row = (F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.xxhash64(F.col("text").cast("string")))
    marked = save(marked_sets(docs, shingle), "marked")
    roots = roots_of(docs, marked.df, similarity, shingle)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key_b", "key_a")
    named = marked.df.groupBy("fp").agg(F.min(rank).alias("rank")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    best = save(named.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rank").alias("best")).select("best.key_a", "best.key_b"), "best").df
    free(docs.sparkSession, marked)
    a, b = (fresh(docs, f"kept_key_{x}") for x in "ab")
    rows = docs.withColumns({a: by_row[0], b: by_row[1]}).dropDuplicates([a, b])
    return rows.join(best.withColumnsRenamed({"key_a": a, "key_b": b}), [a, b], "left_semi").select(docs.columns)
