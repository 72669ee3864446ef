"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of equal size. Block k of a source of weight w may stand no
earlier than slot floor(k / w) and must stand before slot ceil((k + 1) / w); earliest deadline
first then keeps every prefix within one block of the target. Weights are exact whole numbers over
their sum, never rounded to slots.

The schedule is computed in stretches, each for itself. At the end of a stretch, slot T, a source
has floor(w T) blocks or one more; those with one more are, as many as the sum T asks for, the ones
whose begun block has the earliest deadline. From that state on all deadlines can be met (blocks due
by any t are no more than the slots up to t, as the begun blocks left open are the least urgent
ones), and up to it too, so stretches fit together without a common pass.

Prefix sums of the documents' sizes are taken in two levels, inside hash buckets and over their
totals, so no source goes through one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verifold.llm.storage import save

BLOCK_CHARS = 1 << 18
#: Characters that one bucket of all sources holds about, and the least number of buckets.
BUCKET_CHARS, LEAST_BUCKETS = 1 << 22, 64
#: Slots of a stretch: at least this many, and at least four for each source.
STRETCH = 1 << 16
#: Weights that follow from sizes are multiples of this part of one.
UNIT = 1 << 20
PLAN_SCHEMA = "mix_source string, mix_block long, mix_slot long"


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Positive weights as whole numbers in the same proportions; nothing is rounded."""
    if any(w < 0 for w in weights.values()) or (weights and not any(weights.values())):
        raise ValueError("weights must be 0 or more, and one above 0")
    use = {s: Fraction(w) for s, w in weights.items() if w > 0}
    whole = lcm(*(f.denominator for f in use.values()))
    return {s: int(f * whole) for s, f in use.items()}


def state(parts: list[int], total: int, at: int) -> list[int]:
    """Blocks of each source before slot ``at``; parts / total are the weights."""
    done = [p * at // total for p in parts]
    begun = sorted((-(-(k + 1) * total // p), i) for i, (p, k) in enumerate(zip(parts, done, strict=True)) if p * at % total)
    for _, i in begun[: at - sum(done)]:
        done[i] += 1
    return done


def schedule(parts: list[int], total: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot from ``first`` to before ``last``: released blocks, earliest deadline first."""
    done, goal = state(parts, total, first), state(parts, total, last)
    deadline = lambda i: min(last, -(-(done[i] + 1) * total // parts[i]))
    waiting = [(done[i] * total // parts[i], i) for i in range(len(parts)) if done[i] < goal[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(first, last):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (deadline(i), i))
        i = heapq.heappop(ready)[1]
        yield i, done[i]
        done[i] += 1
        if done[i] < goal[i]:
            heapq.heappush(waiting, (done[i] * total // parts[i], i))


def planned(sources: DataFrame, total: int, stretch: int) -> DataFrame:
    """mix_source, mix_block, mix_slot of every block there is.

    sources: mix_source, part (a whole number as string), blocks. A task holds one stretch and a row for
    each source. Where only one source has blocks left, each stands at its release.
    """
    spark = sources.sparkSession
    end = F.col("blocks") / F.col("part").cast("double")
    count, = sources.agg(F.count("*")).first()
    longest = sources.orderBy(end.desc(), "mix_source").limit(2).collect()
    if not longest:
        return spark.createDataFrame([], PLAN_SCHEMA)
    stretch = max(stretch, 4 * count)
    need = -(-longest[-1]["blocks"] * total // int(longest[-1]["part"])) if len(longest) > 1 else 0
    stretches = -(-need // stretch)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mix_source")
        at = int(rows["at"].iloc[0])
        names, blocks = rows["mix_source"].tolist(), rows["blocks"].tolist()
        found = [(names[i], k, t) for t, (i, k) in enumerate(schedule([int(p) for p in rows["part"]], total, at * stretch, (at + 1) * stretch), at * stretch) if k < blocks[i]]
        return pd.DataFrame(found, columns=["mix_source", "mix_block", "mix_slot"])

    dealt = sources.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stretches - 1).cast("long")))) if stretches else sources.withColumn("at", F.lit(0).cast("long")).limit(0)
    plan = save(dealt.groupBy("at").applyInPandas(run, PLAN_SCHEMA), "plan").df
    last, part = longest[0]["mix_source"], int(longest[0]["part"])
    # The block that is begun at the end of the stretches may be done there or not: the plan knows.
    edge = stretches * stretch
    begun = plan.where(F.col("mix_source") == last).agg(F.max("mix_block")).first()[0] if stretches else None
    start = 0 if begun is None else begun + 1

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            slots = [max(k * total // part, edge + k - start) for k in rows["id"].tolist()]
            yield pd.DataFrame({"mix_source": last, "mix_block": rows["id"], "mix_slot": slots})

    return plan.unionByName(spark.range(start, max(start, longest[0]["blocks"])).mapInPandas(rest, PLAN_SCHEMA))


MADE = ("mix_block", "mix_slot", "mix_offset", "mix_rank", "mix_source", "mix_size", "mix_hash", "mix_bucket", "mix_before", "mix_first", "mix_slots")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, block_chars: int = BLOCK_CHARS, stretch: int = STRETCH) -> DataFrame:
    """All rows of ``docs`` with mix_block, mix_slot, mix_offset and mix_rank; their order is (mix_slot, source, mix_offset).

    Needs columns doc_id, text and source; all columns are kept, but earlier mix_* ones are
    replaced. Null source is a source named ''. weights: of each source; None: the source's
    characters to the power ``exponent``, as multiples of 1 / UNIT. Rows of sources without a positive
    weight keep null slot and rank and come last. No row is dropped: after a source is used up its
    slots stay empty. mix_rank: the row's block among all blocks with a slot, as a part of one. A
    row's size is its characters plus one, so null and empty texts have a place. Within a source,
    order is by a hash of doc_id and text; equal rows stand side by side.
    """
    return _mix(docs, weights, exponent, block_chars, stretch)[0]


def _mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, block_chars: int = BLOCK_CHARS, stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """``mix``, and the characters of all rows."""
    spark = docs.sparkSession
    rows = docs.drop(*MADE)
    names = rows.columns
    rows = rows.withColumns({"mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "mix_size": (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long"), "mix_hash": F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))})
    total = rows.agg(F.sum("mix_size")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_CHARS))
    rows = rows.withColumn("mix_bucket", F.pmod(F.shiftrightunsigned("mix_hash", 8), F.lit(buckets)))
    sums = save(rows.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("n")), "sums").df
    sizes = sums.groupBy("mix_source").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_chars))
    if weights is None:
        part = (F.pow(F.col("n").cast("double"), F.lit(exponent)) * UNIT).cast("decimal(38,0)")
        parts = sizes.withColumn("part", F.greatest(part, F.lit(1).cast("decimal(38,0)")))
        parts = save(parts.select("mix_source", "part", "blocks"), "parts").df
        whole = int(parts.agg(F.sum("part")).first()[0] or 0)
        parts = parts.withColumn("part", F.col("part").cast("string"))
    else:
        whole_parts = exact(weights)
        whole = sum(whole_parts.values())
        # As many rows as the caller named sources; those without rows keep their share of the slots.
        given = spark.createDataFrame([(s, str(p)) for s, p in whole_parts.items()], "mix_source string, part string")
        parts = given.join(sizes, "mix_source", "left").select("mix_source", "part", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    ranked = _ranked(planned(parts, whole, stretch), stretch)
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("mix_before", F.coalesce(before, F.lit(0))).withColumn("mix_first", F.floor(F.col("mix_before") / block_chars))
    # The slots of the few blocks that a bucket of a source touches.
    touched = offsets.withColumn("mix_block", F.explode(F.sequence("mix_first", F.floor((F.col("mix_before") + F.col("n") - 1) / block_chars))))
    listed = touched.join(ranked, ["mix_source", "mix_block"], "left").groupBy("mix_source", "mix_bucket", "mix_before", "mix_first").agg(
        F.sort_array(F.collect_list(F.struct("mix_block", "mix_slot", "mix_rank"))).alias("mix_slots"))
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("mix_offset", F.sum("mix_size").over(inside) - F.col("mix_size")).join(listed, ["mix_source", "mix_bucket"])
    placed = placed.withColumn("mix_offset", F.col("mix_offset") + F.col("mix_before")).withColumn("mix_block", F.floor(F.col("mix_offset") / block_chars))
    own = F.element_at("mix_slots", (F.col("mix_block") - F.col("mix_first") + 1).cast("int"))
    return placed.select(*names, "mix_block", own["mix_slot"].alias("mix_slot"), "mix_offset", own["mix_rank"].alias("mix_rank")), total


def _ranked(plan: DataFrame, stretch: int) -> DataFrame:
    """The plan with mix_rank: how many blocks stand before, as a part of one, in two levels over runs of slots."""
    runs = plan.withColumn("run", F.floor(F.col("mix_slot") / stretch))
    sums = runs.groupBy("run").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    before = sums.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"), total.alias("total"))  # one row a run
    inside = F.row_number().over(Window.partitionBy("run").orderBy("mix_slot")) - 1
    return runs.withColumn("inside", inside).join(before, "run").select("mix_source", "mix_block", "mix_slot", ((F.col("before") + F.col("inside")) / F.col("total")).alias("mix_rank"))


def order() -> tuple:
    """Sort columns of mixed rows: by slot, rows without a slot last."""
    return F.col("mix_slot").isNull().cast("int"), F.coalesce("mix_slot", F.lit(0)), F.coalesce("source", F.lit("")), F.col("mix_offset")


def mix_in_order(docs: DataFrame, chars: int = 1 << 27, **options) -> DataFrame:
    """``mix``, with the rows dealt to partitions of about ``chars`` characters in the order of the mix, and sorted in them.

    The place of a row's block among all blocks is known, so each row moves once to its partition,
    and nothing is sampled. Rows without a slot are dealt by their blocks to partitions behind the others.
    """
    mixed, total = _mix(docs, **options)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chars))
    rest = F.lit(n) + F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), "mix_block"), F.lit(n))
    at = F.coalesce(F.least(F.floor(F.col("mix_rank") * n), F.lit(n - 1)), rest if options.get("weights") is not None else F.lit(n - 1))
    return mixed.repartitionById(2 * n if options.get("weights") is not None else n, at.cast("int")).sortWithinPartitions(*order())
