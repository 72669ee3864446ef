"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question with other parameters has the
same template. Windows of template words of the documents are joined by hash with those of the
benchmark. Aligned windows then show which value of the item stands for which in the document: a
re-parameterised question maps each value to one value, chance matches don't.

A capital that opens a sentence may be a name or not, so texts have two readings: openings plain,
and openings as names. Each is aligned for itself; windows without such a word are the same in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm.storage import save
from verifold.llm.words import hashes_of, split_words, tidy, window_hashes, window_starts

#: Unit words and number words, lower case.
UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres mg g kg lb lbs oz ton tons gram grams ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds usd eur percent % ° °c °f mph km/h kg/m m/s hz khz mhz w kw v kb mb gb tb".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
_NUM = r"^[-+]?[$€£]?\p{Nd}[\p{Nd}.,:/]*(%|st|nd|rd|th)?$"
_NUM_UNIT = r"^[-+]?[$€£]?\p{Nd}[\p{Nd}.,:/]*\P{Nd}+$"
_UNIT_OF = r"^[-+]?[$€£]?\p{Nd}[\p{Nd}.,:/]*"
_EDGE = r"^[^\p{L}\p{N}$€£%°+-]+|[^\p{L}\p{N}%°]+$"
_ENDS = r'[.!?:]["”]?$'
#: Readings of a window: sentence openings plain, or as names.
PLAIN, NAMED = 1, 2
#: A benchmark of at most this many distinct windows is sent to every executor.
SEND_WINDOWS = 250_000
#: Bounds of the bits of a window's hash that the filter of the documents looks at: at most 16 MB are
#: sent. One window in some hundred passes by chance; beyond half a million windows of the benchmark more do, and the join decides.
LEAST_BITS, MOST_BITS = 16, 27


def cores(words: pa.Array) -> pa.Array:
    """Words without punctuation at the edges."""
    return pc.replace_substring_regex(words, _EDGE, "")


def canonical(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Template word of each word inside a sentence, and at its opening (where a capital is no name)."""
    core = cores(words)
    low = pc.utf8_lower(core)
    fixed = lambda values: pc.is_in(low, pa.array(sorted(values), low.type))
    of_unit = pc.replace_substring_regex(low, _UNIT_OF, "")
    number = pc.or_(pc.or_(pc.match_substring_regex(core, _NUM), fixed(NUMBERS)), pc.and_(pc.match_substring_regex(low, _NUM_UNIT), pc.is_in(of_unit, pa.array(sorted(UNITS), low.type))))
    name = pc.and_(pc.match_substring_regex(core, r"^\p{Lu}"), pc.match_substring_regex(core, r"\p{Ll}"))
    plain = pc.if_else(number, NUMBER, pc.if_else(fixed(UNITS), UNIT, low))
    return pc.if_else(pc.and_(pc.equal(plain, low), name), NAME, plain), plain


def _any_within(marks: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` from ``at`` hold a mark."""
    before = np.concatenate([[0], np.cumsum(marks)])
    return before[at + width] > before[at]


class _Template:
    """Template words of several texts: starts of texts, word hashes, and the surface of placeholders.

    known: template words that matter and their hashes; all others have the hash 0.
    """

    def __init__(self, texts: pa.Array, known: tuple[pa.Array, np.ndarray] | None = None):
        starts, flat = split_words(texts)
        coded = flat.cast(pa.string()).dictionary_encode()
        ids, vocabulary = coded.indices.to_numpy(), coded.dictionary
        rows = len(starts) - 1
        owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(starts))
        opening = np.ones(len(ids), dtype=bool)
        if len(ids):
            opening[1:] = pc.match_substring_regex(vocabulary, _ENDS).to_numpy(zero_copy_only=False)[ids[:-1]]
            opening[starts[:-1][np.diff(starts) > 0]] = True
        names = pa.concat_arrays(canonical(vocabulary))
        if known is None:
            distinct = names.dictionary_encode()
            hashed = hashes_of(distinct.dictionary)[distinct.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
        else:
            place = pc.fill_null(pc.index_in(names, known[0]), len(known[0])).to_numpy(zero_copy_only=False)
            hashed = np.append(known[1], np.uint64(0))[place]
        typed = pc.is_in(names, pa.array([NUMBER, UNIT, NAME])).to_numpy(zero_copy_only=False)
        blank = pc.equal(names, "").to_numpy(zero_copy_only=False)
        at = ids + opening * np.int32(len(vocabulary))
        if blank.any():
            keep = ~blank[at]
            at, ids, owner = at[keep], ids[keep], owner[keep]
        self.owner, self.ids, self.vocabulary = owner, ids, vocabulary
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
        pick = lambda values, at: values[at] if len(at) else values[:0]
        self.words, self.named_words = pick(hashed, at), pick(hashed, ids)
        self.typed, self.named_typed = pick(typed, at), pick(typed, ids)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash and readings of each window inside one text; windows whose readings differ come twice."""
        at = np.flatnonzero(window_starts(self.starts, width))
        differ = _any_within(self.words != self.named_words, at, width)
        plain, named = window_hashes(self.words, width)[at], window_hashes(self.named_words, width)[at[differ]]
        readings = np.concatenate([np.where(differ, PLAIN, PLAIN | NAMED), np.full(len(named), NAMED)]).astype(np.int32)
        return np.concatenate([at, at[differ]]), np.concatenate([plain, named]), readings

    def telling(self, at: np.ndarray, readings: np.ndarray, width: int) -> np.ndarray:
        """Which windows have a word that is no placeholder: the others say nothing."""
        return np.where(readings == NAMED, _any_within(~self.named_typed, at, width), _any_within(~self.typed, at, width))

    def values(self, places: np.ndarray) -> pa.Array:
        """Surface of the words at some places, lower case without edges; each distinct word is looked at once."""
        used, back = np.unique(self.ids[places], return_inverse=True)
        return pc.utf8_lower(cores(self.vocabulary.take(pa.array(used)))).take(pa.array(back))

    def slots(self, at: np.ndarray, readings: np.ndarray, width: int) -> pa.Array:
        """Values of the placeholders of each window."""
        places = at[:, None] + np.arange(width)
        typed = np.where((readings == NAMED)[:, None], self.named_typed[places], self.typed[places])
        ends = np.concatenate([[0], np.cumsum(typed.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), self.values(places[typed]).cast(pa.string()))

    def pattern(self, a: int, b: int) -> list[int]:
        """Placeholders of the words from a to b, renumbered by the first occurrence of their values."""
        seen: dict[str, int] = {}
        return [seen.setdefault(v, len(seen)) for v in self.values(a + np.flatnonzero(self.named_typed[a:b])).to_pylist()]


ITEM_SCHEMA = "item_id long, template long, hash long, readings int, pos int, slots array<string>"
HIT_SCHEMA = "doc_id long, row_key long, hash long, readings int, pos int, slots array<string>"


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Windows of each item with its place, and the hash of its whole template and of which slots are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _Template(batch.column("text"))
            at, hashed, readings = t.windows(width)
            told = t.telling(at, readings, width)
            at, hashed, readings = at[told], hashed[told], readings[told]
            whole = [xxhash.xxh64_intdigest(f"{int(window_hashes(t.words[a:b], b - a)[0])} {t.pattern(a, b)}") if b > a else 0 for a, b in zip(t.starts[:-1].tolist(), t.starts[1:].tolist(), strict=True)]
            owner = t.owner[at]
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column("item_id").take(pa.array(owner)),
                "template": pa.array(np.array(whole, dtype=np.uint64)[owner].view(np.int64)),
                "hash": pa.array(hashed.view(np.int64)),
                "readings": pa.array(readings),
                "pos": pa.array((at - t.starts[owner]).astype(np.int32)),
                "slots": t.slots(at, readings, width),
            })

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ITEM_SCHEMA)


def hash_filter(index: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bit map of the first bits of the items' hashes, and how many bits; made in pieces on the executors."""
    bits = min(MOST_BITS, max(LEAST_BITS, (256 * n).bit_length()))

    def piece(rows: pa.Table) -> pa.Table:
        held = np.zeros(1 << 13, dtype=bool)
        held[rows.column("b").to_numpy() & 0x1FFF] = True
        return pa.table({"piece": pa.array([int(rows.column("b")[0].as_py()) >> 13], pa.int32()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    marked = index.select(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("b")).distinct()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in marked.groupBy(F.shiftright("b", 13).alias("p")).applyInArrow(piece, "piece int, held binary").collect():  # 2 ** MOST_BITS bits at most
        out[r["piece"] << 10 : (r["piece"] + 1) << 10] = np.frombuffer(r["held"], dtype=np.uint8)
    return out, bits


def _document_windows(docs: DataFrame, width: int, passes: np.ndarray, bits: int, words: list[str] | None) -> DataFrame:
    """Windows of documents that pass the filter of the items' hashes. words: the items' template words, if they are few."""
    known = None if words is None else (pa.array(words, pa.string()), hashes_of(pa.array(words, pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for start in range(0, batch.num_rows, 3000):
                part = batch.slice(start, 3000)
                t = _Template(part.column("text"), known)
                at, hashed, readings = t.windows(width)
                place = (hashed >> np.uint64(64 - bits)).astype(np.int64)
                hit = (passes[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                at, hashed, readings = at[hit], hashed[hit], readings[hit]
                owner = t.owner[at]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(owner)),
                    "row_key": part.column("row_key").take(pa.array(owner)),
                    "hash": pa.array(hashed.view(np.int64)),
                    "readings": pa.array(readings),
                    "pos": pa.array((at - t.starts[owner]).astype(np.int32)),
                    "slots": t.slots(at, readings, width),
                })

    return docs.mapInArrow(run, HIT_SCHEMA)


def item_words(items: DataFrame) -> DataFrame:
    """Distinct template words of the items: word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat = split_words(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"word": pc.unique(pa.concat_arrays(canonical(flat.cast(pa.string()))))})

    return items.select(F.col("text").cast("string")).mapInArrow(run, "word string").where("word <> ''").distinct()


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, coverage: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters.

    docs: doc_id, text; items: item_id, text; other columns are ignored. One row for each
    (doc_id, row_key, item): row_key is a hash of the text, item_id the smallest of the items with
    that template and the same slots equal, n_windows and n_found the item's windows that hold a word besides placeholders and those of them found at aligned places with
    consistent slots in the reading that has more, coverage their share, verbatim whether all slots
    are equal too. A pair is returned if coverage reaches ``coverage``. Null and empty texts, and items of fewer than
    ``width`` template words or of placeholders only, match nothing. Repeated rows give equal rows once.
    """
    listed = save(item_windows(items, width), "items").df
    # Items with one template and equality pattern of slots are one entry: re-parameterised items
    # don't multiply the matches, and a document is consistent with all of them or none.
    first = listed.groupBy("template").agg(F.min("item_id").alias("item_id"))
    sizes = listed.groupBy("template", "item_id").agg(F.count_distinct("pos").cast("int").alias("n_windows"))
    index = save(listed.join(first, ["template", "item_id"]).join(sizes, ["template", "item_id"]).dropDuplicates(["template", "pos", "readings"]).select("item_id", "n_windows", "hash", F.col("readings").alias("item_readings"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")), "index").df
    n_index = index.count()
    passes, bits = hash_filter(index, n_index)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("row_key"))
    few = n_index <= SEND_WINDOWS
    # A benchmark of few windows has few words: they go to every task, other words can't be in a match.
    words = [r["word"] for r in item_words(items).limit(SEND_WINDOWS + 1).collect()] if few else None
    hits = save(_document_windows(rows, width, passes, bits, words if few and len(words) <= SEND_WINDOWS else None), "hits").df
    shared = F.col("item_readings").bitwiseAND(F.col("readings"))
    either = F.filter(F.array(F.lit(PLAIN), F.lit(NAMED)), lambda r: shared.bitwiseAND(r) != 0)
    found = hits.join(F.broadcast(index) if few else index, "hash").withColumn("reading", F.explode(either))
    # One alignment of a document and an item: windows of one reading at the same distance.
    value = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    key = ["doc_id", "row_key", "item_id"]
    aligned = found.groupBy(*key, "n_windows", "reading", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(value))).alias("pairs"))
    item_values = F.array_distinct(F.transform("pairs", lambda x: x["i"]))
    aligned = aligned.withColumn("consistent", F.size(item_values) == F.size("pairs")).withColumn("same", F.forall("pairs", lambda x: x["i"].eqNullSafe(x["d"])))
    total = aligned.where("consistent").groupBy(*key, "n_windows", "reading").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_found"), F.bool_and("same").alias("verbatim"))
    total = total.groupBy(*key, "n_windows").agg(F.max(F.struct("n_found", "verbatim")).alias("most")).select(*key, "n_windows", "most.*")
    return total.select(*key, "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"), "verbatim").where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, coverage: float = 0.5) -> DataFrame:
    """Rows of ``docs`` without those that ``contaminated`` finds; columns as they were."""
    bad = contaminated(docs, items, width, coverage).select(F.col("doc_id").alias("bad_doc_id"), F.col("row_key").alias("bad_row_key")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(bad["bad_row_key"])
    return docs.join(bad, match, "left_anti")

