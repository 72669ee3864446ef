"""Line operators: a text becomes rows (doc_id, pos, line), and state machines become windows.

Windows are per document, so their size is bounded by one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verifold.functions.dates import SEPARATORS
from verifold.functions.text import collapse, strip, text

#: Lines of no use in vehicle certificates and registry lookups.
CERTIFICATE_NOISE = r"(?i)(DENATRAN|SENATRAN|SEGURADO|DEPARTAMENTO|QR\s*CODE|DPVAT)"
REGISTRY_NOISE = r"(?i)(DENATRAN|SENATRAN|QR\s*CODE|DPVAT|GOVERNO|SECRETARIA)"
#: Fixed value: what a line that opens another block looks like, in upper case.
HEADER = r"^[A-ZÇÃÕÁÉÍÓÚÂÊÎÔÛ\s]{3,}$"
DATE = rf"\d{{1,2}}{SEPARATORS}\d{{1,2}}{SEPARATORS}\d{{2,4}}"


def _by_doc(*keys: str):
    return Window.partitionBy("doc_id", *keys).orderBy("pos")


def lines_of(c: Column | str) -> Column:
    """Array of the trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text(c), r"\R"), strip), lambda x: x != "")


def explode_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, pos, line: trimmed lines that are not blank, numbered from 0 in order."""
    return df.select("doc_id", F.posexplode(lines_of(column)).alias("pos", "line"))


# Look-ups in an array of lines: they stay inside the row of their document, so nothing moves


def first_of(lines: Column, value: Callable[[Column, Column], Column]) -> Column:
    """The first value that is not null; ``value`` gets each line and the next one (null after the last)."""
    return F.get(F.filter(F.transform(lines, lambda x, i: value(x, F.get(lines, i + 1))), lambda v: v.isNotNull()), F.lit(0))


def first_index(lines: Column, hit: Callable[[Column], Column]) -> Column:
    """Place of the first line that fits, from 0, else null."""
    return F.get(F.filter(F.transform(lines, lambda x, i: F.when(hit(x), i)), lambda v: v.isNotNull()), F.lit(0))


def _tail(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^[^:]*:", ""))


def array_value_after(lines: Column, label: str) -> Column:
    """``value_after_label`` of one array of lines."""
    def value(x: Column, below: Column) -> Column:
        after = _tail(x)
        return F.when(F.upper(x).contains(label.upper()), F.when((after != "") & (F.upper(after) != label.upper()), after).otherwise(below))

    return first_of(lines, value)


def array_tabular_value(lines: Column, label: str) -> Column:
    """What stands behind the first line's label, without ' :' at the ends, else the next line; a label in other case gives its whole line."""
    def value(x: Column, below: Column) -> Column:
        after = F.regexp_replace(F.regexp_replace(x, rf"^.*?\Q{label}\E", ""), r"^[ :]+|[ :]+$", "")
        return F.when(F.upper(x).contains(label.upper()), F.when(after != "", after).otherwise(below))

    return first_of(lines, value)


def take_below(lines: Column, n: int, skip: Callable[[Column], Column], take: Callable[[Column], Column]) -> Column:
    """Look at the first n lines: some are skipped, and the first other one is the value if it may be taken; it ends the search either way."""
    first = F.get(F.filter(F.slice(lines, 1, n), lambda x: ~skip(x)), F.lit(0))
    return F.when(take(first), first)


def array_colon_value(lines: Column, label: str) -> Column:
    """``label_colon_value`` of one array of lines."""
    return first_of(lines, lambda x, _: F.when(F.upper(x).contains(label.upper()) & x.contains(":"), _tail(x)))


def array_labelled_match(lines: Column, labels: tuple[str, ...], rx: str, anywhere: bool = True) -> Column:
    """``labelled_match`` of one array of lines."""
    found = lambda x: F.nullif(F.regexp_extract(x, rx, 1), F.lit(""))
    def labelled(x: Column) -> Column:
        return _holds(x, labels)

    tries = [first_of(lines, lambda x, _: F.when(labelled(x), found(x))), first_of(lines, lambda x, below: F.when(labelled(x), found(below)))]
    return F.coalesce(*tries, *([first_of(lines, lambda x, _: found(x))] if anywhere else []))


def array_slice(lines: Column, start: tuple[str, ...], end: tuple[str, ...] = ()) -> Column:
    """``slice_between`` (or ``slice_from`` without end markers) of one array of lines."""
    at = first_index(lines, lambda x: _holds(x, start))
    rest = F.when(at.isNotNull(), F.slice(lines, F.coalesce(at, F.lit(0)) + 2, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    if not end:
        return rest
    stop = first_index(rest, lambda x: _holds(x, end))
    return F.when(stop.isNotNull(), F.slice(rest, F.lit(1), F.coalesce(stop, F.lit(0)))).otherwise(rest)


def array_block_after(lines: Column, *labels: str) -> Column:
    """``block_after`` of one array of lines; the first of the labels that gives a block."""
    def block(label: str) -> Column:
        is_label = lambda x: F.upper(x).contains(label.upper())
        rest = array_slice(lines, (label,))
        stop = first_index(rest, lambda x: ~is_label(x) & F.upper(x).rlike(HEADER))
        kept = F.filter(F.when(stop.isNotNull(), F.slice(rest, F.lit(1), F.coalesce(stop, F.lit(0)))).otherwise(rest), lambda x: ~is_label(x))
        return F.nullif(F.trim(F.array_join(kept, " ")), F.lit(""))

    return F.coalesce(*map(block, labels))


def _holds(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.upper(x).contains(w.upper())
    return out


# Line operators over rows (doc_id, pos, line)


def drop_noise_lines(lines: DataFrame, noise: str = CERTIFICATE_NOISE) -> DataFrame:
    return lines.where(~F.col("line").rlike(noise))


def compact_numbers(c: Column) -> Column:
    """'1. 666, 44' as '1.666,44', and a minus next to its number."""
    out = c
    for _ in range(4):
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"(\d)\.\s+(\d{3})", "$1.$2"), r"(\d),\s+(\d{2})", "$1,$2"), r"(-)\s+(R?\$?\s*\d)", "$1$2")
    # Each step needs a mark with a blank behind it; most lines have none.
    return F.when(c.rlike(r"[.,\-]\s"), out).otherwise(c)


def statement_line(c: Column) -> Column:
    """Numbers joined, text glued to a date split off, single spaces."""
    return collapse(F.regexp_replace(compact_numbers(c), r"(\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2,4})([A-Za-zÀ-ÿ])", "$1 $2"))


def normalize_statement_lines(lines: DataFrame) -> DataFrame:
    """``statement_line`` of each line; blank lines go."""
    return lines.withColumn("line", statement_line(F.col("line"))).where("line <> ''")


def split_on_dates(c: Column) -> Column:
    """A line with two dates or more as one line a date; what stands before the first is lost."""
    parts = F.filter(F.transform(F.split(c, rf"(?<!\d)(?={DATE}(?!\d))"), lambda x: F.trim(x)), lambda x: x.rlike(rf"^{DATE}"))
    # Most lines have no two dates, so nothing is split there.
    return F.when(c.rlike(rf"(?s){DATE}.*?{DATE}") & (F.size(parts) >= 2), parts).otherwise(F.array(c))


def explode_on_dates(lines: DataFrame) -> DataFrame:
    """``split_on_dates`` of each line, numbered again."""
    rows = lines.select("doc_id", "pos", F.posexplode(split_on_dates(F.col("line"))).alias("sub", "line"))
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub")) - 1).cast("int")).select("doc_id", "pos", "line")


def merge_pass_lines(lines: DataFrame) -> DataFrame:
    """Lines of several passes (column pass) over one text: first of each, case and spaces aside, in order."""
    key = F.lower(collapse("line"))
    first = lines.groupBy("doc_id", key.alias("key")).agg(F.min(F.struct("pass", "pos", "line")).alias("x"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def value_after_label(lines: DataFrame, label: str) -> DataFrame:
    """First line with the label: what follows ':' if that is anything else, else the next line.

    A line without ':' gives the whole line unless it is the label alone.
    """
    after = F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    own = F.when((after != "") & (F.lower(after) != label.lower()), after)
    rows = lines.withColumn("value", F.coalesce(own, F.lead("line").over(_by_doc())))
    return rows.where(F.lower("line").contains(label.lower())).groupBy("doc_id").agg(F.min_by("value", "pos").alias("value"))


def tabular_value(lines: DataFrame, label: str) -> DataFrame:
    """First line with the label in any case: what follows the label as written, without ' :', else the next line."""
    after = F.regexp_replace(F.element_at(F.split("line", rf"\Q{label}\E"), -1), r"^[ :]+|[ :]+$", "")
    own = F.when((after != "") & (after != F.col("line")), after)
    rows = lines.withColumn("value", F.coalesce(own, F.lead("line").over(_by_doc())))
    return rows.where(F.lower("line").contains(label.lower())).groupBy("doc_id").agg(F.min_by("value", "pos").alias("value"))


def label_colon_value(lines: DataFrame, label: str) -> DataFrame:
    """First line with label and ':'; the text after the first ':'."""
    value = F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    hit = F.lower("line").contains(label.lower()) & F.col("line").contains(":")
    return lines.where(hit).groupBy("doc_id").agg(F.min_by(value, "pos").alias("value"))


def labelled_match(lines: DataFrame, labels: tuple[str, ...], rx: str, anywhere: bool = True) -> DataFrame:
    """A match on the first labelled line, else on the line after a label, else (anywhere) the first of the text."""
    labelled = F.lit(False)
    for x in labels:
        labelled |= F.upper("line").contains(x.upper())
    here, below = (F.nullif(F.regexp_extract(c, rx, 1), F.lit("")) for c in (F.col("line"), F.lead("line").over(_by_doc())))
    rows = lines.select("doc_id", "pos", labelled.alias("hit"), here.alias("here"), below.alias("below"))
    first = lambda c, when: F.min_by(c, F.when(when & c.isNotNull(), F.col("pos")))
    tries = [first(F.col("here"), F.col("hit")), first(F.col("below"), F.col("hit"))]
    tries += [first(F.col("here"), F.lit(True))] if anywhere else []
    return rows.groupBy("doc_id").agg(F.coalesce(*tries).alias("value"))


def _marker(c: str, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.upper(c).contains(w.upper())
    return out


def slice_between(lines: DataFrame, start: tuple[str, ...], end: tuple[str, ...]) -> DataFrame:
    """Lines after the first start marker and before the first end marker that follows it."""
    seen = F.max(_marker("line", start)).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("seen", F.coalesce(seen, F.lit(False)))
    closed = F.max(F.col("seen") & _marker("line", end)).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("closed", closed).where("seen and not closed").drop("seen", "closed")


def slice_from(lines: DataFrame, start: tuple[str, ...]) -> DataFrame:
    """Lines after the first start marker."""
    seen = F.max(_marker("line", start)).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("seen", F.coalesce(seen, F.lit(False))).where("seen").drop("seen")


def block_after(lines: DataFrame, label: str, header: str = HEADER) -> DataFrame:
    """Lines after the first label line up to the first header-like line, joined by a space."""
    is_label = F.lower("line").contains(label.lower())
    seen = F.coalesce(F.max(is_label).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = lines.withColumn("label_line", is_label).withColumn("seen", seen)
    stop = F.max(F.col("seen") & ~F.col("label_line") & F.upper("line").rlike(header)).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("stop", stop).where("seen and not stop and not label_line")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return kept.groupBy("doc_id").agg(F.array_join(ordered, " ").alias("value"))


def carry_forward_header(lines: DataFrame, header: Column, name: str) -> DataFrame:
    """Adds the last header seen so far. header: a struct on header lines (null inside resets), else null."""
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))


def row_assembly_lookahead(lines: DataFrame, dated: Column, has_amount: Column, noise: Column, rest: Column) -> DataFrame:
    """Adds combined: a dated line without amount takes up to two following lines that are undated, noise left out."""
    w = _by_doc()
    flags = lines.withColumns({"dated": dated, "own": has_amount, "noise": noise, "rest": rest})
    one, two = (F.lead(F.struct("line", "dated", "noise"), i).over(w) for i in (1, 2))
    rows = flags.withColumns({"n1": one, "n2": two})
    open1 = F.col("n1").isNotNull() & ~F.col("n1.dated")
    open2 = open1 & F.col("n2").isNotNull() & ~F.col("n2.dated")
    more = F.concat_ws(" ", F.col("rest"), F.when(open1 & ~F.col("n1.noise"), F.col("n1.line")), F.when(open2 & ~F.col("n2.noise"), F.col("n2.line")))
    return rows.withColumn("combined", F.when(F.col("own"), F.col("rest")).otherwise(F.trim(more))).drop("n1", "n2")


def columnar_zip(lines: DataFrame, section: Column, mode: Column, value: Column) -> DataFrame:
    """doc_id, section and one column a mode: the k-th values of the modes side by side, to the shortest.

    mode: date, description or value, null for other lines.
    """
    rows = lines.select("doc_id", "pos", section.alias("section"), mode.alias("mode"), value.alias("v")).where("mode is not null and v is not null")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "section", "mode").orderBy("pos")))
    wide = numbered.groupBy("doc_id", "section", "k").pivot("mode", ["date", "description", "value"]).agg(F.first("v"))
    return wide.where("date is not null and description is not null and value is not null")


def text_window_before(lines: DataFrame, rx: str, n: int) -> DataFrame:
    """The last n lines before the first line that matches."""
    at = F.min(F.when(F.col("line").rlike(rx), F.col("pos"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("at", at).where((F.col("pos") < F.col("at")) & (F.col("pos") >= F.col("at") - n)).drop("at")


def page_lengths(pages: DataFrame) -> DataFrame:
    """doc_id, page (from 1, in order) and text length. Needs doc_id, pos and text of each page."""
    return pages.select("doc_id", F.row_number().over(_by_doc()).alias("page"), F.length(text("text")).alias("text_len"))


def merge_page_stats(native: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, page and text lengths of two passes; a page that one pass lacks has length 0 there."""
    a = native.select("doc_id", "page", F.length(text("text")).alias("native_len"))
    b = other.select("doc_id", "page", F.length(text("text")).alias("other_len"))
    return a.join(b, ["doc_id", "page"], "full").na.fill(0, ["native_len", "other_len"])
