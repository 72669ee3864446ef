"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns report on their own. Weak candidates (logins, short access ids, opaque long tokens,
endpoints) report only where a complementary part stands in the same scope: an interval join of
the candidates with the parts of the other roles. Positions are code points, end exclusive.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verifold.llm.storage import save

#: Stands around matches while they are located; the same character in a text is read as the next one.
MARK, SAME_WIDTH = "\x01", "\x02"


class Pattern(NamedTuple):
    """kind, what part of a credential it is, whether it reports alone, regex, least length of its group or of the match."""

    kind: str
    role: str
    strong: bool
    regex: str
    least: int
    group: int = 0
    hints: tuple[str, ...] = ()


#: Fixed values. hints: a text that holds none of them in lower case can't match.
PATTERNS = (
    Pattern("assign", "secret", True, r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Pattern("access", "identifier", True, r"AKIA[A-Z0-9]{14,}", 18, 0, ("akia",)),
    Pattern("hex", "secret", True, r"[0-9a-f]{16,}", 16),
    Pattern("login", "identifier", False, r"(?:(?i)username|user_id|login|account|client_id|access_key_id)\x20*[:=]\x20*[A-Za-z0-9_.@-]{4,}", 4, 0, ("user", "login", "account", "client_id", "access_key_id")),
    Pattern("short_access", "identifier", False, r"A[KS]IA[A-Z0-9]{8,13}(?![A-Z0-9])", 12, 0, ("akia", "asia")),
    Pattern("opaque", "secret", False, r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}", 32),
    Pattern("endpoint", "endpoint", False, r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>,]+""", 8, 0, ("://",)),
)
#: Which roles complete a weak part of a role.
COMPLETES = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def _marked(text: Column, p: Pattern) -> Column:
    marked = F.regexp_replace(text, F.lit(p.regex), F.lit(f"{MARK}$0{MARK}"))
    if not p.hints:
        return marked
    low = F.lower(text)
    hinted = low.contains(p.hints[0])
    for h in p.hints[1:]:
        hinted |= low.contains(h)
    return F.when(hinted, marked).otherwise(F.lit(""))


def _spans(docs: DataFrame, patterns: tuple[Pattern, ...]) -> DataFrame:
    """row_key, kind, at, to for each match that is long enough; rows of one key are the same text."""
    plain = F.when(F.col("text").contains(MARK), F.translate("text", MARK, SAME_WIDTH)).otherwise(F.col("text"))
    kinds = F.array(*(F.struct(F.lit(p.kind).alias("kind"), _marked(F.col("plain"), p).alias("marked")) for p in patterns))
    found = docs.select("row_key", plain.alias("plain")).select("row_key", F.explode(F.filter(kinds, lambda x: x["marked"].contains(MARK))).alias("x"))
    group = F.lit(None).cast("int")
    for p in patterns:
        if p.group:
            group = F.when(F.col("kind") == p.kind, F.length(F.regexp_extract("piece", p.regex, p.group))).otherwise(group)
    pieces = found.select("row_key", F.col("x.kind").alias("kind"), F.posexplode(F.split("x.marked", MARK)).alias("pos", "piece")).select(
        "row_key", "kind", "pos", F.length("piece").alias("n"), F.when(F.col("pos") % 2 == 1, F.coalesce(group, F.length("piece"))).alias("size"))
    # Repeated rows have equal pieces: one set of them is kept.
    once = pieces.repartition("row_key").dropDuplicates(["row_key", "kind", "pos"])
    end = F.sum("n").over(Window.partitionBy("row_key", "kind").orderBy("pos"))
    enough = F.lit(False)
    for p in patterns:
        enough |= (F.col("kind") == p.kind) & (F.col("size") >= p.least)
    return once.withColumn("to", end).where(enough).select("row_key", "kind", (F.col("to") - F.col("n")).alias("at"), "to")


def _linked(spans: DataFrame, patterns: tuple[Pattern, ...], scope: int) -> DataFrame:
    """Weak candidates that stand apart from base spans and have a complementary part within ``scope``."""
    role, strong = (F.coalesce(*(F.when(F.col("kind") == p.kind, F.lit(getattr(p, x))) for p in patterns)) for x in ("role", "strong"))
    parts = spans.withColumn("role", role).withColumn("strong", strong)
    # A weak candidate over a base span is the same thing again.
    w = Window.partitionBy("row_key").orderBy("at", "to")
    before = F.max(F.when(F.col("strong"), F.col("to"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("strong"), F.col("at"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    parts = parts.withColumn("over", ~F.col("strong") & ((F.coalesce(before, F.lit(0)) > F.col("at")) | (F.coalesce(after, F.col("to")) < F.col("to")))).where("not over")
    parts = parts.withColumn("cell", F.floor(F.col("at") / scope))
    # Of the parts in a cell only the first and last start matter: cells are as wide as the scope.
    ends = parts.groupBy("row_key", "cell", "role").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    needs = F.coalesce(*(F.when(F.col("role") == r, F.array(*map(F.lit, c))) for r, c in COMPLETES.items()))
    asks = parts.where("not strong").select("row_key", "kind", "at", "to", F.explode(needs).alias("role"), "cell").select(
        "row_key", "kind", "at", "to", "role", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"))
    near = (F.col("first") <= F.col("at") + scope) & (F.col("last") >= F.col("at") - scope)
    return asks.join(ends, ["row_key", "cell", "role"]).where(near).select("row_key", "kind", "at", "to").distinct()


def scan_secrets(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, scope: int = 200) -> DataFrame:
    """Spans of secrets in each row's whole text: doc_id, n_<kind> for base kinds, base_sha256, spans.

    Needs columns doc_id and text; others are ignored. Null text counts as empty and has no span.
    spans: kind:start:end of base spans and linked weak candidates, by start, then kind as listed,
    comma-joined; base_sha256: lowercase SHA-256 of the same for base spans alone. A weak candidate
    counts where a part of a complementary role starts at most ``scope`` code points from its start.
    Repeated rows and rows without doc_id each come back with their own result.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_key", key)
    # Written once: base spans, candidates and their partners all come from here.
    spans = save(_spans(rows, patterns), "spans").df
    base = [p.kind for p in patterns if p.strong]
    every = spans.where(F.col("kind").isin(base)).unionByName(_linked(spans, patterns, scope))
    rank = F.coalesce(*(F.when(F.col("kind") == p.kind, F.lit(i)) for i, p in enumerate(patterns)))
    item = F.struct("at", rank.alias("rank"), F.concat_ws(":", "kind", F.col("at").cast("string"), F.col("to").cast("string")).alias("s"))
    join = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    found = every.groupBy("row_key").agg(
        *counts, join(F.collect_list(F.when(F.col("kind").isin(base), item))).alias("base"), join(F.collect_list(item)).alias("spans"))
    return rows.select("doc_id", "row_key").join(found, "row_key", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
