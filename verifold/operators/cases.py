"""Cases: latest documents, presence, gates, comparisons, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from verifold.functions import dates
from verifold.functions.text import name_jaccard, normalize_doc_id, normalize_name

#: Worst last.
RANK = {"OK": 0, "WARN": 1, "MISSING": 2, "FAIL": 3}
REQUIRED = ("proposal", "licence")


def latest_document(store: DataFrame) -> DataFrame:
    """The row with the greatest file name of each (case_id, doc_type)."""
    rest = [c for c in store.columns if c not in ("case_id", "doc_type")]
    best = store.groupBy("case_id", "doc_type").agg(F.max_by(F.struct(*rest), "file_name").alias("x"))
    return best.select("case_id", "doc_type", "x.*")


def presence_summary(store: DataFrame) -> DataFrame:
    """case_id, doc_type, n_docs and latest file name."""
    return store.groupBy("case_id", "doc_type").agg(F.count("*").alias("n_docs"), F.max("file_name").alias("latest_file"))


def pivot_latest(store: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """One row a case, one column a type with the data of its latest document: one shuffle, no join."""
    one = lambda t: F.max_by("data", F.when(F.col("doc_type") == t, F.col("file_name")))
    return store.groupBy("case_id").agg(*(one(t).alias(t) for t in types), F.collect_set("doc_type").alias("present"))


def gate_status(store: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """PASS for cases that hold every required type, else FAIL."""
    has = F.collect_set(F.when(F.col("doc_type").isin(*required), F.col("doc_type")))
    return store.groupBy("case_id").agg(F.when(F.size(has) == len(required), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("gate"))


def missing_required_docs(store: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """case_id and each required type it lacks."""
    has = F.collect_set(F.when(F.col("doc_type").isin(*required), F.col("doc_type")))
    lacking = store.groupBy("case_id").agg(F.array_except(F.array(*map(F.lit, required)), has).alias("m"))
    return lacking.select("case_id", F.explode("m").alias("missing"))


def present_only(checks: DataFrame, store: DataFrame, doc_type: str) -> DataFrame:
    """Rows of cases that hold the type."""
    return checks.join(store.where(F.col("doc_type") == doc_type).select("case_id"), "case_id", "left_semi")


def first_present_of(store: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """The first of the types that each case holds: case_id, chosen_type."""
    rank = F.lit(None).cast("int")
    for i, t in reversed([*enumerate(priority)]):
        rank = F.when(F.col("doc_type") == t, F.lit(i)).otherwise(rank)
    return store.where(F.col("doc_type").isin(*priority)).groupBy("case_id").agg(F.min_by("doc_type", rank).alias("chosen_type"))


def compare_fields(left: DataFrame, right: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Full outer comparison of two tables by case: one row a field with raw and normalised values and a status.

    fields: name to kind (name, id or date). equal, different, missing (a side is absent or blank) or
    not_comparable (a side can't be normalised).
    """
    norm = {"name": normalize_name, "id": lambda c: F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")), "date": dates.normalize_date_string}
    a, b = (t.select("case_id", F.struct(*fields).alias(n)) for t, n in ((left, "a"), (right, "b")))
    items = []
    for f, kind in fields.items():
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        u, v = norm[kind](x), norm[kind](y)
        blank = F.coalesce(F.trim(x), F.lit("")).eqNullSafe("") | F.coalesce(F.trim(y), F.lit("")).eqNullSafe("")
        status = F.when(blank, F.lit("missing")).when(u.isNull() | v.isNull(), F.lit("not_comparable")).when(u == v, F.lit("equal")).otherwise(F.lit("different"))
        items.append(F.struct(F.lit(f).alias("field"), status.alias("status"), x.alias("left_raw"), u.alias("left_normalized"), y.alias("right_raw"), v.alias("right_normalized")))
    return a.join(b, "case_id", "full").select("case_id", F.inline(F.array(*items)))


def cross_compare_pairs(parties: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of documents of a case (type_a < type_b): same id, same birth date, name similarity and its flag.

    parties: case_id, doc_type, name, doc_number, birth. A case holds a handful of types.
    """
    a, b = (parties.select("case_id", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_type", "name", "doc_number", "birth"))) for s in "ab")
    j = name_jaccard("name_a", "name_b")
    ids = [normalize_doc_id(f"doc_number_{s}") for s in "ab"]
    return a.join(b, "case_id").where("doc_type_a < doc_type_b").select(
        "case_id", "doc_type_a", "doc_type_b", F.when((ids[0] != "") & (ids[1] != ""), ids[0] == ids[1]).alias("same_id"),
        (dates.parse_date("birth_a") == dates.parse_date("birth_b")).alias("same_birth"), j.alias("similarity"), (j < least).alias("names_differ"))


def rank_of(status: Column, unknown: Column | None = None) -> Column:
    out = F.lit(None).cast("int") if unknown is None else unknown
    for k, v in RANK.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANK)), (rank + 1).cast("int"))


def overall_status(cases: DataFrame, checks: DataFrame, strict: bool = False) -> DataFrame:
    """Worst status of each case; no check gives MISSING. An unknown status is an error if strict, else it is left out."""
    rank = rank_of(F.col("status"))
    if strict:
        rank = F.coalesce(rank, F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")))).cast("int"))
    worst = checks.groupBy("case_id").agg(F.max(rank).alias("rank"))
    return cases.select("case_id").join(worst, "case_id", "left").select("case_id", status_of(F.coalesce("rank", F.lit(RANK["MISSING"]))).alias("overall_status"))


def overall_status_lenient(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """As overall_status, but an unknown status is WARN and null or empty is OK."""
    rank = rank_of(F.col("status"), F.when(F.coalesce("status", F.lit("")) == "", F.lit(RANK["OK"])).otherwise(F.lit(RANK["WARN"])))
    worst = checks.groupBy("case_id").agg(F.max(rank).alias("rank"))
    return cases.select("case_id").join(worst, "case_id", "left").select("case_id", status_of(F.coalesce("rank", F.lit(RANK["MISSING"]))).alias("overall_status"))


def _offences(df: DataFrame, bad: Column, value: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    named = F.when(bad, F.coalesce(value.cast("string"), F.lit("null")))
    return df.observe(seen, F.count_if(bad).alias("n"), F.array_sort(F.collect_set(named)).alias("found")), seen


def watched_statuses(checks: DataFrame) -> tuple[DataFrame, Observation]:
    """The same checks, and what an action on them notes in passing: how many statuses are unknown, and which (null is named 'null')."""
    return _offences(checks, rank_of(F.col("status")).isNull(), F.col("status"))


def watched_check_ids(checks: DataFrame) -> tuple[DataFrame, Observation]:
    """duplicate_check_ids, and what an action on them notes: how many there are, and which ids."""
    return _offences(duplicate_check_ids(checks), F.lit(True), F.col("check_id"))


def raise_offences(what: str, seen: Observation) -> None:
    """After the action: an error that names all offending values and their number, if there are any."""
    got = seen.get
    if got["n"]:
        raise ValueError(f"{what}: {got['n']} rows: {', '.join(got['found'])}")


def status_counts(checks: DataFrame) -> DataFrame:
    """Number of checks of each status by case, upper and lower case alike; unknown ones are n_other."""
    s = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    known = [F.count_if(s == k).alias(f"n_{k.lower()}") for k in RANK]
    return checks.groupBy("case_id").agg(*known, F.count_if(~s.isin(*RANK)).alias("n_other"))


def group_checks(checks: DataFrame) -> DataFrame:
    """Check ids of each case and status, in report order."""
    s = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    status = F.when(s.isin(*RANK), s).otherwise(F.lit("OTHER"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "check_id"))), lambda x: x["check_id"])
    return checks.groupBy("case_id", status.alias("status")).agg(ordered.alias("check_ids"))


def missing_docs_summary(checks: DataFrame) -> DataFrame:
    """Distinct missing documents of each case in report order, and proof_of_income where income checks lack any."""
    listed = F.split(F.element_at("evidence", F.lit("missing")), ",")
    no_proof = F.col("check_id").startswith("income.") & (F.coalesce(F.element_at("evidence", F.lit("proof_docs")), F.lit("")) == "")
    names = F.coalesce(listed, F.when(no_proof, F.array(F.lit("proof_of_income"))))
    rows = checks.where("status = 'MISSING'").select("case_id", "seq", F.posexplode(names).alias("at", "name")).where("name <> ''")
    first = rows.groupBy("case_id", "name").agg(F.min(F.struct("seq", "at")).alias("o"))
    return first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("missing_docs"))


def checks_usage_summary(checks: DataFrame) -> DataFrame:
    """What identity and income checks had to work with."""
    e = lambda k: F.element_at("evidence", F.lit(k))
    n = lambda k: F.when(F.coalesce(e(k), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(e(k), ",")))
    rows = checks.where(F.col("check_id").rlike("^(identity|income)\\."))
    return rows.select("case_id", "check_id", n("fields_compared").alias("n_fields"), n("diffs").alias("n_diffs"), e("declared").try_cast("double").alias("declared"), e("proven").try_cast("double").alias("proven"), n("proof_docs").alias("n_proof_docs"))


def duplicate_check_ids(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Check ids that occur twice or more in a case; an error if strict."""
    found = checks.groupBy("case_id", "check_id").agg(F.count("*").alias("n")).where("n > 1")
    return found.withColumn("n", F.raise_error(F.concat(F.lit("duplicate_check_id: "), F.coalesce("check_id", F.lit("null")))).cast("long")) if strict else found


def ordered_listing(store: DataFrame) -> DataFrame:
    """Types of each case by name, each with its files by name."""
    files = store.groupBy("case_id", "doc_type").agg(F.array_sort(F.collect_list("file_name")).alias("files"))
    return files.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_type", "files"))).alias("listing"))


def union_checks(families: list[DataFrame]) -> DataFrame:
    """All families in order, with seq over each case."""
    out = None
    for i, f in enumerate(families):
        f = f.withColumn("family", F.lit(i))
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy("case_id").orderBy("family", "seq")
    return out.withColumn("seq", F.row_number().over(w).cast("int")).drop("family")
