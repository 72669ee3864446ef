"""Quality rules: fixed rules, then robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of transformed statistics. For each (lang, source) the centre and scatter
of the least scattered ``share`` of rows are found by concentration steps from two deterministic
starts (Rousseeuw and Van Driessen 1999; Hubert, Rousseeuw and Verdonck 2012): distances, their
quantile, moments of the rows below it, again. A step is one pass of grouped sums over the written
statistics; only a row for each group is handled in Python. Rows whose Mahalanobis distance is
beyond the cut are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verifold.llm.storage import Table, free, save
from verifold.llm.words import tidy, words_of

#: Transformed statistics, in order.
STATS = ("symbols", "upper", "marks", "repeats", "dup_lines", "word_length")
D = len(STATS)
#: Least spread of each statistic, added to the scatter: what a few marks, one repeated line or one
#: boilerplate sentence make in a short clean text, however regular its group is.
FLOOR = (0.05, 0.05, 0.05, 0.15, 0.15, 0.05)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
ROW_SCHEMA = f"doc_id long, lang string, source string, row_key long, {COUNTS}, {', '.join(f'x{i} double' for i in range(D))}"


def _line_repeats(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def _statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and transformed statistics of each text of a batch."""
    texts = pc.fill_null(texts, "")
    words = words_of(texts)
    starts, ids = words.starts, words.ids
    rows = len(texts)
    n = np.diff(starts)
    owner = np.repeat(np.arange(rows), n)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values[ids], minlength=rows) if len(ids) else np.zeros(rows)

    lengths = pc.utf8_length(words.vocabulary).to_numpy().astype(np.float64)
    count = lambda pattern: pc.count_substring_regex(words.vocabulary, pattern).to_numpy().astype(np.float64)
    chars = per_doc(lengths)
    symbols, upper, letters, marks = (per_doc(count(p)) for p in (r"[#*$%&|<>]", r"\p{Lu}", r"\p{L}", r"[!?.,;:|]"))
    # Words in 3-word windows found twice or more in their text: windows as (doc, three ids).
    repeat = np.zeros(len(ids) + 1, dtype=np.int64)
    m = len(ids) - 2
    if m > 0:
        size = np.uint64(len(words.vocabulary) + 1)
        x = ids.astype(np.uint64)
        inside = owner[:m] == owner[2:]
        pair = owner[:m].astype(np.uint64) * size + x[:m]  # below rows * vocabulary
        _, pair = np.unique(pair, return_inverse=True)
        _, three = np.unique(pair.astype(np.uint64) * size + x[1 : m + 1], return_inverse=True)
        _, back, found = np.unique(three.astype(np.uint64) * size + x[2:], return_inverse=True, return_counts=True)
        # Windows over a document's end don't count; they may share a key with none inside.
        found = np.bincount(back, weights=inside, minlength=len(found))
        hit = np.flatnonzero(inside & (found[back] > 1))
        np.add.at(repeat, hit, 1)
        np.add.at(repeat, hit + 3, -1) if len(hit) and hit[-1] + 3 <= len(ids) else None
    covered = np.cumsum(repeat)[:-1] > 0
    repeats = np.bincount(owner[covered], minlength=rows) if len(ids) else np.zeros(rows, np.int64)
    lines = [_line_repeats(t.as_py()) if pc.count_substring(t, "\n").as_py() else (0, 1) for t in texts]
    dup, n_lines = (np.array([x[i] for x in lines], dtype=np.int64).reshape(rows) for i in (0, 1))
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    whole = np.maximum(n, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats,
        "x0": share(symbols, whole), "x1": share(upper, letters), "x2": share(marks, whole), "x3": share(repeats, whole),
        "x4": share(dup, n_lines), "x5": np.log1p(chars / whole),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and transformed statistics of each row: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = _statistics(part.column("text"))
                values = [pa.array(v).cast(pa.float64() if k in _X else pa.int64()) for k, v in found.items()]
                kept = ("doc_id", "lang", "source", "row_key")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *values], names=[*kept, *found])

    return docs.mapInArrow(run, ROW_SCHEMA)


_X = {f"x{i}" for i in range(D)}
MOMENTS = [f"s{i}" for i in range(D)] + [f"s{i}_{j}" for i in range(D) for j in range(i, D)]
FIT_SCHEMA = f"lang string, source string, start int, log_det double, n double, {', '.join(f'c{i} double' for i in range(D))}, {', '.join(f'w{i}_{j} double' for i in range(D) for j in range(i, D))}"


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(D)]
    return [F.count("*").cast("double").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(D)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(D) for j in range(i, D))]


def _distance() -> Column:
    """Squared Mahalanobis distance from a joined fit; w holds the inverse scatter."""
    diff = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total += (1 if i == j else 2) * F.col(f"w{i}_{j}") * diff[i] * diff[j]
    return total


def _fit(sums: DataFrame) -> DataFrame:
    """Centre, inverse scatter and log determinant of each group from its sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.square(FLOOR))
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                n = max(r["n"], 1.0)
                c = np.array([r[f"s{i}"] for i in range(D)]) / n
                cov = np.zeros((D, D))
                for i in range(D):
                    for j in range(i, D):
                        cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / n - c[i] * c[j]
                cov += floor
                inverse = np.linalg.inv(cov)
                out.append({"lang": r["lang"], "source": r["source"], "start": r["start"], "log_det": float(np.linalg.slogdet(cov)[1]), "n": n}
                           | {f"c{i}": c[i] for i in range(D)} | {f"w{i}_{j}": inverse[i, j] for i in range(D) for j in range(i, D)})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FIT_SCHEMA.split(", ")])

    return sums.mapInPandas(run, FIT_SCHEMA)


def _with_group(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows with their group's fit. There is one fit row for each group and start."""
    fits = fits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"}).drop("n")
    return rows.join(fits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))).drop("f_lang", "f_source")


def chi2_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def minimum_covariance(rows: DataFrame, share: float = 0.75, steps: int = 3) -> Table:
    """Robust fit of each (lang, source): one row a group, written to the shared folder.

    rows: lang, source and x0...; groups with null names are groups of their own. Starts: the rows
    nearest to the coordinate medians by scaled distance, and by the largest scaled coordinate.
    """
    keys = ["lang", "source"]
    x = [f"x{i}" for i in range(D)]
    mid = rows.groupBy(*keys).agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in x))
    mid = save(mid.select(*keys, *(F.col(c)[1].alias(f"m{i}") for i, c in enumerate(x)),
                          *(F.greatest(F.lit(FLOOR[i]), (F.col(c)[2] - F.col(c)[0]) / 1.349).alias(f"d{i}") for i, c in enumerate(x))), "medians")
    named = mid.df.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    scaled = [F.abs(F.col(c) - F.col(f"m{i}")) / F.col(f"d{i}") for i, c in enumerate(x)]
    total = F.lit(0.0)
    for s in scaled:
        total += s * s
    start = rows.join(named, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))
    near = start.select(*keys, *x, F.explode(F.array(F.struct(F.lit(0).alias("start"), total.alias("q")), F.struct(F.lit(1).alias("start"), F.greatest(*scaled).alias("q")))).alias("z")).select(*keys, *x, "z.*")

    used = [mid]
    for _ in range(steps + 1):
        cut = near.groupBy(*keys, "start").agg(F.percentile_approx("q", share, 2000).alias("cut"))
        cut = cut.withColumnsRenamed({"lang": "f_lang", "source": "f_source", "start": "f_start"})
        held = near.join(cut, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("start") == F.col("f_start"))).where("q <= cut")
        fit = save(_fit(held.groupBy(*keys, "start").agg(*_moments())), "fit")
        used.append(fit)
        near = _with_group(rows, fit.df).select(*keys, *x, "start", _distance().alias("q"))
    best = fit.df.groupBy(*keys).agg(F.min_by(F.struct(*fit.df.columns[2:]), F.struct("log_det", "start")).alias("z")).select(*keys, "z.*")
    # Consistency: the median distance of a group's rows is that of a chi-squared.
    middle = _with_group(rows, best).groupBy(*keys).agg(F.percentile_approx(_distance(), 0.5, 2000).alias("q"), F.count("*").alias("n_rows"))
    scale = middle.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.greatest(F.lit(1.0), F.col("q") / chi2_quantile(0.5, D)).alias("scale"), "n_rows")
    done = save(best.join(scale, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))).drop("f_lang", "f_source"), "robust")
    free(rows.sparkSession, *used)
    return done


def _fits(rows: DataFrame, share: float, least_group: int) -> DataFrame:
    """The fit of each (lang, source): its own if it has ``least_group`` rows, else its language's, else that of all rows.

    Groups are left out only where all rows together are fewer.
    """
    cols = [f"x{i}" for i in range(D)]
    none = F.lit(None).cast("string")
    own = minimum_covariance(rows.select("lang", "source", *cols), share).df
    enough, values = F.col("n_rows") >= least_group, [c for c in own.columns if c not in ("lang", "source")]
    found, small = own.where(enough), save(own.where(~enough).select("lang", "source"), "small").df
    if small.isEmpty():
        return found
    langs = F.broadcast(small.select(F.col("lang").alias("s_lang")).distinct())
    coarse = minimum_covariance(rows.join(langs, F.col("lang").eqNullSafe(F.col("s_lang")), "left_semi").select("lang", none.alias("source"), *cols), share).df.where(enough)
    coarse = coarse.select(F.col("lang").alias("f_lang"), *values)
    found = found.unionByName(small.join(coarse, F.col("lang").eqNullSafe(F.col("f_lang"))).drop("f_lang"))
    small = save(small.join(coarse, F.col("lang").eqNullSafe(F.col("f_lang")), "left_anti"), "small").df
    if small.isEmpty():
        return found
    whole = minimum_covariance(rows.select(none.alias("lang"), none.alias("source"), *cols), share).df.where(enough)
    return found.unionByName(small.crossJoin(F.broadcast(whole.select(*values))))


def judge(docs: DataFrame, probability: float = 1 - 1e-9, share: float = 0.75, least_group: int = 30) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept of each row.

    Needs columns doc_id, text, lang and source; others are ignored. Null or empty text has no
    words and fails the base rules. The fit of a (lang, source) uses its rows that pass the base
    rules; groups with fewer than ``least_group`` of them are judged by the fit of their language, or
    of all rows if that is small too. distance is null where no row of the group passes the base
    rules, and for all rows if fewer than ``least_group`` of all pass them. Repeated rows are judged alike. kept is false if base_failed, or if the scaled
    squared distance is beyond the chi-squared quantile of ``probability``.
    """
    cols = (F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    rows = save(statistics(docs.select(*cols).withColumn("row_key", F.xxhash64("text"))), "statistics").df
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    fits = _fits(rows.where("not base_failed"), share, least_group).withColumnsRenamed({"lang": "f_lang", "source": "f_source", "n": "f_n"})
    found = rows.join(fits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    far = _distance() / F.col("scale")
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return found.select("doc_id", "row_key", *counts, "base_failed", far.alias("distance"),
                        (~F.col("base_failed") & (F.coalesce(far, F.lit(0.0)) <= chi2_quantile(probability, D))).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps; columns as they were."""
    bad = judge(docs, **options).where("not kept").select(F.col("doc_id").alias("bad_doc_id"), F.col("row_key").alias("bad_row_key")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(bad["bad_doc_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(bad["bad_row_key"])
    return docs.join(bad, match, "left_anti")
