"""Operators on words against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from verifold.llm import katz, quality, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHARED = " ".join(f"shared{i}" for i in range(60))
#: Nulls, empty and long texts, ties, repeated rows, odd white space, no doc_id.
EDGE = [
    (1, f"start here {SHARED} first end"), (2, f"{SHARED} then other words"), (2, f"{SHARED} then other words"), (3, None), (4, ""),
    (5, " \t\n\x0b\x0c\r "), (6, "one two three"), (None, SHARED), (None, None), (7, "a " * 5000), (8, "a " * 5000 + "tail"),
    (9, f"x y  z \x85 {SHARED}"), (10, "One TWO three"), (11, "é ÉA \U0001F600 z"), (12, f"pre {SHARED} {SHARED}"),
]


def edge(spark, extra=True):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    if extra:  # extra columns whose names clash with those used inside
        df = df.select("*", F.lit(1).alias("block"), F.lit("x").alias("part"), F.lit(2).alias("fp"), F.lit("z").alias("row_key"))
    return df


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def documents(spark, sf_dir, n=None):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# substring dedup


def brute_repeats(rows, width):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - width + 1) if i is not None else ():
            if least[tuple(w[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,period", [(50, 31), (8, 7), (5, 5), (3, 1)])
def test_repeats_edge(spark, width, period):
    got = substring_dedup.remove_repeats(edge(spark), width, period).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(EDGE, width)


def test_repeats_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = substring_dedup.remove_repeats(docs).collect()
    want = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r.n_removed for r in got) > 0


def test_repeats_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("period", [1, 2, 5, 7, 12, 13, 21, 31, 40])
def test_cover(period):
    cover = set(substring_dedup.difference_cover(period).tolist())
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


# simhash


def brute_fingerprint(text, k=4):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= distance):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def check_simhash(rows, got, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps, distance)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash_edge(spark):
    check_simhash(EDGE, simhash.near_duplicates(edge(spark)).collect())


def test_simhash_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_simhash(rows, simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("distance,segment,groups", [(4, 2, 2), (3, 4, 2), (6, 2, 2), (2, 1, 3), (0, 2, 1)])
def test_links_of_random_fingerprints(spark, distance, segment, groups, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for _ in range(700):  # chains and clusters around the base values
        x = int(rng.choice(sorted(fps)[:80]))
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "CELL_ROWS", 20)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = simhash.links(df, distance, segment, groups).collect()
    pairs = {(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in got}
    assert all((a ^ b).bit_count() <= distance and a != b for a, b in pairs)
    place = {x: i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == brute_components(range(len(fps)), fps, distance)


def test_links_in_one_large_cell(spark, monkeypatch):
    """Fingerprints that share their upper 32 bits and their counts in all segments: several steps of equal bits, all links."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 20)
    rng = np.random.default_rng(6)
    fps = sorted({(0x5A5A5A5A << 32) | sum(int(b) << (2 * i) for i, b in enumerate(rng.integers(1, 3, 16))) for _ in range(600)})
    steps, split = [], simhash._by_equal_bits
    monkeypatch.setattr(simhash, "_by_equal_bits", lambda large, distance, equal: steps.append(equal) or split(large, distance, equal))
    got = simhash.links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long"), 4).collect()
    roots = brute_components(range(len(fps)), fps, 4)
    place = {x: i for i, x in enumerate(fps)}
    at = list(range(len(fps)))
    for _ in fps:
        before = list(at)
        for r in got:
            a, b = (place[int(np.int64(v).view(np.uint64))] for v in r)
            assert (fps[a] ^ fps[b]).bit_count() <= 4
            at[a] = at[b] = min(at[a], at[b])
        if at == before:
            break
    assert at == roots and len(steps) > 1


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# quality


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = [False] * len(w)
    for i in range(len(w) - 2):
        if win[tuple(w[i : i + 3])] > 1:
            rep[i : i + 3] = [True] * 3
    n, r = len(w), sum(rep)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, r, n < 50 or 100 * r > 50 * n)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_edge(spark):
    df = edge(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    got = quality.judge(df).collect()
    assert sorted(((r.doc_id, *(r[c] for c in COUNTS)) for r in got), key=str) == sorted(((i, *brute_counts(t)) for i, t in EDGE), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = quality.judge(docs)
    rows = {r.doc_id: r for r in got.collect()}
    for r in docs.select("doc_id", "text").collect():
        assert tuple(rows[r.doc_id][c] for c in COUNTS) == brute_counts(r.text)
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    held = got.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in held}
    assert kept[1] >= 0.99 and kept[0] <= 0.3


def test_minimum_covariance_is_robust(spark):
    rng = np.random.default_rng(3)
    clean = rng.normal(0, 1, (1500, quality.D)) @ np.diag(np.arange(1, quality.D + 1) / 2)
    bad = rng.normal(12, 0.2, (300, quality.D))
    rows = [("l", "s", *map(float, x)) for x in np.vstack([clean, bad])]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} double" for i in range(quality.D)))
    fit = quality.minimum_covariance(df, share=0.75, steps=5).df.first()
    assert all(abs(fit[f"c{i}"]) < 0.35 for i in range(quality.D))


def brute_fit(x, share=0.75, steps=3):
    """Centre, inverse scatter and scale of the rows of one group, by concentration steps from both starts."""
    element = lambda v, p: np.sort(v, axis=0)[max(0, math.ceil(p * len(v)) - 1)]
    floor = np.array(quality.FLOOR)
    q1, mid, q3 = (element(x, p) for p in (0.25, 0.5, 0.75))
    scaled = np.abs(x - mid) / np.maximum(floor, (q3 - q1) / 1.349)
    best = None
    for start, q in enumerate(((scaled**2).sum(axis=1), scaled.max(axis=1))):
        for _ in range(steps + 1):
            held = x[q <= element(q, share)]
            c = held.mean(axis=0)
            cov = held.T @ held / len(held) - np.outer(c, c) + np.diag(floor**2)
            inverse = np.linalg.inv(cov)
            q = np.einsum("ij,jk,ik->i", x - c, inverse, x - c)
        key = (np.linalg.slogdet(cov)[1], start)
        if best is None or key < best[0]:
            best = key, c, inverse, q
    return best[1], best[2], max(1.0, element(best[3], 0.5) / quality.chi2_quantile(0.5, quality.D))


def test_verdicts_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").where("text is not null and length(text) < 20000")
    rows = [r for r in quality.statistics(docs.select("doc_id", "text", "lang", "source").withColumn("row_key", F.lit(0).cast("long"))).collect()]
    good = [r for r in rows if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    vectors = lambda some: np.array([[r[f"x{i}"] for i in range(quality.D)] for r in some])
    group, lang = defaultdict(list), defaultdict(list)
    for r in good:
        group[r.lang, r.source].append(r)
        lang[r.lang].append(r)
    assert min(map(len, lang.values())) >= 30 and max(map(len, group.values())) >= 30 > min(map(len, group.values()))
    fits = {k: brute_fit(vectors(v if len(v) >= 30 else lang[k[0]])) for k, v in group.items()}
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in good:
        c, inverse, scale = fits[r.lang, r.source]
        d = vectors([r])[0] - c
        assert got[r.doc_id].distance == pytest.approx(d @ inverse @ d / scale, rel=1e-6, abs=1e-9)
        assert got[r.doc_id].kept == (d @ inverse @ d / scale <= quality.chi2_quantile(1 - 1e-9, quality.D))


def test_quality_of_small_groups(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(100)) + "."
    junk = lambda: " ".join(w + "#|" for w in text().split())
    rows = [(i, text(), "en", "hot") for i in range(60)]
    for at, lang, source in ((100, "en", "rare"), (200, "xx", "rare"), (300, None, None)):  # by language, and twice by all rows
        rows += [(at + i, text(), lang, source) for i in range(4)] + [(at + 4, junk(), lang, source)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and all(r.distance is not None for r in got)
    assert sorted(r.doc_id for r in got if not r.kept) == [104, 204, 304]


def test_quality_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


# katz


def brute_katz(rows, order):
    """rows: (doc_id, text, train). Scores by recursive definition over dictionaries."""
    end, start = ("END",), ("START",)
    grams = [Counter() for _ in range(order)]
    for _, t, train in rows:
        if train:
            s = [*([start] * (order - 1)), *WORD.findall(lower(t or "")), end]
            for i in range(order - 1, len(s)):
                for m in range(order):
                    grams[m][tuple(s[i - m : i + 1])] += 1
    d = [katz.discounts([sum(c == r for c in g.values()) for r in range(1, katz.K + 2)]) for g in grams]
    total = sum(grams[0].values())
    vocab = {g[0] for g in grams[0]}
    f = lambda c, m: c * d[m][min(c, katz.K + 1)]
    missing = total - sum(f(c, 0) for c in grams[0].values())
    followers = [defaultdict(dict) for _ in range(order)]
    for m in range(1, order):
        for g, c in grams[m].items():
            followers[m][g[:-1]][g[-1]] = c
    memo = {}

    def p(m, h, w):
        if m == 0:
            if not total:
                return 1.0
            if missing < 1e-9:
                return (grams[0][(w,)] or 1) / (total + 1)
            return f(grams[0][(w,)], 0) / total if (w,) in grams[0] else missing / total
        seen = followers[m].get(h)
        if not seen:
            return p(m - 1, h[1:], w)
        if (m, h) not in memo:
            n, kept = sum(seen.values()), sum(f(c, m) for c in seen.values())
            whole = n + 1 if kept >= n else n
            memo[m, h] = whole, (whole - kept) / whole / (1 - sum(p(m - 1, h[1:], x) for x in seen))
        whole, alpha = memo[m, h]
        return f(seen[w], m) / whole if w in seen else alpha * p(m - 1, h[1:], w)

    out = []
    for i, t, train in rows:
        s = [*([start] * (order - 1)), *WORD.findall(lower(t or "")), end]
        toks = s[order - 1 :]
        c = [grams[0][(w,)] for w in toks]
        out.append((i, train, len(toks), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + len(vocab) + 1)) for x in c),
                    sum(math.log10(p(order - 1, tuple(s[k - order + 1 : k]), s[k])) for k in range(order - 1, len(s)))))
    sums = [sum(p(order - 1, h, w) for w in [*vocab, ("UNK",)]) for h in [*followers[order - 1]][:40]] if order > 1 else []
    return out, sums


def close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_edge(spark, order):
    rows = [(i, t, i is None or i % 3 != 2) for i, t in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    want, sums = brute_katz(rows, order)
    assert sums == pytest.approx([1.0] * len(sums))
    close([tuple(r) for r in katz.score(df.withColumn("block", F.lit(3)), order)[0].collect()], want)


def test_katz_documents(spark, sf_dir, order=2):
    docs = documents(spark, sf_dir).select("doc_id", "text").where("length(text) < 4000")
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    scored, tables = katz.score(df, order)
    got = [tuple(r) for r in scored.collect()]
    want, sums = brute_katz(rows, order)
    assert sums == pytest.approx([1.0] * len(sums))
    close(got, want)
    held = [r for r in got if not r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert len(tables) == 2 * order - 1


def test_katz_nothing(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string, train boolean"))[0].count() == 0
    one = katz.score(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean"))[0].first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score) == (3, 0, 0, 0.0)
