"""Secret scans, licenses, decontamination, token files, URL filters and mixing against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verifold.llm import decontamination, licenses, mixing, secrets, token_files, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# secret scans

SECRET_ROWS = [
    (1, 'x password = "abcdefghijkl1" y'), (2, "token: secret: abcdefghijklmnop"), (3, None), (4, ""),
    (5, "AKIA" + "A1" * 8 + " near opaque " + "Zz9+/" * 8), (6, "only opaque " + "Zz9+/" * 8),
    (7, "login: someone far " + "x " * 300 + "Zz9+/" * 8), (8, "deadbeef" * 3 + "\x01\x02 \U0001F600 " + "0" * 16),
    (9, "API_KEY:" + "A" * 11 + " apikey=" + "B" * 12), (9, "API_KEY:" + "A" * 11 + " apikey=" + "B" * 12), (None, "PASSWD='" + "q" * 20 + "'"),
    (10, "https://host.example/x?y login: alice token=" + "k" * 14), (11, "https://host.example/ alone"), (12, "AKIA" + "B" * 10 + " " + "Qq1" * 12),
    (13, ("secret=" + "v" * 12 + " ") * 400), (14, "AKIAAKIA" + "C" * 13 + " AKIA" + "D" * 40),
]


def brute_secrets(text, scope=200):
    t = text or ""
    found = []
    for p in secrets.PATTERNS:
        rx = re.compile(p.regex.replace("(?:(?i)", "(?i:"))
        for m in rx.finditer(t):
            if m.end(p.group) - m.start(p.group) >= p.least:
                found.append((m.start(), p, m.end()))
    rank = {p.kind: i for i, p in enumerate(secrets.PATTERNS)}
    strong = [x for x in found if x[1].strong]
    apart = [x for x in found if x[1].strong or not any(a < x[2] and x[0] < b for a, _, b in strong)]
    keep = [x for x in apart if x[1].strong or any(y[1].role in secrets.COMPLETES[x[1].role] and abs(y[0] - x[0]) <= scope for y in apart)]
    text_of = lambda xs: ",".join(f"{p.kind}:{a}:{b}" for a, p, b in sorted(xs, key=lambda x: (x[0], rank[x[1].kind])))
    count = Counter(x[1].kind for x in strong)
    return (*(count[k] for k in ("assign", "access", "hex")), hashlib.sha256(text_of(strong).encode()).hexdigest(), text_of(keep))


def test_secrets_edge(spark):
    df = spark.createDataFrame(SECRET_ROWS, "doc_id long, text string").withColumn("row_key", F.lit("k")).withColumn("kind", F.lit(1))
    got = sorted((tuple(r) for r in secrets.scan_secrets(df).collect()), key=str)
    assert got == sorted(((i, *brute_secrets(t)) for i, t in SECRET_ROWS), key=str)
    by = {r[0]: r[5] for r in got}
    assert "opaque" in by[5] and by[6] == "" and by[7] == "" and by[11] == "" and "endpoint" in by[10] and "short_access" in by[12]


def test_secrets_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.scan_secrets(docs).collect()}
    assert got == {r.doc_id: brute_secrets(r.text) for r in docs.select("doc_id", "text").collect()}
    plan = secrets.scan_secrets(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_empty(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# licenses


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-permission"]
    changed = mit.replace("free of charge", "for no money").replace("copies or substantial portions", "copies or large portions")
    rows = [(1, f"\u00e9 intro text. {mit} tail"), (2, changed), (3, None), (4, ""), (5, "nothing here at all"), (6, mit[: len(mit) // 2]),
            (7, "Released under the MIT License.\nwords " + "w " * 3000 + "Released under the MIT License"), (7, "Released under the MIT License.\nwords " + "w " * 3000 + "Released under the MIT License"), (None, "released UNDER the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit("clash"))
    got = licenses.scan_licenses(df).collect()
    found = Counter((r.doc_id, r.template) for r in got)
    assert found[1, "MIT-permission"] == 1 and found[2, "MIT-permission"] == 1 and found[6, "MIT-permission"] == 0
    assert found[7, "MIT"] == 4 and found[None, "MIT"] == 1 and not {3, 4, 5} & {r.doc_id for r in got}
    for r in got:
        if r.doc_id == 1:
            assert r.coverage == 1.0 and rows[0][1][r.span_start : r.span_end] == mit.rstrip(".")
        if r.doc_id == 2:
            assert 0.8 <= r.coverage < 1


def test_licenses_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.template) for r in licenses.scan_licenses(docs).collect()}
    plain = {k: " ".join(licenses.words_and_spans(v)[0]) for k, v in licenses.TEMPLATES.items()}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in plain.items() if f" {v} " in f" {' '.join(licenses.words_and_spans(r.text or '')[0])} "}
    assert want and want <= got


def test_licenses_many_templates_and_none(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PASS_BYTES", 200)
    names = [(f"t{i}", " ".join(f"w{i}x{j}" for j in range(8))) for i in range(20)]
    t = spark.createDataFrame([*names, ("none", None), (None, "a b c d e")], "template string, text string")
    df = spark.createDataFrame([(i, f"a {x} b") for i, (_, x) in enumerate(names)], "doc_id long, text string")
    assert sorted((r.doc_id, r.template) for r in licenses.scan_licenses(df, t).collect()) == sorted((i, n) for i, (n, _) in enumerate(names))
    assert licenses.scan_licenses(df.limit(0)).count() == 0 and licenses.scan_licenses(df, t.limit(0)).count() == 0


def brute_align(template, words, shift, band):
    best = 0
    n = len(template)
    dp = [[0] * (len(words) + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, len(words) + 1):
            dp[i][j] = max(dp[i - 1][j], dp[i][j - 1])
            if template[i - 1] == words[j - 1] and abs(j - i - shift) <= band:
                dp[i][j] = max(dp[i][j], dp[i - 1][j - 1] + 1)
            best = max(best, dp[i][j])
    return best


def test_align_random():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t, w = ([str(x) for x in rng.integers(0, 5, rng.integers(1, 25))] for _ in range(2))
        shift, band = int(rng.integers(-5, 6)), int(rng.integers(0, 5))
        n, a, b = licenses.align(t, w, shift, band)
        assert n == brute_align(t, w, shift, band)
        assert n == 0 or n <= b - a


def brute_scan(text, templates, gram, window, least, band):
    """Best coverage of each template over every diagonal that a fingerprint of it shares with the text."""
    words = licenses.words_and_spans(text or "")[0]
    out = {}
    for name, t in templates:
        tw = licenses.words_and_spans(t)[0]
        hashed = licenses.window_hashes(licenses.hashes_of(pa.array(tw, pa.string())), gram)
        shifts = {j - int(i) for i in licenses.winnow(hashed, window) for j in range(len(words) - gram + 1) if words[j : j + gram] == tw[int(i) : int(i) + gram]}
        best = max((brute_align(tw, words, s, band) for s in shifts), default=0)
        if best and best >= least * len(tw):
            out[name] = best
    return out


def test_licenses_against_every_diagonal(spark):
    rng = np.random.default_rng(5)
    templates = [(f"t{i}", " ".join(f"w{x}" for x in rng.integers(0, 12, 24))) for i in range(3)]
    texts = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 12, 30)]
        t = templates[i % 3][1].split()
        for p in sorted(rng.integers(0, len(t), rng.integers(0, 4)).tolist(), reverse=True):
            t[p:p] = [f"x{k}" for k in range(rng.integers(1, 7))]
        texts.append((i, " ".join([*words[:10], *t, *words[10:]])))
    texts += [(100, None), (101, ""), (102, templates[0][1] + " " + templates[0][1])]
    # Seven words on one diagonal, then thirty on another within half a band of it.
    long = [f"v{k}" for k in range(40)]
    templates.append(("long", " ".join(long)))
    texts.append((103, " ".join([*long[:3], *["x"] * 4, *long[3:10], *["y"] * 8, *long[10:]])))
    got = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(templates, "template string, text string"), gram=3, window=2, coverage=0.7, band=8).collect()
    best = {}
    for r in got:
        best.setdefault(r.doc_id, {})
        best[r.doc_id][r.template] = max(best[r.doc_id].get(r.template, 0), r.n_matched)
    want = {i: b for i, t in texts if (b := brute_scan(t, templates, 3, 2, 0.7, 8))}
    assert best == want and best[103]["long"] == 40 and len(want) > 30
    assert sum(r.doc_id == 102 and r.template == "t0" for r in got) == 2


# decontamination


def plain_template(text):
    """(placeholder or word, surface, whether a capital at an opening) of each word of a text, word by word."""
    out, opening = [], True
    for raw in (text or "").split():
        core = re.sub(r"^[^\w$€£%°+-]+|[^\w%°]+$", "", raw)
        low = core.lower()
        unit = re.sub(r"^[-+]?[$€£]?\d[\d.,:/]*", "", low)
        number = re.fullmatch(r"[-+]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th)?", core) or low in decontamination.NUMBERS or (unit != low and unit in decontamination.UNITS)
        kind = "<num>" if number else "<unit>" if low in decontamination.UNITS else low
        name = kind == low and core[:1].isupper() and any(c.islower() for c in core)
        if core:
            out.append(("<name>" if name and not opening else kind, "<name>" if name else kind, low))
        opening = bool(re.search(r'[.!?:]["”]?$', raw))
    return out


def brute_contaminated(docs, items, width=5, coverage=0.5):
    found = set()
    for i, item in items:
        a = plain_template(item)
        for d, doc in docs:
            b = plain_template(doc)
            for reading in (0, 1):
                held = "<num>", "<unit>", "<name>"
                wins = [p for p in range(len(a) - width + 1) if any(x[reading] not in held for x in a[p : p + width])]
                shifts = {}
                for p in wins:
                    for q in range(len(b) - width + 1):
                        if all(x[reading] == y[reading] for x, y in zip(a[p : p + width], b[q : q + width], strict=True)):
                            shifts.setdefault(q - p, []).append(p)
                hit = set()
                for s, ps in shifts.items():
                    pairs = {(a[p + k][2], b[p + k + s][2]) for p in ps for k in range(width) if a[p + k][reading] in held}
                    if len({x for x, _ in pairs}) == len(pairs):
                        hit |= set(ps)
                every = {p for r in (0, 1) for p in range(len(a) - width + 1) if any(x[r] not in held for x in a[p : p + width])}
                if every and len(hit) >= coverage * len(every):
                    found.add((d, i))
    return found


QUESTIONS = (
    "{n0} has {a} apples and {b} pears. {n0} gives {a} apples to {n1} and keeps the rest. How many does {n0} have?",
    "A train leaves {n2} at {a} km per hour while {n1} rides {b} km towards it. When do they meet if the road is {c} km long?",
    "{n1} buys {a} kg of flour and {b} kg of sugar for {c} dollars. What does one kg cost when {n1} pays {c} dollars twice?",
    "The garden of {n0} is {a} m long and {b} m wide. How much fence does {n2} need if the gate takes {c} m?",
)


def filled(rng, k):
    names = rng.permutation(["Anna", "Boris", "Clara", "David", "Elena", "Felix", "Greta", "Hugo"])
    a, b, c = (str(x) for x in rng.permutation(np.arange(2, 90))[:3])
    return QUESTIONS[k].format(n0=names[0], n1=names[1], n2=names[2], a=a, b=b, c=c)


def test_decontamination_finds_other_parameters(spark, sf_dir):
    rng = np.random.default_rng(4)
    items = [(k, filled(rng, k)) for k in range(4)]
    clean = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = [(10_000 + j, f"{clean[j][1][:200]} {filled(rng, j % 4)} {clean[j][1][200:400]}") for j in range(120)]
    wrong = [(20_000 + j, "Anna has 5 apples and 7 pears. Boris gives 9 apples to Clara and keeps the rest. How many does David have?") for j in range(3)]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs + clean + wrong, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = sum((10_000 + j, j % 4) in got for j in range(120))
    assert found >= 0.95 * 120 and not {d for d, _ in got if d < 10_000 or d >= 20_000}


def test_decontamination_brute(spark):
    rng = np.random.default_rng(6)
    items = [(k, filled(rng, k)) for k in range(4)] + [(4, "7 8 9 10 11 12"), (5, "four words are few"), (6, None), (7, "so " + " ".join(["9"] * 8) + " it ends")]
    docs = []
    for j in range(80):
        words = filled(rng, j % 4).split()
        for _ in range(int(rng.integers(0, 6))):  # words lost, changed or put in
            p = int(rng.integers(0, len(words)))
            words[p : p + int(rng.integers(0, 2))] = [] if rng.random() < 0.4 else [str(rng.choice(["Anna", "12", "km", "so", "Then."]))]
        docs.append((j, " ".join(["Some text first.", *words, "and more."])))
    docs += [(100, "1 2 3 4 5 6 7 8"), (101, ""), (102, None), (103, "so " + " ".join(["3"] * 8) + " it ends")]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_contaminated(docs, items) and 20 < len(got) < 85 and (103, 7) in got


def test_decontamination(spark):
    items = [(10, "Alice Smith has 12 apples and gives 5 apples to her brother Bob Jones near the old market hall"), (11, "Carol White has 30 apples and gives 9 apples to her brother Dan Brown near the old market hall"),
             (12, "the quick brown fox jumps over the lazy dog while 7 cats look on"), (13, "too short"), (14, None)]
    docs = [(1, "Intro words here. " + items[0][1] + ". More text follows here."), (2, "Intro words here. Erin Black has 99 apples and gives 42 apples to her brother Finn Green near the old market hall."),
            (3, "Some other text about apples and the old market hall in town"), (4, None), (5, ""), (None, items[2][1]), (6, "The quick brown fox jumps over the lazy dog while 8 cats look on."),
            (1, "Intro words here. " + items[0][1] + ". More text follows here."), (7, "w " * 4000 + items[2][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("hash", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, i).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 10), (2, 11), (None, 12), (6, 12), (7, 12)}  # 10 and 11 are one question
    assert got[1, 10].verbatim and not got[1, 11].verbatim and got[1, 10].coverage == 1 and not got[2, 10].verbatim and not got[6, 12].verbatim
    left = decontamination.decontaminate(d, i)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == d.columns
    assert decontamination.decontaminate(d, i.limit(0)).count() == len(docs)
    assert decontamination.contaminated(d.limit(0), i).count() == 0


def test_slots_must_be_consistent(spark):
    item = "Anna Kay met Anna Kay and Anna Kay saw Anna Kay with Anna Kay"
    good, bad = "so Lena Poe met Lena Poe and Lena Poe saw Lena Poe with Lena Poe", "so Lena Poe met Mary Roe and Nora Soe saw Olga Toe with Pam Uoe"
    d = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "so " + item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(d, i).collect()] == [1]


def test_items_of_one_template_with_other_repeats(spark):
    text = "the farmer has {} goats and then he gives {} goats to his old friend"
    i = spark.createDataFrame([(1, text.format(5, 5)), (2, text.format(5, 7)), (3, text.format(8, 9))], "item_id long, text string")
    d = spark.createDataFrame([(1, text.format(5, 7)), (2, text.format(4, 6)), (3, text.format(2, 2))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.contaminated(d, i).collect()}
    assert got == {(1, 2): True, (2, 2): False, (3, 1): False, (3, 2): False}  # 2 and 3 are one entry


def test_names_that_open_sentences(spark):
    text = "{0} has 5 apples. {0} eats 2 apples. {0} buys 4 apples. How many apples does {0} have?"
    i = spark.createDataFrame([(1, text.format("Tom"))], "item_id long, text string")
    d = [(1, text.format("Ben")), (2, text.format("Tom")), (3, "Ann has 5 apples. Bea eats 2 apples. Cat buys 4 apples. How many apples does Dan have?"),
         (4, "Tom has 5 apples. tom eats 2 apples. tom buys 4 apples. how many apples does Tom have?"), (5, "So it is. How many boats. Now see. Why not.")]
    got = {r.doc_id: (r.coverage, r.verbatim) for r in decontamination.contaminated(spark.createDataFrame(d, "doc_id long, text string"), i).collect()}
    assert got[1] == (1, False) and got[2] == (1, True) and 4 in got and 3 not in got and 5 not in got


def test_decontamination_documents(spark, sf_dir):
    base = sf_dir.replace("0.001", "0.01")
    docs, items = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id for r in decontamination.contaminated(docs, items).collect()}
    texts = [r.text for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(t in (r.text or "") for t in texts)}
    assert want and want <= got and len(got - want) <= 0.01 * docs.count()


# token files

TOKEN_ROWS = [(5, "Hello world, this is a test."), (3, None), (3, ""), (1, "  double  spaces \n \n and\ttabs \x85 \u2003x "), (2, "a\n b \nc\n\nd e"), (None, "no id"), (7, "it's <|endoftext|> here"), (14, "<|endoftext|>"), (14, "in<|endoftext|>side a word <|endoftext|>. <|endoftext|"), (15, "<|endoftext|> at both ends <|endoftext|>"), (15, "x <|endoftext|>\n\n y"),
              (8, "x" * 500 + " " + "é" * 100), (9, "long text " * 3000), (9, "long text " * 3000), (10, " lead"), (11, "trail "), (12, "a\n  b   c"), (13, "\U0001F600\U0001F1E9 e\u0301 1234 don't WE'LL")]


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]


@pytest.mark.parametrize("mode,block,chunk", [("byte", 64, 500), ("bit", 64, 500), ("byte", 1 << 16, 1 << 20)])
def test_token_files(spark, tmp_path, mode, block, chunk):
    df = spark.createDataFrame(TOKEN_ROWS, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("tie", F.lit(1))
    token_files.write_ids(df, str(tmp_path / "t"), TOKENIZER, mode=mode, block_ids=block, chunk_ids=chunk)
    got = token_files.read_ids(spark, str(tmp_path / "t"), ids=True).orderBy("start").collect()
    want = expected_tokens(TOKEN_ROWS)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), x) for i, x in want)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_token_documents(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_files.write_ids(docs, str(tmp_path / "t"), TOKENIZER)
    got = token_files.read_ids(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = expected_tokens([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    assert [r.start for r in got] == [0, *itertools.accumulate(len(x) for _, x in want)][:-1]


def test_token_files_empty(spark, tmp_path):
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), TOKENIZER)
    assert token_files.read_ids(spark, str(tmp_path / "t"), ids=True).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        for top in (1, 256, 50257, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            assert (token_files.from_planes(token_files.to_planes(ids, mode), n, mode) == ids).all()


# URL filters

URL_ROWS = [(1, "http://A.example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "http://x.net/es/1"), (4, None), (5, "no scheme"), (6, "http://net/fr/"), (7, "https://evilnet/fr/1"),
            (8, "http://a.org"), (9, "http://a.org/?q#f"), (9, "http://a.org/?q#f"), (10, "x://b.com:80/en/y"), (11, "http://B.COM#x"), (None, "http://c.net/de/" + "z/" * 50), (12, "http://example.com/en"), (13, "")]


def test_urls_edge(spark):
    df = spark.createDataFrame(URL_ROWS, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("template", F.lit("t"))
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert urls.filter_urls(df).count() == len(URL_ROWS)
    assert got[1, "a.example.com", "/en/1"] == ("example.com/en/", "block") and got[2, "www.example.com", "/en/1"] == ("www.example.com/en/", "allow")
    assert got[3, "x.net", "/es/1"] == ("net/es/", "block") and got[6, "net", "/fr/"] == ("net/fr/", "block") and got[7, "evilnet", "/fr/1"] == (None, "allow")
    assert got[4, "", ""] == (None, "allow") and got[5, "", ""] == (None, "allow") and got[11, "b.com", ""] == (None, "allow") and got[12, "example.com", "/en"] == ("com/", "allow")


def test_urls_tree(spark):
    rows = [(i, f"http://h.org/{s}/{i}.html", b) for s, b, k in (("spam", True, 40), ("blog", False, 40), ("news", False, 40)) for i in range(k)]
    rows += [(1000 + i, f"http://h.org/spam/{i}", None) for i in range(5)] + [(2000 + i, f"http://h.org/v{chr(97 + i % 26)}{chr(97 + i // 26)}/x", None) for i in range(100)]
    rows += [(3000 + i, f"http://h.org/spam/{i}.html", None) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, b boolean")
    got = {r.page_id: r for r in urls.filter_urls(df, rules=(), label=F.col("b")).where("page_id >= 1000").collect()}
    assert got[3000].template == "/spam/*" and got[3000].verdict == "block"
    assert got[2000].template == "/*/x" and got[2000].verdict == "allow"


def test_urls_judge_unlabelled_branches_by_what_they_resemble(spark):
    rows = []
    add = lambda host, path, label, n: rows.extend([(len(rows) + i, f"http://{host}/{path.format(i)}", label) for i in range(n)])
    add("h.org", "go/{}.html", True, 60)
    add("h.org", "win/{}.html", None, 30)  # planted: children as those of go
    for k in range(40):
        add("h.org", f"r{chr(97 + k // 26)}{chr(97 + k % 26)}/{{}}.html", None, 1)  # planted: many rare sections
    planted = {r[0] for r in rows if r[2] is None}
    add("h.org", "docs/guide/part-x/{}", None, 200)  # other children: a branch of its own
    add("mixed.org", "go/{}.html", True, 60)
    add("mixed.org", "news/{}.html", False, 60)
    add("mixed.org", "about/{}.html", None, 30)
    add("deep.org", "/".join("abcdefghij") + "/{}.html", True, 20)
    deep = len(rows)
    add("deep.org", "/".join("abcdefghij") + "/x{}", None, 1)
    df = spark.createDataFrame(rows, "page_id long, url string, b boolean")
    blocked = {r.page_id for r in urls.filter_urls(df, rules=(), label=F.col("b")).where("verdict = 'block'").collect()}
    unlabelled = {r[0] for r in rows if r[2] is None}
    assert planted <= blocked and blocked & unlabelled == planted | {deep}


def rounded(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def test_urls_sql(spark, sf_dir):
    for base in (sf_dir, sf_dir.replace("0.001", "0.01")):
        got = urls.filter_urls(spark.read.parquet(f"{base}/pages.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{base}/pages.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({urls.oracle_sql()})").fetchall()
        assert rounded(got.collect()) == rounded(want)
    # Here labels are of one kind on each host, and most pages beside them have none: they condemn nobody.
    assert got.where("rule is null and verdict = 'block'").count() == 0


def test_urls_one_sided_labels(spark):
    """Pages that no rule meets are blocked where nearly all pages of their template are, and not where many are not."""
    rules = tuple(("block", "x.example", f"/{a}/") for a in "abcd") + tuple(("block", "y.example", f"/{a}/") for a in "ab")
    urls_ = [f"http://x.example/{a}/{i}" for a in "abcd" for i in range(20)] + ["http://x.example/e/1", "http://x.example/f/2"]
    urls_ += [f"http://y.example/{a}/{i}" for a in "abcdefg" for i in range(20)]
    df = spark.createDataFrame([*enumerate(urls_)], "page_id long, url string")
    got = urls.filter_urls(df, rules=rules).where("rule is null")
    assert {r.host: r.verdict for r in got.collect()} == {"x.example": "block", "y.example": "allow"}
    assert {r.verdict for r in urls.filter_urls(df, rules=rules, unlabelled=0.0).collect()} == {"block"}
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_urls_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# mixing


@pytest.mark.parametrize("weights,stretch,n", [
    ({"a": 5, "b": 3, "c": 2}, 10, 12), ({"a": 0.12345, "b": 0.00004, "c": 0.87651}, 20_000, 15), ({f"s{i}": i + 1 for i in range(21)}, 100, 40),
    ({"x": 1}, 7, 3), ({f"d{i}": (i % 97 + 1) ** 0.5 for i in range(1500)}, 6000, 4), ({"a": 1 / 3, "b": 1 / 3, "c": 1e-9}, 3000, 20),
])
def test_schedule_deviates_less_than_one_block(weights, stretch, n):
    parts = mixing.exact(weights)
    whole = sum(Fraction(w) for w in weights.values())
    total = sum(parts.values())
    assert all(Fraction(p, total) == Fraction(weights[s]) / whole for s, p in parts.items())
    names = list(parts)
    done = [0] * len(names)
    for j in range(n):
        assert mixing.state(list(parts.values()), total, j * stretch) == done
        for t, (i, k) in enumerate(mixing.schedule(list(parts.values()), total, j * stretch, (j + 1) * stretch), j * stretch):
            p = parts[names[i]]
            assert k == done[i] and k * total // p <= t < -(-(k + 1) * total // p)
            done[i] += 1
            if len(names) < 100 or t % 500 == 0:
                assert all(abs(d * total - (t + 1) * parts[s]) < total for d, s in zip(done, names, strict=True))
    assert sum(done) == n * stretch


def planned_slots(parts, blocks, stretch):
    """Slots of the blocks by one pass over the stretches; then the last source at its releases."""
    names, total = sorted(parts), sum(parts.values())
    slots = {}
    t = 0
    while sum(len([b for b in range(blocks.get(s, 0)) if (s, b) not in slots]) > 0 for s in names) > 1:
        for at, (i, k) in enumerate(mixing.schedule([parts[s] for s in names], total, t, t + stretch), t):
            if k < blocks.get(names[i], 0):
                slots[names[i], k] = at
        t += stretch
    return slots


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.2, "absent": 0.1}
    got = mixing.mix(docs, weights, block_chars=20_000, stretch=16)
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_offset", "mix_rank"]
    rows = got.collect()
    assert len(rows) == docs.count()
    by, blocks = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.source, r.mix_offset)):
        at = by.setdefault(r.source, 0)
        assert r.mix_offset == at and r.mix_block == at // 20_000
        by[r.source] = at + len(r.text or "") + 1
        blocks[r.source] = max(blocks[r.source], -(-by[r.source] // 20_000))
        assert (r.mix_slot is None) == (r.source not in weights) == (r.mix_rank is None)
    parts = mixing.exact(weights)
    slot = {(r.source, r.mix_block): r.mix_slot for r in rows if r.mix_slot is not None}
    want = planned_slots(parts, blocks, 16)
    total = sum(parts.values())
    assert len(set(slot.values())) == len(slot)
    for (s, k), t in slot.items():
        assert k * total // parts[s] <= t < -(-(k + 1) * total // parts[s]) and t == want.get((s, k), t)
    ranks = sorted((r.mix_slot, r.mix_rank) for r in rows if r.mix_slot is not None)
    assert ranks == sorted(ranks, key=lambda x: x[1]) and 0 <= ranks[0][1] and ranks[-1][1] < 1
    files = mixing.mix_in_order(docs, weights=weights, block_chars=20_000, stretch=16).withColumn("part", F.spark_partition_id()).collect()
    assert len(files) == len(rows) and [r.doc_id for r in files if r.mix_slot is not None] == [r.doc_id for r in got.where("mix_slot is not null").orderBy(*mixing.order()).collect()]
    assert all(r.mix_slot is None for r in files[len([r for r in files if r.mix_slot is not None]) :])


def test_mixing_of_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7 * 10).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 1200).cast("string")).alias("source"))
    rows = mixing.mix(df, block_chars=16).collect()
    slots = {(r.source, r.mix_block): r.mix_slot for r in rows}
    assert len(rows) == 3000 and len({r.source for r in rows}) == 1200 and None not in slots.values() and len(set(slots.values())) == len(slots)


def test_mixing_edge(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (2, None, None), (3, "", "t"), (None, "x" * 9, "s"), (4, "y", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit("old")).withColumn("at", F.lit(1)).withColumn("n", F.lit(1)).withColumn("part", F.lit(2))
    got = mixing.mix(df, block_chars=4)
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "source", "at", "n", "part", "mix_block", "mix_slot", "mix_offset", "mix_rank"]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, {}).where("mix_slot is null").count() == len(rows)
    assert mixing.mix_in_order(df, weights={"t": 1.0}).first().source == "t"
    with pytest.raises(ValueError):
        mixing.mix(df, {"s": -1.0})
