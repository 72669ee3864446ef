"""URL filters: rules, then a path-template tree per host, in DataFrame functions only.

Paths become typed segments (digits and long hex are '#'). Level by level the branches below one
template are compared: a branch whose children have another mix of shapes (end, number, number with
extension, mixed, word) than its siblings together, by more than chance, goes to the wildcard of its
main shape, the others to '*', and wildcards with the mix of '*' are part of it; a branch whose
labelled share of bad pages differs from its wildcard by more than chance keeps its own segment. So the many values of a variable segment, each too rare
to differ, become one wildcard, unlabelled branches are judged with the labelled ones that they
resemble, and no count of branches decides anything. A template is rejected if it has labelled pages
enough and its smoothed share of bad ones is high.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verifold.llm.storage import save

#: Rules as (verdict, host, path); a rule fits its host and all subdomains, the longest one wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shapes of a child segment and what they match; the first that fits counts, and no segment is 'end'.
SHAPES = (("number", "^#$"), ("extension", r"^#\.[a-z]+$"), ("mixed", "#"), ("word", ""))
KINDS = ("end", *(s for s, _ in SHAPES))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or no '://'."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text of the longest rule that fits and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def typed_segments(path: Column) -> Column:
    """All segments with digits and long hex as '#'."""
    typed = F.regexp_replace(F.regexp_replace(path, r"[0-9a-f]{8,}", "#"), r"[0-9]+", "#")
    return F.filter(F.split(typed, "/"), lambda x: x != "")


def _shape(segment: Column) -> Column:
    out = F.when(segment.isNull(), F.lit("end"))
    for name, rx in SHAPES:
        out = out.when(segment.rlike(rx), F.lit(name))
    return out


def _differs(some: Column, n: Column, all_some: Column, all_n: Column, z: float) -> Column:
    """Whether a share lies further from the pooled one than chance and one row more or less explain."""
    pooled = F.try_divide(all_some, all_n)
    far = F.abs(F.try_divide(some, n) - pooled) > z * F.sqrt(F.try_divide(pooled * (1 - pooled), n)) + F.try_divide(F.lit(1.0), n)
    return F.coalesce(far, F.lit(False))


def _two_differ(a: Column, n: Column, b: Column, m: Column, z: float) -> Column:
    """The same for the shares of two samples; false if one is absent."""
    pooled, per_row = (a + b) / (n + m), F.lit(1.0) / n + F.lit(1.0) / m
    return F.coalesce(F.abs(a / n - b / m) > z * F.sqrt(pooled * (1 - pooled) * per_row) + per_row, F.lit(False))


def _parts(rows: DataFrame, level: int, z: float) -> DataFrame:
    """host, template, segment and the part of the template that stands for it."""
    key, shape = ["host", "template"], _shape(F.get("segments", F.lit(level + 1)))
    children = rows.where("segment is not null").groupBy(*key, "segment").agg(
        F.sum("n_pages").alias("n"), F.sum("n_labelled").alias("labelled"), F.sum("n_bad").alias("bad"),
        *(F.sum(F.when(shape == k, F.col("n_pages")).otherwise(0)).alias(f"n_{k}") for k in KINDS))
    pooled = children.groupBy(*key).agg(F.count("*").alias("n_children"), F.sum("n").alias("all_n"), *(F.sum(f"n_{k}").alias(f"all_{k}") for k in KINDS))
    odd = reduce(lambda a, b: a | b, (_differs(F.col(f"n_{k}"), F.col("n"), F.col(f"all_{k}"), F.col("all_n"), z) for k in KINDS))
    main = F.coalesce(*(F.when(F.col(f"n_{k}") == F.greatest(*(f"n_{x}" for x in KINDS)), F.lit(k)) for k in KINDS))
    classed = children.join(pooled, key).withColumn("class", F.when(odd, F.concat(F.lit("*"), main)).otherwise(F.lit("*")))
    # A parent has one class for each shape at most, and '*'. Classes with the mix of '*' are part of it.
    each = classed.groupBy(*key, "class").agg(F.sum("n").alias("n"), *(F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS))
    star = Window.partitionBy(*key)
    plain = {c: F.max(F.when(F.col("class") == "*", F.col(c))).over(star) for c in ("n", *(f"n_{k}" for k in KINDS))}
    apart = reduce(lambda a, b: a | b, (_two_differ(F.col(f"n_{k}"), F.col("n"), plain[f"n_{k}"], plain["n"], z) for k in KINDS))
    wilds = each.select(*key, "class", F.when(apart, F.col("class")).otherwise(F.lit("*")).alias("wild"))
    classed = classed.join(wilds, [*key, "class"]).select(*key, "segment", "wild", "n_children", "labelled", "bad")
    shares = classed.groupBy(*key, "wild").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    own = (F.col("n_children") == 1) | _differs(F.col("bad"), F.col("labelled"), F.col("all_bad"), F.col("all_labelled"), z)
    return classed.join(shares, [*key, "wild"]).select(*key, "segment", F.when(own, F.col("segment")).otherwise(F.col("wild")).alias("part"))


def templates(pages: DataFrame, least: int = 5, z: float = 3.0) -> DataFrame:
    """host, segments, template, n_pages, n_labelled, n_bad for each distinct host and typed path.

    pages: host, segments, bad (true, false or null for unlabelled). The numbers are the
    template's. The tree goes as deep as templates with ``least`` labelled pages do; below, no
    template can be rejected, and the segments left are appended as they are.
    """
    paths = pages.groupBy("host", "segments").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n_labelled"), F.count_if("bad").alias("n_bad"))
    rows = save(paths.withColumn("template", F.lit("")), "paths").df
    kept, level = [], 0
    while not rows.isEmpty():
        groups = rows.groupBy("host", "template").agg(F.sum("n_labelled").alias("labelled"), F.max(F.size("segments")).alias("depth"))
        live = groups.where((F.col("labelled") >= least) & (F.col("depth") > level)).select("host", "template", F.lit(True).alias("live"))
        here = rows.withColumn("segment", F.get("segments", F.lit(level)))
        step = _parts(here.join(live, ["host", "template"], "left_semi"), level, z)
        rest = F.transform(F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments"), F.lit(1))), lambda x: F.concat(F.lit("/"), x))
        found = here.join(live, ["host", "template"], "left").join(step, ["host", "template", "segment"], "left")
        more = F.when(F.col("live"), F.coalesce(F.concat(F.lit("/"), "part"), F.lit(""))).otherwise(F.array_join(rest, ""))
        # Each level is written: it is read several times in the next one.
        done = save(found.select("host", "segments", "n_pages", "n_labelled", "n_bad", F.concat("template", more).alias("template"), (F.col("live").isNotNull() & F.col("segment").isNotNull()).alias("open")), f"level{level}").df
        kept.append(done.where("not open").drop("open"))
        rows, level = done.where("open").drop("open"), level + 1
    paths = reduce(DataFrame.unionByName, kept, rows)
    sums = paths.groupBy("host", "template").agg(F.sum("n_pages").alias("n_pages"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad"))
    return paths.select("host", "segments", "template").join(sums, ["host", "template"])


def filter_urls(pages: DataFrame, rules=RULES, label: Column | None = None, least: int = 5, smoothing: float = 2.0, reject: float = 0.8, z: float = 3.0, unlabelled: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row.

    Needs columns page_id and url; ``label`` (true: bad) may use others, and by default the rules'
    verdicts are the labels. verdict is the rule's; else block if the page's template has ``least``
    labelled pages and its purity reaches ``reject``, else allow. The purity is (bad + smoothing / 2) /
    (labelled + unlabelled * other pages + smoothing). ``unlabelled`` is 1 by default where the rules are the
    labels: a page that no rule meets speaks against a template of blocked ones, and labels of one kind
    alone don't condemn it. With labels of a sample of pages it is 0: the others say nothing. Null urls and urls without '://' have empty host and path. Repeated rows count and come
    back as often.
    """
    host, path = split_url(F.col("url"))
    split = pages.withColumns({"url_host": host, "url_path": path})
    rule, verdict = matched_rule(F.col("url_host"), F.col("url_path"), rules)
    bad = (F.col("rule_verdict") == "block") if label is None else label
    marked = split.withColumns({"url_rule": rule, "rule_verdict": verdict}).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), "rule_verdict",
        typed_segments(F.col("url_path")).alias("segments"), bad.alias("bad"))
    tree = templates(marked, least, z)
    share = (1.0 if label is None else 0.0) if unlabelled is None else unlabelled
    purity = (F.col("n_bad") + smoothing / 2) / (F.col("n_labelled") + share * (F.col("n_pages") - F.col("n_labelled")) + smoothing)
    own = F.when((F.col("n_labelled") >= least) & (purity >= reject), F.lit("block")).otherwise(F.lit("allow"))
    return marked.join(tree, ["host", "segments"]).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "template", F.round(purity, 6).alias("purity"))


def oracle_sql(rules=RULES, least: int = 5, smoothing: float = 2.0, reject: float = 0.8, z: float = 3.0, levels: int = 6) -> str:
    """The same as DuckDB SQL over the view pages, for templates of at most ``levels`` segments."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    far = lambda a, n, b, m: f"({n} > 0 AND abs({a}::DOUBLE / {n} - {b}::DOUBLE / {m}) > {z} * sqrt({b}::DOUBLE / {m} * (1 - {b}::DOUBLE / {m}) / {n}) + 1.0::DOUBLE / {n})"
    two = lambda a, n, b, m: f"(abs({a}::DOUBLE / {n} - {b}::DOUBLE / {m}) > {z} * sqrt(({a} + {b})::DOUBLE / ({n} + {m}) * (1 - ({a} + {b})::DOUBLE / ({n} + {m})) * (1.0::DOUBLE / {n} + 1.0::DOUBLE / {m})) + (1.0::DOUBLE / {n} + 1.0::DOUBLE / {m}))"
    sql = [
        f"""WITH split AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
        f"""ruled AS (SELECT *, {case([h + p for _, h, p in ordered])} AS rule, {case([w for w, _, _ in ordered])} AS rule_verdict,
        list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-f]{{8,}}', '#', 'g'), '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS segments FROM split)""",
        "marked AS (SELECT *, rule_verdict = 'block' AS bad FROM ruled)",
        "p0 AS (SELECT host, segments, count(*) AS n, count(bad) AS labelled, count(*) FILTER (WHERE bad) AS bad, '' AS template, true AS open FROM marked GROUP BY host, segments)",
    ]
    shape = lambda s: "CASE WHEN " + s + " IS NULL THEN 'end' " + " ".join(f"WHEN regexp_matches({s}, '{rx}') THEN '{name}'" for name, rx in SHAPES) + " END"
    for k in range(levels):
        sums = ", ".join(f"sum(CASE WHEN shape = '{s}' THEN n ELSE 0 END) AS n_{s}" for s in KINDS)
        pooled = ", ".join(f"sum(n_{s}) OVER w AS all_{s}" for s in KINDS)
        plain = ", ".join(f"max({c}) FILTER (WHERE class = '*') OVER w AS star_{c}" for c in ("n", *(f"n_{s}" for s in KINDS)))
        apart = " OR ".join(two(f"n_{s}", "n", f"star_n_{s}", "star_n") for s in KINDS)
        totals = ", ".join(f"sum(n_{s}) AS n_{s}" for s in KINDS)
        odd = " OR ".join(far(f"n_{s}", "n", f"all_{s}", "all_n") for s in KINDS)
        main = "CASE " + " ".join(f"WHEN n_{s} = greatest({', '.join(f'n_{x}' for x in KINDS)}) THEN '{s}'" for s in KINDS) + " END"
        sql += [
            f"h{k} AS (SELECT *, segments[{k + 1}] AS segment, {shape(f'segments[{k + 2}]')} AS shape, open AND sum(CASE WHEN open THEN labelled ELSE 0 END) OVER w >= {least} AND max(CASE WHEN open THEN len(segments) ELSE 0 END) OVER w > {k} AS live FROM p{k} WINDOW w AS (PARTITION BY host, template, open))",
            f"c{k} AS (SELECT host, template, segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, {sums} FROM h{k} WHERE live AND segment IS NOT NULL GROUP BY ALL)",
            f"d{k} AS (SELECT *, CASE WHEN {odd} THEN '*' || {main} ELSE '*' END AS class FROM (SELECT *, count(*) OVER w AS n_children, sum(n) OVER w AS all_n, {pooled} FROM c{k} WINDOW w AS (PARTITION BY host, template)))",
            f"w{k} AS (SELECT host, template, class, CASE WHEN coalesce({apart}, false) THEN class ELSE '*' END AS wild FROM (SELECT *, {plain} FROM (SELECT host, template, class, sum(n) AS n, {totals} FROM d{k} GROUP BY ALL) WINDOW w AS (PARTITION BY host, template)))",
            f"s{k} AS (SELECT host, template, segment, CASE WHEN n_children = 1 OR {far('bad', 'labelled', 'all_bad', 'all_labelled')} THEN segment ELSE wild END AS part FROM (SELECT d.*, wild, sum(labelled) OVER w AS all_labelled, sum(bad) OVER w AS all_bad FROM d{k} d JOIN w{k} USING (host, template, class) WINDOW w AS (PARTITION BY host, template, wild)))",
            f"""p{k + 1} AS (SELECT h.host, h.segments, n, labelled, bad, h.template || CASE WHEN NOT open THEN '' WHEN live THEN coalesce('/' || part, '') ELSE array_to_string(list_transform(segments[{k + 1}:], lambda x: '/' || x), '') END AS template,
            live AND h.segment IS NOT NULL AS open FROM h{k} h LEFT JOIN s{k} s ON live AND h.host = s.host AND h.template = s.template AND h.segment = s.segment)""",
        ]
    purity = f"((n_bad + {smoothing / 2}) / (n_pages + {smoothing}))"
    sql.append(f"tree AS (SELECT host, segments, template, sum(n) OVER w AS n_pages, sum(labelled) OVER w AS n_labelled, sum(bad) OVER w AS n_bad FROM p{levels} WINDOW w AS (PARTITION BY host, template))")
    return ",\n".join(sql) + f"""
    SELECT page_id, m.host, path, rule, coalesce(rule_verdict, CASE WHEN n_labelled >= {least} AND {purity} >= {reject} THEN 'block' ELSE 'allow' END) AS verdict,
    template, round({purity}, 6) AS purity FROM marked m JOIN tree t ON m.host = t.host AND m.segments = t.segments"""
