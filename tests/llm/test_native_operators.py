"""Mixing and url filters against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mendframe.llm import mixing, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


def expected_targets(sizes: dict, weights: list[int], most: int) -> dict:
    """Reshare the excess until none is above, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    closed, open_ = {}, set(order)
    while open_:
        level = (sum(sizes.values()) - sum(closed.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return closed | {s: level * weight[s] for s in open_}
        closed |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return closed


ROWS = (
    [(i, "a b c " * (i % 7), "web") for i in range(200)]
    + [(i, "x\ty\x0bz", None) for i in range(200, 205)]
    + [(300, None, "tiny"), (301, "", "tiny"), (302, "one\u00a0word", "tiny"), (None, "no id", "tiny"), (302, "one\u00a0word", "tiny")]
    + [(400, "w " * 5000, "Big"), (401, None, "empty")]
)


def test_mix_takes_exact_budgets(spark):
    got = mixing.mix(docs_of(spark, ROWS), [1, 2, 3]).collect()
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len(WORD.findall(text or ""))
    sizes["empty"] += 0
    want = expected_targets(sizes, [1, 2, 3], 3)
    taken = Counter()
    for row in got:
        source = None if row["source_key"] == "1" else row["source_key"][1:]
        assert row["source_size"] == sizes[source]
        assert row["target"] == pytest.approx(want[source])
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[source] += row["taken"]
    assert len(got) == len(ROWS)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_does_not_depend_on_partitions(spark):
    docs = docs_of(spark, ROWS)
    runs = [
        sorted(map(str, mixing.mix(d, [1, 2, 3], seed=4).collect())) for d in (docs.coalesce(1), docs.repartition(17))
    ]
    assert runs[0] == runs[1]


def test_mix_of_nothing(spark):
    assert mixing.mix(docs_of(spark, []), [1, 2, 3]).count() == 0
    assert mixing.mixed(docs_of(spark, []), [1, 2, 3]).count() == 0


def test_mixed_repeats_and_cuts(spark):
    rows = [(1, "a b  c\nd", "s"), (2, "e f g", "s"), (3, "x " * 40, "t")]
    docs = docs_of(spark, rows).withColumn("size", F.lit("extra"))
    plan = {r["doc_id"]: r for r in mixing.mix(docs, [3, 1]).collect()}
    texts: dict = {}
    for row in mixing.mixed(docs, [3, 1]).collect():
        assert row["size"] == "extra"
        texts.setdefault(row["doc_id"], []).append(row["text"])
    for i, row in plan.items():
        assert sum(len(WORD.findall(t)) for t in texts.get(i, [])) == row["taken"]
        source = next(t for d, t, _ in rows if d == i)
        assert all(source.startswith(t) for t in texts.get(i, []))


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def expected_rule(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = match.groups() if match else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = max(best or "", rule, key=len)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.NET/en/1?x=1&y=2#z", "https://example.net/EN/1", "http://net/",
    "http://a.net", "http://a.net?/x", "http://notexample.com/de/", "ftp://x.example.com/de/1", "http://example.org/fr/",
    "http://exampleorg/fr/", "http://u@a.net:80/x", "x://y://z.net/a", "http://a.org/fr", "http://ÄÖ.net/en/\n?q", "http://a.net/" + "p" * 50_000,
] + [f"https://{h}.example.{t}/{p}/{i}" for i in range(40) for h in ("www", "m") for t in ("com", "net", "org") for p in ("en", "de", "fr")]


def test_urls_follow_rules_first(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages, RULES).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate([*URLS, URLS[4]]):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == expected_rule(url)
        if got[i]["rule"]:
            assert got[i]["verdict"] == RULES[got[i]["rule"]]
        assert got[i]["verdict"] in ("allow", "block")
        assert (got[i]["verdict"] == "block") == (got[i]["score"] >= 0.5) or got[i]["rule"]


def test_urls_of_rows_without_ids(spark):
    """Null ids neither empty the sample of labelled urls nor fill it."""
    pages = spark.createDataFrame([(None, u, "") for u in URLS if u], "page_id long, url string, html string")
    got = urls.judge(pages, RULES, train_rows=60)
    assert got.count() == len([u for u in URLS if u])
    assert {r["verdict"] for r in got.where("rule is null").select("verdict").distinct().collect()} == {"allow", "block"}


def test_trees_on_held_out_urls(spark):
    """Fitted on half of the urls that a rule fits, right on the others, and no mere rule of suffixes."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.lexical(pages).withColumn("rule", urls.rule_column(F.col("host"), F.col("path"), RULES))
    block = F.col("rule").isin(*[r for r, verdict in RULES.items() if verdict == "block"])
    rows = rows.withColumn("block", block.cast("double")).withColumn("half", F.crc32(F.col("page_id").cast("string").cast("binary")) % 2)
    model = urls.fit_trees(rows.where("rule is not null and half = 0"))
    found = model.transform(urls.VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(rows))
    held = found.where("rule is not null and half = 1").agg(F.avg((F.col("prediction") == F.col("block")).cast("double")), F.count("*")).first()
    assert held[1] > 400 and held[0] >= 0.9
    per_suffix = found.where("rule is null").groupBy("suffix").agg(F.count_distinct("prediction").alias("n")).collect()
    # Every url of org that a rule fits is allowed, so only that can be learned there.
    assert {r["suffix"]: r["n"] for r in per_suffix} == {"com": 2, "org": 1}


def test_urls_without_labels(spark):
    kinds = "page_id long, url string, html string"
    assert urls.judge(spark.createDataFrame([], kinds), RULES).count() == 0
    lone = urls.judge(spark.createDataFrame([(1, "http://a.xyz/b", "")], kinds), RULES).first()
    assert (lone["rule"], lone["verdict"]) == (None, "allow")


def test_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("aaaa",), ("",), ("abcd",)], "t string")
    assert [r[0] for r in rows.select(urls.entropy(F.col("t"))).collect()] == pytest.approx([1.0, 0.0, 0.0, 2.0])
