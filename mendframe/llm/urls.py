"""URL filters: domain rules first, gradient-boosted trees on lexical features for the rest.

Training labels are the verdicts of the rules on the urls they fit; the trees see only lexical
features, none of which is computed from a label. Everything is column expressions and Spark ML.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged by the trees on features of the empty parts; repeated rows are judged alike; if no rule
fits any url there is nothing to learn from and the rest gets ``default``; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import hash_sample
from mendframe.session import materialise

FEATURES = [
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "host_labels",
    "digit_ratio",
    "host_entropy",
    "path_entropy",
    "params",
    "hyphens",
    "has_fragment",
    "suffix_length",
    "suffix_share",
    "label_length",
    "host_hyphens",
    "first_length",
    "first_entropy",
    "first_vowels",
    "first_share",
]
#: Labelled urls the trees are fitted on, at most (about).
TRAIN_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits the host or a parent domain and the path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution; 0 for the empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the parts of the url and its lexical features; the shares count all rows.

    ``suffix_share`` is the log share of all urls with the same last host label, ``first_share`` of those
    with the same first part of the path. Both are joined by that text, hot ones included, so both
    sides are narrow and AQE may split the hot one.
    """
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    count = lambda s, c: (F.length(s) - F.length(F.translate(s, c, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    params = F.when(query == "", 0.0).otherwise(count(query, "&") + 1)
    parts = (
        pages.select("page_id", "url")
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("first", F.regexp_extract("path", r"(?s)^/([^/]*)", 1))
    )
    first, label = F.col("first"), F.substring_index("host", ".", 1)
    vowels = F.length(first) - F.length(F.translate(first, "aeiouAEIOU", ""))
    measured = parts.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        count(path, "/").alias("depth"),
        F.when(host == "", 0.0).otherwise(count(host, ".") + 1).alias("host_labels"),
        F.when(url == "", 0.0).otherwise(digits / F.length(url)).alias("digit_ratio"),
        entropy(host).alias("host_entropy"),
        entropy(path).alias("path_entropy"),
        params.alias("params"),
        count(url, "-").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.length("suffix").cast("double").alias("suffix_length"),
        F.length(label).cast("double").alias("label_length"),
        count(host, "-").alias("host_hyphens"),
        F.length(first).cast("double").alias("first_length"),
        entropy(first).alias("first_entropy"),
        F.when(first == "", 0.0).otherwise(vowels / F.length(first)).alias("first_vowels"),
        F.xxhash64("url").alias("url_hash"),
    )
    for name in ("suffix", "first"):
        seen = materialise(parts.groupBy(name).agg(F.count("*").alias("rows")), f"url-{name}")
        total = seen.agg(F.sum("rows")).first()[0] or 1
        measured = measured.join(seen, name).withColumn(f"{name}_share", F.log(F.col("rows") / total)).drop("rows")
    return measured


def fit_trees(labelled: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7) -> GBTClassificationModel:
    """Fit on rows with ``FEATURES`` and ``block`` (0 or 1), stored beforehand."""
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    return GBTClassifier(
        labelCol="block", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed
    ).fit(assembled.select("features", "block"))


def judge(
    pages: DataFrame, rules: dict[str, str], train_rows: int = TRAIN_ROWS, default: str = "allow"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else the trees' (score: block)."""
    rows = materialise(
        lexical(pages).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).drop("url", "suffix", "first"),
        "url-features",
    )
    verdicts = reduce(
        lambda acc, rule: F.when(F.col("rule") == rule, rules[rule]).otherwise(acc), rules, F.lit(None).cast("string")
    )
    labelled = rows.where("rule is not null").withColumn("block", (verdicts == "block").cast("double"))
    # Rows alike in id and url teach once; the draw goes by both, so neither null nor repeated ids upset it.
    once = labelled.dropDuplicates(["page_id", "url_hash"])
    sample = materialise(hash_sample(once, train_rows, "page_id", "url_hash").select(*FEATURES, "block"), "url-labelled")
    seen = sample.agg(F.min("block"), F.max("block")).first()
    if seen[0] is None:
        scored = rows.withColumn("score", F.lit(1.0 if default == "block" else 0.0))
    elif seen[0] == seen[1]:
        scored = rows.withColumn("score", F.lit(seen[0]))
    else:
        model = fit_trees(sample)
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(verdicts, by_trees).alias("verdict"), "score"
    )
