"""Mix sources to target weights: hash-random order, prefix sums of sizes, exact cuts.

Every document gets a random key that is a hash of its id. The key space is cut into equal
ranges, so a source of any size is spread evenly over them; sizes are summed per (source, range),
offsets are running sums over those few ranges, and only within one range are documents sorted.
A source's budget is then cut at an exact word: whole epochs first, then the words up to the cut.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own, ordered last; repeated rows are documents of their own; rows without an id are kept and
ordered by a common key; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import WORD
from mendframe.session import materialise

#: Ranges of the key space; documents are sorted only within (source, range).
RANGES = 4096
KEY_BITS = 60
#: A source is repeated at most this many times.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: int) -> Column:
    """A random whole number of ``KEY_BITS`` bits that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Share all words among sources by weight, none above ``max_epochs`` times its size.

    ``sizes`` has one row per source (``source_key``, ``source_size``). Resharing the excess by
    weight until none is above ends at one level for all open sources: the sources closed at their
    limit are those with the smallest limit per weight, so one ordered pass over sources finds it.
    """
    order = Window.orderBy("source_key")
    per_weight = Window.orderBy("per_weight", "source_key")
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    before = per_weight.rowsBetween(Window.unboundedPreceding, -1)
    after = per_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    limited = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("per_weight", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("closed", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("closed")) / F.col("open_weight"))
    )
    # Closing a source below the level raises it, closing one above lowers it: the largest is the last.
    level = F.max("level").over(everything)
    return limited.withColumn("final_level", level).select(
        "source_key",
        "source_size",
        F.least("limit", F.coalesce(F.col("final_level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def mix(docs: DataFrame, weights: list[int], seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: its size, its source's size and target, whole epochs and words taken."""
    narrow = materialise(
        docs.select(
            "doc_id",
            F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
            word_count(F.col("text")).alias("size"),
            mix_key(F.col("doc_id"), seed).alias("key"),
        ).withColumn("range", F.shiftright("key", KEY_BITS - (RANGES - 1).bit_length()).cast("int")),
        "mix-sizes",
    )
    ranges = materialise(
        narrow.groupBy("source_key", "range").agg(F.sum("size").alias("range_size")), "mix-ranges"
    )
    targets = source_targets(
        ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, max_epochs
    )
    by_range = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
        .drop("range_size")
        .join(targets, "source_key")
    )
    within = (
        Window.partitionBy("source_key", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.round("target").cast("long")
    return (
        narrow.join(offsets, ["source_key", "range"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("left", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("left") - F.col("before"))))
        .select(
            "doc_id",
            "source_key",
            "size",
            "source_size",
            "target",
            F.col("epochs").cast("int").alias("epochs"),
            "part",
            (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def cut_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words, white space between them kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, 1, words.cast("int")), "")


def mixed(docs: DataFrame, weights: list[int], seed: int = 0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: a row of ``docs`` per epoch it is in; the one at a cut ends at the cut.

    Rows that share an id (or have none) share the largest share of the mix that one of them got.
    """
    plan = (
        mix(docs, weights, seed, max_epochs)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("epochs").alias("_epochs"), F.max("part").alias("_part"), F.max("size").alias("_size"))
    )
    copies = F.sequence(F.lit(1), F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0))
    partial = (F.col("_copy") > F.col("_epochs")) & (F.col("_part") < F.col("_size"))
    rows = docs.join(plan, docs["doc_id"].eqNullSafe(plan["_id"])).withColumn("_copy", F.explode(copies))
    text = F.when(partial, cut_words(F.col("text"), F.col("_part"))).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(partial, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
