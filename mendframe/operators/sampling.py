"""Splits, resampling and corruption, all ranked by hash.

Every function needs a unique row key; the same seed gives the same rows on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.functions.hashing import hash_hex, pick_index, unit
from mendframe.operators.profile import class_counts
from mendframe.operators.quantiles import fit_order_statistic
from mendframe.operators.ranking import PICKED, dense_index, mark_smallest, pick_smallest
from mendframe.session import materialise
from mendframe.operators.sizing import BROADCAST_ROWS, fits_broadcast, size_of, small_side


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null in any data column."""
    return df.filter(S.all_present(S.data_columns(df)))


def holdout_quotas(
    counts: DataFrame, share: float = K.HOLDOUT_SHARE, label: str = K.LABEL
) -> DataFrame:
    """Holdout rows per class.

    The training total is shared out by class size; rows left over by rounding down go to
    the largest remainders, smallest label first. The table has one row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    train_total = total - F.ceil(total * share)
    exact = F.col("n") * train_total / total
    floors = counts.withColumn("_exact", exact).withColumn("_train", F.floor("_exact"))
    spare = floors.withColumn("_spare", train_total - F.sum("_train").over(everything))
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.round(F.col("_exact") - F.col("_train"), 9).desc(), label
    )
    extra = (F.row_number().over(order) <= F.col("_spare")).cast("bigint")
    return spare.select(label, (F.col("n") - F.col("_train") - extra).alias("quota"))


def mark_holdout(
    df: DataFrame,
    share: float = K.HOLDOUT_SHARE,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Add ``_picked``: true for holdout rows, the same share of every class."""
    quotas = holdout_quotas(class_counts(df, label), share, label)
    return mark_smallest(df, quotas, [label], seed, "split", row_id)


def stratified_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Training and holdout rows: disjoint, together the whole table."""
    marked = mark_holdout(df, **options)
    return marked.filter(~F.col(PICKED)).drop(PICKED), marked.filter(PICKED).drop(PICKED)


def undersample(
    df: DataFrame, seed: int = K.SEED, label: str = K.LABEL, row_id: str = K.ROW_ID
) -> DataFrame:
    """Complete rows only, every class cut to the size of the smallest."""
    clean = complete_rows(df)
    counts = class_counts(clean, label)
    smallest = F.min("n").over(Window.partitionBy(F.lit(0)))
    quotas = counts.select(label, smallest.alias("quota"))
    return mark_smallest(clean, quotas, [label], seed, "under", row_id).filter(PICKED).drop(PICKED)


def balance_or_drop_nulls(df: DataFrame, strategy: str = "undersample", **options) -> DataFrame:
    """Undersample; any other strategy only drops rows with nulls."""
    return undersample(df, **options) if strategy == "undersample" else complete_rows(df)


def oversample(
    df: DataFrame,
    target_class: int,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Complete rows plus draws with replacement from one class, up to the largest class.

    Draws are spread evenly over a range, so a tiny class drawn very often does not end up
    in one task: its rows are broadcast when few, and else hit about equally often.
    """
    clean = complete_rows(df)
    sizes = (
        clean.groupBy(label)
        .agg(*size_of(clean, F.col(label) == target_class), F.count(label).alias("n"))
        .agg(
            F.max("n").alias("largest"),
            F.coalesce(F.max("rows"), F.lit(0)).alias("own"),
            F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"),
            F.count_if(F.col("n") > 0).alias("classes"),
        )
        .first()
    )
    if sizes["classes"] < 2 or not sizes["own"] or sizes["largest"] <= sizes["own"]:
        return df if sizes["classes"] < 2 else clean
    indexed = dense_index(clean.filter(F.col(label) == target_class), seed, "over", row_id)
    draws = df.sparkSession.range(sizes["largest"] - sizes["own"]).select(
        F.col("id").alias("_draw"),
        pick_index(unit(seed, "over/draw", "id"), sizes["own"]).alias("_idx"),
    )
    small = fits_broadcast(sizes["own"], sizes["bytes"], broadcast_rows)
    drawn = draws.join(F.broadcast(indexed) if small else indexed, "_idx")
    drawn = with_new_keys(drawn, df, row_id)
    return clean.unionByName(drawn.select(*clean.columns))


def with_new_keys(added: DataFrame, df: DataFrame, row_id: str) -> DataFrame:
    """Key added rows by their draw number.

    Whole-number keys go on downwards from below the smallest, text keys become ``new-<number>``
    behind the largest key, so that they meet no key there is.
    """
    kind = df.schema[row_id].dataType
    if isinstance(kind, T.StringType):
        largest = df.agg(F.max(row_id).alias("hi")).first()["hi"] or ""
        return added.withColumn(row_id, F.concat(F.lit(f"{largest}-new-"), F.col("_draw").cast("string")))
    lowest = df.agg(F.min(row_id).alias("lo")).first()["lo"] or 0
    key = F.lit(min(0, lowest) - 1) - F.col("_draw")
    return added.withColumn(row_id, key.cast(kind))


def mark_golden(
    df: DataFrame,
    count: int = K.GOLDEN_ROWS,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Add ``_golden``: half of ``count`` rows from each class large enough to give them."""
    quotas = class_counts(df, label).filter(F.col("n") >= count // 2).select(
        label, F.lit(count // 2).cast("bigint").alias("quota")
    )
    return mark_smallest(df, quotas, [label], seed, "golden", row_id).withColumnRenamed(
        PICKED, "_golden"
    )


def golden_check(golden: DataFrame, current: DataFrame, row_id: str = K.ROW_ID) -> DataFrame:
    """State of each reference row in the current table: intact, changed or missing."""
    data = [c for c in S.data_columns(golden) if c in current.columns]
    golden = small_side(golden)
    # The few reference keys go to the current table, which is scanned and not shuffled.
    here = current.join(golden.select(row_id), row_id, "left_semi")
    now = here.select(row_id, *[F.col(c).alias(f"_now_{c}") for c in data], F.lit(True).alias("_here"))
    # A changed table may have several copies of a row: any intact copy counts.
    same = F.lit(True)
    for c in data:
        same = same & F.col(c).eqNullSafe(F.col(f"_now_{c}"))
    joined = golden.join(now, row_id, "left").withColumn(
        "_state", F.when(F.col("_here").isNull(), 2).when(same, 0).otherwise(1)
    )
    best = joined.groupBy(row_id).agg(F.min("_state").alias("_state"))
    return best.select(
        row_id,
        F.element_at(
            F.array(F.lit("intact"), F.lit("changed"), F.lit("missing")), F.col("_state") + 1
        ).alias("state"),
    )


# Corruption.


def inject_missing(
    df: DataFrame,
    share: float,
    columns: list[str] | None = None,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Null out each feature cell with the given probability; rows marked golden are spared."""
    columns = columns or S.feature_columns(df, label)
    spared = F.col("_golden") if "_golden" in df.columns else F.lit(False)
    return df.withColumns(
        {
            c: F.when(~spared & (unit(seed, f"missing/{c}", row_id) < share), F.lit(None)).otherwise(
                F.col(c)
            )
            for c in columns
        }
    )


def flip_labels(
    df: DataFrame,
    share: float,
    count: int | None = None,
    seed: int = K.SEED,
    stream: str = "noise",
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Flip the 0/1 label of exactly floor(n * share) rows; rows marked golden are spared.

    ``count`` sets the number of rows directly.
    """
    spared = F.col("_golden") if "_golden" in df.columns else F.lit(False)
    if count is None:
        count = int(df.filter(~spared).count() * share)
    marked = pick_smallest(df, count, seed, stream, row_id, where=~spared)
    flipped = F.when(F.col(PICKED), S.flip_label(label)).otherwise(F.col(label))
    return marked.withColumn(label, flipped.cast(df.schema[label].dataType)).drop(PICKED)


def relabel_share(df: DataFrame, threshold: float = 0.3, seed: int = K.SEED, **options) -> DataFrame:
    """Complete rows with max(1, floor(n * threshold * 0.3)) labels flipped at random."""
    clean = complete_rows(df)
    count = max(1, int(clean.count() * threshold * 0.3))
    return flip_labels(clean, 0.0, count, seed, "relabel", **options)


def thin_class(
    df: DataFrame,
    keep: float,
    target_class: int = 1,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Keep max(1, floor(n * keep)) rows of one class, chosen at random, and all other rows."""
    quotas = class_counts(df, label).filter(F.col(label) == target_class).select(
        label, F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") * keep)).alias("quota")
    )
    marked = mark_smallest(df, quotas, [label], seed, "thin", row_id)
    kept = F.col(PICKED) | ~F.col(label).eqNullSafe(F.lit(target_class))
    return marked.filter(kept).drop(PICKED)


def drop_first_of_class(
    df: DataFrame,
    share: float = 0.4,
    target_class: int = 1,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Drop the first floor(n * share) rows of one class in key order.

    The cut key is an exact order statistic of the keys of that class.
    """
    own = df.filter(F.col(label) == target_class)
    count = int(own.count() * share)
    if count == 0:
        return df
    cut = fit_order_statistic(own, row_id, count - 1)
    first = F.col(label).eqNullSafe(F.lit(target_class)) & (F.col(row_id) <= F.lit(cut))
    return df.filter(~first)


def shuffled(df: DataFrame, seed: int = K.SEED, row_id: str = K.ROW_ID) -> DataFrame:
    """Random but repeatable order for an export; a range-partitioned sort."""
    return df.orderBy(hash_hex(seed, "shuffle", row_id), row_id)


def corrupt(
    df: DataFrame, difficulty: str = "easy", golden: int = K.GOLDEN_ROWS, seed: int = K.SEED, **options
) -> DataFrame:
    """Spare some rows, then add nulls, label noise and class imbalance of a difficulty level."""
    recipe = K.CORRUPTION[difficulty]
    # Each step below reads its input several times: the flagged table is stored once.
    marked = materialise(mark_golden(df, golden, seed, **options), "golden")
    holes = inject_missing(marked, recipe["missing"], seed=seed, **options)
    noisy = materialise(flip_labels(holes, recipe["noise"], seed=seed, **options), "noisy")
    return thin_class(noisy, recipe["keep"], seed=seed, **options)
