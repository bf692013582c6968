"""New rows: interpolation inside a class, neighbour interpolation, generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.functions.hashing import hex_to_unit, normal, pick_index, unit
from mendframe.operators import sampling
from mendframe.operators.neighbours import nearest_neighbours, vector_of
from mendframe.operators.profile import class_counts
from mendframe.operators.ranking import dense_index
from mendframe.operators.sizing import BROADCAST_ROWS, fits_broadcast, size_of
from mendframe.session import materialise


def interpolate_rows(
    df: DataFrame,
    target_class: int,
    n_to_add: int,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Append rows that are random convex mixes of two distinct complete rows of a class.

    Numeric features are mixed; other features come from the first parent. The original
    rows stay as they are, nulls included.
    """
    own = sampling.complete_rows(df).filter(F.col(label) == target_class)
    size = own.agg(*size_of(own, F.lit(True))).first()
    n, small = size["rows"], fits_broadcast(size["rows"], size["bytes"], broadcast_rows)
    if n < 2 or n_to_add <= 0:
        return df
    features = S.feature_columns(df, label)
    numeric = set(S.numeric_features(df, label))
    indexed = dense_index(own, seed, "mix", row_id).select("_idx", *features)
    first = pick_index(unit(seed, "mix/a", "id"), n)
    second = pick_index(unit(seed, "mix/b", "id"), n - 1)
    draws = df.sparkSession.range(n_to_add).select(
        F.col("id").alias("_draw"),
        first.alias("_i"),
        (second + (second >= first).cast("bigint")).alias("_j"),
        unit(seed, "mix/alpha", "id").alias("_alpha"),
    )

    def parent(name: str, index: str) -> DataFrame:
        side = indexed.select(
            F.col("_idx").alias(index), *[F.col(c).alias(f"{name}{i}") for i, c in enumerate(features)]
        )
        return F.broadcast(side) if small else side

    mixed = draws.join(parent("_a", "_i"), "_i").join(parent("_b", "_j"), "_j")
    rows = mixed.select(
        "_draw",
        *[
            (
                S.interpolate(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col("_alpha"))
                if c in numeric
                else F.col(f"_a{i}")
            ).alias(c)
            for i, c in enumerate(features)
        ],
        F.lit(target_class).cast(df.schema[label].dataType).alias(label),
    )
    if row_id in df.columns:
        rows = sampling.with_new_keys(rows, df, row_id)
    return df.unionByName(rows.drop("_draw"), allowMissingColumns=True)


def smote(
    df: DataFrame,
    k: int = K.SMOTE_NEIGHBOURS,
    seed: int = K.SEED,
    label: str = K.LABEL,
    row_id: str = K.ROW_ID,
    **options,
) -> DataFrame:
    """Complete rows, with every smaller class grown to the largest by mixing each drawn row
    with one of its k nearest rows of the same class.

    Classes without k neighbours stay as they are (``smote_plan`` names them), and so does the
    whole table with fewer than 20 complete rows. All classes are grown by the same few jobs.
    """
    clean = sampling.complete_rows(df)
    plan = materialise(smote_plan(clean, k, label), "smote-plan")
    total = plan.agg(F.sum("n").alias("n"), F.sum("n_to_add").alias("more")).first()
    if (total["n"] or 0) < K.MIN_TRAIN_ROWS or not total["more"]:
        return df
    features = S.numeric_features(df, label)
    grown = plan.filter(F.col("n_to_add") > 0)
    own = clean.join(grown.select(label), label, "left_semi").select(
        F.col(row_id).alias("id"), F.col(label).alias("_class"), vector_of(features).alias("vec")
    )
    own = materialise(own, "smote-rows")
    near = nearest_neighbours(own, k, seed, by="_class", **options).select("id", "rank", "neighbour")
    indexed = dense_index(own, seed, "smote", "id", by="_class")
    # Draws 0, 1, ... of each class: spread by thousands, then one by one.
    thousands = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_to_add") - 1) / DRAWS)))
    ones = F.explode(F.sequence(F.col("_t") * DRAWS, (F.col("_t") + 1) * DRAWS - 1))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    draws = (
        grown.withColumn("_offset", F.coalesce(F.sum("n_to_add").over(before), F.lit(0)))
        .withColumn("_t", thousands)
        .repartition(F.col(label), F.col("_t"))
        .withColumn("_i", ones)
        .filter(F.col("_i") < F.col("n_to_add"))
    )

    def drawn(what: str):
        name = F.concat(F.lit(f"{seed}|smote/"), F.col(label).cast("string"), F.lit(f"/{what}|"), F.col("_i").cast("string"))
        return hex_to_unit(F.md5(name))

    draws = draws.select(
        F.col(label).alias("_class"),
        (F.col("_offset") + F.col("_i")).alias("_draw"),
        pick_index(drawn("row"), F.col("n")).alias("_idx"),
        (pick_index(drawn("near"), k) + 1).cast("int").alias("rank"),
        drawn("gap").alias("_gap"),
    )
    other = own.select(F.col("id").alias("neighbour"), F.col("vec").alias("_b"))
    mixed = draws.join(indexed, ["_class", "_idx"]).join(near, ["id", "rank"]).join(other, "neighbour")
    rows = mixed.select(
        "_draw",
        *[
            (F.col("vec")[i] + F.col("_gap") * (F.col("_b")[i] - F.col("vec")[i])).alias(c)
            for i, c in enumerate(features)
        ],
        F.col("_class").cast(df.schema[label].dataType).alias(label),
    )
    rows = sampling.with_new_keys(rows, clean, row_id).drop("_draw")
    return clean.unionByName(rows, allowMissingColumns=True)


#: Draws one task makes at a time.
DRAWS = 10_000


def smote_plan(df: DataFrame, k: int = K.SMOTE_NEIGHBOURS, label: str = K.LABEL) -> DataFrame:
    """One row per class: its rows, how many to add, and why a smaller class gets none."""
    counts = class_counts(sampling.complete_rows(df), label)
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    short = largest - F.col("n")
    few = (short > 0) & (F.col("n") <= k)
    return counts.select(
        label,
        "n",
        F.when(few, F.lit(0).cast("bigint")).otherwise(short).alias("n_to_add"),
        F.when(few, F.format_string("%d rows: too few for %d neighbours", F.col("n"), F.lit(k))).alias("skipped"),
    )


# Generated tables.

N_FEATURES = 10


def generate_table(
    keys: DataFrame,
    informative: int = 5,
    redundant: int = 2,
    separation: float = 0.8,
    seed: int = K.SEED,
    row_id: str = K.ROW_ID,
) -> DataFrame:
    """Ten features and a balanced 0/1 label for each key.

    Informative features are normal around plus or minus ``separation`` by class, with the
    sign alternating by feature; redundant ones are means of two informative neighbours;
    the rest is noise.
    """
    side = F.col("label") * 2 - 1
    base = keys.select(
        row_id, (unit(seed, "label", row_id) < 0.5).cast("int").alias("label")
    )
    signal = {
        f"feature_{i}": normal(seed, f"feature_{i}", row_id)
        + side * F.lit(separation if i % 2 == 0 else -separation)
        for i in range(informative)
    }
    mixed = {
        f"feature_{informative + i}": (
            F.col(f"feature_{i % informative}") + F.col(f"feature_{(i + 1) % informative}")
        )
        / 2
        for i in range(redundant)
    }
    noise = {
        f"feature_{i}": normal(seed, f"feature_{i}", row_id)
        for i in range(informative + redundant, N_FEATURES)
    }
    rows = base.withColumns({**signal, **noise}).withColumns(mixed)
    return rows.select(row_id, *[f"feature_{i}" for i in range(N_FEATURES)], "label")


def fallback_table(keys: DataFrame, meta: dict, seed: int = K.SEED) -> DataFrame:
    """Generated stand-in for a catalogued dataset, with the issues its entry mentions."""
    df = generate_table(keys, seed=seed)
    share = 0.12 if meta["difficulty_weight"] >= 2 else 0.05
    holes = sampling.inject_missing(df, share, [f"feature_{i}" for i in range(8)], seed)
    if any("imbalance" in issue.lower() for issue in meta.get("known_issues", [])):
        return sampling.drop_first_of_class(holes)
    return holes


def archetype_table(
    keys: DataFrame, archetype: str, difficulty: str = "easy", seed: int = K.SEED
) -> DataFrame:
    """Generated table of an archetype, corrupted at a difficulty level."""
    informative, redundant, separation = K.ARCHETYPES[archetype]
    df = generate_table(keys, informative, redundant, separation, seed)
    return sampling.corrupt(df, difficulty, seed=seed).withColumn("_archetype", F.lit(archetype))
