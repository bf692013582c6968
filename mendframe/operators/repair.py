"""Repairs: statistics are fitted once, then enter a lazy transform as literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators import sampling, synth
from mendframe.operators.profile import class_counts, one_row, row_key
from mendframe.operators.quantiles import fit_medians
from mendframe.operators.ranking import value_codes
from mendframe.operators.sizing import small_side

ALL = "all"


def _targets(df: DataFrame, column: str, label: str) -> list[str]:
    numeric = S.numeric_features(df, label)
    return numeric if column == ALL else [c for c in numeric if c == column]


def zero_to_median(
    df: DataFrame, column: str = ALL, label: str = K.LABEL, **options
) -> DataFrame:
    """Zeros become the median of the non-zero values; nulls stay null."""
    columns = _targets(df, column, label)
    non_zero = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    medians = fit_medians(non_zero, columns, **options)
    return df.withColumns(
        {
            c: F.when(F.col(c) == 0, F.lit(medians[c]).cast("double")).otherwise(
                F.col(c).cast("double")
            )
            for c in columns
        }
    )


def impute(
    df: DataFrame, column: str = ALL, strategy: str = "median_impute", label: str = K.LABEL, **options
) -> DataFrame:
    """Fill nulls with the median or mean; any other strategy leaves the table as it is."""
    columns = _targets(df, column, label)
    if strategy == "median_impute":
        fills = fit_medians(df, columns, **options)
    elif strategy == "mean_impute" and columns:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        fills = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    else:
        return df
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c]).cast("double")) for c in columns}
    )


def log_transform(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, S.log1p_floor(column)) if column in df.columns else df


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any data column, or in the given ones only."""
    return df.filter(S.all_present(columns or S.data_columns(df)))


def remove_duplicates(df: DataFrame, row_id: str = K.ROW_ID) -> DataFrame:
    """Keep one row per group of equal rows: the one with the smallest key, if there is a key.

    Groups are found by digests of text columns and combined before the one shuffle, so of a large
    group each task sends one row; nothing is joined back.
    """
    data = S.data_columns(df)
    if row_id not in df.columns:
        return df.dropDuplicates(data)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = {c: f"k{i}" for i, c in enumerate(data)}
    texts = [c for c in data if isinstance(kinds[c], T.StringType)]
    rest = [c for c in df.columns if c not in keys and c != row_id]
    first = df.groupBy(*row_key(df, data)).agg(
        F.min(row_id).alias(row_id), *[F.any_value(c).alias(c) for c in texts], *[F.min_by(c, row_id).alias(c) for c in rest]
    )
    return first.select(*[F.col(keys[c]).alias(c) if c in keys and c not in texts else F.col(c) for c in df.columns])


def clip_column(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    return df.withColumn(column, S.clip(F.col(column).cast("double"), lower, upper))


def encode_categories(
    df: DataFrame,
    columns: list[str] | None = None,
    null_as_category: bool = False,
) -> DataFrame:
    """Replace text columns by 0..k-1 in order of the sorted distinct values.

    A sentinel set to null stays null unless ``null_as_category`` is set, which makes it the
    ordinary value ``nan``. The code tables hold one row per distinct value; they are
    broadcast if small, else joined by shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or [c for c in S.feature_columns(df) if isinstance(kinds[c], T.StringType)]
    for c in columns:
        value = F.coalesce(F.col(c), F.lit("nan")) if null_as_category else F.col(c)
        df = df.withColumn("_value", value)
        codes = small_side(value_codes(df, "_value", "_code"))
        # Rows without a value would all meet on one key: they stay out of the join.
        some, none = df.filter(F.col("_value").isNotNull()), df.filter(F.col("_value").isNull())
        coded = some.join(codes, "_value").unionByName(none.withColumn("_code", F.lit(None).cast("int")))
        df = coded.withColumn(c, F.col("_code")).drop("_value", "_code")
    return df


# Dispatch by recommendation type.

Repair = Callable[[DataFrame, dict], DataFrame]


def _impute_or_drop(df: DataFrame, rec: dict) -> DataFrame:
    if rec["strategy"] == "drop_rows":
        return drop_null_rows(df)
    return impute(df, rec.get("column") or ALL, rec["strategy"])


def _balance(df: DataFrame, rec: dict) -> DataFrame:
    if rec["strategy"] == "undersample_majority":
        return sampling.undersample(df)
    if rec["strategy"] == "oversample_minority":
        return sampling.oversample(df, rec["target_class"])
    return df


REPAIRS: dict[str, Repair] = {
    "zero_to_nan_impute": lambda df, rec: zero_to_median(df, rec.get("column") or ALL),
    "impute": _impute_or_drop,
    "log_transform": lambda df, rec: log_transform(df, rec["column"]),
    "drop_redundant": lambda df, rec: drop_column(df, rec["column"]),
    "augment": lambda df, rec: synth.interpolate_rows(df, rec["target_class"], rec["n_to_add"]),
    "balance": _balance,
    "remove_duplicates": lambda df, rec: remove_duplicates(df),
    "clip_outliers": lambda df, rec: clip_column(df, rec["column"], rec["lower"], rec["upper"]),
}


def apply_recommendation(df: DataFrame, rec: dict) -> DataFrame:
    """Run the repair of one recommendation; unknown types leave the table as it is."""
    repair = REPAIRS.get(rec["type"])
    return repair(df, rec) if repair else df


# Guard and report.


def deletion_share(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0.0), (before - after) / F.greatest(before, F.lit(1)))


def integrity_guard(
    before: DataFrame, after: DataFrame, limit: float = K.DELETION_LIMIT
) -> DataFrame:
    """One row: rows before and after, share deleted, and whether the repair is accepted."""
    counts = one_row(
        before.agg(F.count(F.lit(1)).alias("rows_before")),
        after.agg(F.count(F.lit(1)).alias("rows_after")),
    )
    share = deletion_share(F.col("rows_before"), F.col("rows_after"))
    return counts.select(
        "rows_before",
        "rows_after",
        S.round_even(share, 4).alias("deletion_pct"),
        (share <= limit).alias("accepted"),
    )


def guarded(
    df: DataFrame, rec: dict, limit: float = K.DELETION_LIMIT, apply: Repair = apply_recommendation
) -> tuple[DataFrame, bool]:
    """Apply a repair unless it deletes more than ``limit`` of the rows."""
    after = apply(df, rec)
    accepted = integrity_guard(df, after, limit).first()["accepted"]
    return (after, True) if accepted else (df, False)


def repair_report(
    before: DataFrame, rec: dict, label: str = K.LABEL, apply: Repair = apply_recommendation
) -> DataFrame:
    """One row on a repair that is carried out: what it did, rows and missing cells before and after."""
    after = apply(before, rec)
    column = rec.get("column")
    here = column in before.columns

    def facts(df: DataFrame, when: str, *more: Column) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{when}"),
            S.missing_cells(S.data_columns(df)).alias(f"missing_{when}"),
            *more,
        )

    zeros = F.count_if(F.col(column) == 0) if here and column in S.numeric_features(before, label) else F.lit(0)
    nulls = S.null_count(column) if here else F.lit(0)
    parts = [facts(before, "before", zeros.alias("_zeros"), nulls.alias("_nulls")), facts(after, "after")]
    if rec["type"] == "balance":
        parts.append(class_counts(after, label).agg(F.min("n").alias("_smallest")))
        own = F.count_if(F.col(label) == rec["target_class"])
        parts.append(before.filter(S.all_present(S.data_columns(before))).agg(own.alias("_own")))
        parts.append(after.agg(own.alias("_grown")))
    rows = one_row(*parts)
    removed = F.col("rows_before") - F.col("rows_after")
    return rows.select(
        F.lit(rec["type"]).alias("repair"),
        _done(rec, removed).alias("message"),
        "rows_before",
        "rows_after",
        removed.alias("rows_removed"),
        "missing_before",
        "missing_after",
        (F.col("missing_before") - F.col("missing_after")).alias("missing_fixed"),
    )


def _done(rec: dict, removed: Column) -> Column:
    """What a repair did, in words; the counts are columns of the report."""
    column, strategy = F.lit(rec.get("column")), rec.get("strategy")
    target = F.lit(str(rec.get("target_class")))
    if strategy == "drop_rows":
        return F.format_string(K.DONE_DROP_ROWS, removed)
    if strategy == "undersample_majority":
        return F.format_string(K.DONE_UNDERSAMPLE, F.col("_smallest"))
    if strategy == "oversample_minority":
        return F.format_string(K.DONE_OVERSAMPLE, target, F.col("_grown") - F.col("_own"))
    told = {
        "zero_to_nan_impute": lambda: F.format_string(K.DONE_ZEROS, F.col("_zeros")),
        "impute": lambda: F.format_string(K.DONE_IMPUTE, F.lit(strategy), column, F.col("_nulls")),
        "log_transform": lambda: F.format_string(K.DONE_LOG, column),
        "drop_redundant": lambda: F.format_string(K.DONE_DROP_COLUMN, column),
        "augment": lambda: F.format_string(K.DONE_AUGMENT, -removed, target),
        "remove_duplicates": lambda: F.format_string(K.DONE_DUPLICATES, removed),
        "clip_outliers": lambda: F.format_string(
            K.DONE_CLIP, column, F.lit(str(rec["lower"])), F.lit(str(rec["upper"]))
        ),
    }
    return told[rec["type"]]() if rec["type"] in told else F.lit(None).cast("string")
