"""Column, label and duplicate profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.constants import (
    IQR_MULTIPLIER,
    IQR_MULTIPLIER_MEDICAL,
    LABEL,
    MIN_VALUES_FOR_OUTLIERS,
)
from mendframe.functions import scalar as S
from mendframe.operators.quantiles import fit_quantiles
from mendframe.session import materialise


def unpivot_row(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """Turn one wide row ``f__i`` into one row per column."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ord"),
                        F.lit(c).alias("column"),
                        *[F.col(f"{f}__{i}").alias(f) for f in fields],
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def iqr_bounds(
    quartiles: dict[str, list[float | None]], multiplier: float
) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column; columns without spread have none."""
    bounds = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None and q3 - q1 != 0:
            bounds[c] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return bounds


def _outliers(c: str, bounds: dict[str, tuple[float, float]]) -> Column:
    if c not in bounds:
        return F.lit(0).cast("bigint")
    found = S.outlier_count(c, *bounds[c])
    return F.when(F.count(c) >= MIN_VALUES_FOR_OUTLIERS, found).otherwise(F.lit(0).cast("bigint"))


NULL_FIELDS = ["n", "n_null", "numeric", "n_zero", "skew"]


def _null_facts(df: DataFrame, columns: list[str]) -> list[Column]:
    numeric = set(S.numeric_features(df, label=""))
    return [
        e
        for i, c in enumerate(columns)
        for e in (
            F.count(F.lit(1)).alias(f"n__{i}"),
            S.null_count(c).alias(f"n_null__{i}"),
            F.lit(c in numeric).alias(f"numeric__{i}"),
            (S.zero_count(c) if c in numeric else F.lit(0).cast("bigint")).alias(f"n_zero__{i}"),
            (S.skew_corrected(c) if c in numeric else F.lit(0.0)).alias(f"skew__{i}"),
        )
    ]


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls, zeros, skew and spread per column: one scan, one narrow aggregate."""
    columns = columns or S.feature_columns(df)
    return unpivot_row(df.agg(*_null_facts(df, columns)), columns, NULL_FIELDS)


def fused_profile(
    df: DataFrame, multiplier: float = IQR_MULTIPLIER, label: str = LABEL, **options
) -> tuple[DataFrame, DataFrame]:
    """The null profile of the features, and one row with missing shares and all outliers.

    Quartiles are fitted first; everything else comes from one more scan, whose row is stored.
    """
    features, numeric = S.feature_columns(df, label), S.numeric_features(df, label)
    bounds = iqr_bounds(fit_quantiles(df, numeric, [0.25, 0.75], **options), multiplier)
    outliers = sum((_outliers(c, bounds) for c in numeric), F.lit(0).cast("bigint"))
    row = df.agg(*_null_facts(df, features), *_missing_facts(df, label), outliers.alias("total_outliers"))
    row = materialise(row, "profile")
    return unpivot_row(row, features, NULL_FIELDS), row.select(*MISSING_FIELDS, "total_outliers")


def column_profile(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """Full profile of numeric columns.

    Quartiles are fitted first; their fences enter the second scan as literals, so counts,
    moments and outliers of all columns come from one aggregate.
    """
    columns = columns or S.numeric_features(df)
    quartiles = fit_quantiles(df, columns, [0.25, 0.5, 0.75], **options)
    outer = {c: [q[0], q[2]] for c, q in quartiles.items()}
    wide = iqr_bounds(outer, IQR_MULTIPLIER)
    medical = iqr_bounds(outer, IQR_MULTIPLIER_MEDICAL)
    exprs = []
    for i, c in enumerate(columns):
        q1, median, q3 = [F.lit(q).cast("double") for q in quartiles[c]]
        fields = {
            "n": F.count(F.lit(1)),
            "n_null": S.null_count(c),
            "null_pct": S.null_share(c),
            "n_zero": S.zero_count(c),
            "zero_pct": S.zero_share(c),
            "mean": F.avg(c),
            "median": median,
            "std": F.stddev_samp(c),
            "skew": S.skew_corrected(c),
            "q1": q1,
            "q3": q3,
            "iqr": q3 - q1,
            "n_outlier_3": _outliers(c, wide),
            "n_outlier_5": _outliers(c, medical),
        }
        exprs += [e.alias(f"{name}__{i}") for name, e in fields.items()]
    return unpivot_row(df.agg(*exprs), columns, list(fields))


def outlier_profile(
    df: DataFrame, multiplier: float = IQR_MULTIPLIER, columns: list[str] | None = None, **options
) -> DataFrame:
    """Outlier count and fences per numeric column."""
    return outlier_profiles(df, [multiplier], columns, **options).drop("multiplier")


def outlier_profiles(
    df: DataFrame, multipliers: list[float], columns: list[str] | None = None, **options
) -> DataFrame:
    """The same for several multipliers: quartiles are fitted once, and one scan counts for all."""
    columns = columns or S.numeric_features(df)
    quartiles = fit_quantiles(df, columns, [0.25, 0.75], **options)
    exprs, cells = [], []
    for m, multiplier in enumerate(multipliers):
        bounds = iqr_bounds(quartiles, multiplier)
        for i, c in enumerate(columns):
            low, high = bounds.get(c, (None, None))
            exprs.append(_outliers(c, bounds).alias(f"o__{m}_{i}"))
            cells.append(
                F.struct(
                    F.lit(i).alias("ord"), F.lit(c).alias("column"), F.lit(multiplier).alias("multiplier"),
                    F.col(f"o__{m}_{i}").alias("n_outliers"),
                    F.lit(low).cast("double").alias("lower"), F.lit(high).cast("double").alias("upper"),
                )
            )
    if not columns:
        kinds = "ord int, column string, multiplier double, n_outliers bigint, lower double, upper double"
        return df.sparkSession.createDataFrame([], kinds)
    return df.agg(*exprs).select(F.inline(F.array(*cells)))


MISSING_FIELDS = ["missing_pct_features", "missing_pct_all", "missing_cells", "columns_with_missing"]


def _missing_facts(df: DataFrame, label: str) -> list[Column]:
    features, everything = S.feature_columns(df, label), S.data_columns(df)
    facts = [
        S.missing_share(features),
        S.missing_share(everything),
        S.missing_cells(everything),
        sum([(S.null_count(c) > 0).cast("int") for c in features], F.lit(0)),
    ]
    return [f.alias(name) for name, f in zip(MISSING_FIELDS, facts, strict=True)]


def missing_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Missing share over features and over all columns, missing cells, columns with nulls."""
    return df.agg(*_missing_facts(df, label))


def class_counts(df: DataFrame, label: str = LABEL, clean: bool = False) -> DataFrame:
    """Rows per class, null labels left out; ``clean`` counts complete rows only."""
    rows = df.filter(S.all_present(S.data_columns(df))) if clean else df
    return rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Class counts with their share of all labelled rows (the table has one row per class)."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n").alias("total")).first()["total"]
    return counts.withColumn("frac", F.col("n") / F.lit(float(total or 1)))


def label_summary(df: DataFrame, label: str = LABEL, clean: bool = False) -> DataFrame:
    """Minority, majority and both balance ratios.

    On equal counts the minority is the smallest and the majority the largest label.
    """
    by_count = F.struct("n", label)
    return (
        class_counts(df, label, clean)
        .agg(
            F.count(F.lit(1)).alias("n_classes"),
            F.min_by(label, by_count).alias("minority"),
            F.max_by(label, by_count).alias("majority"),
            F.min("n").alias("minority_count"),
            F.max("n").alias("majority_count"),
            F.sum("n").alias("n_labelled"),
        )
        .select(
            "n_classes",
            "minority",
            "majority",
            F.coalesce("minority_count", F.lit(0).cast("bigint")).alias("minority_count"),
            F.coalesce("majority_count", F.lit(0).cast("bigint")).alias("majority_count"),
            F.coalesce("n_labelled", F.lit(0).cast("bigint")).alias("n_labelled"),
            F.try_divide(
                F.col("minority_count"), F.col("minority_count") + F.col("majority_count")
            ).alias("ratio_minmax"),
            F.when(F.col("n_classes") > 1, F.try_divide("minority_count", "n_labelled"))
            .otherwise(1.0)
            .alias("balance_ratio"),
        )
    )


def quality_stats(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Missing share over features and smallest class share; zeros for an empty frame."""
    rows = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        S.missing_share(S.feature_columns(df, label)).alias("missing_pct"),
    )
    balance = label_summary(df, label).select("balance_ratio")
    # Two one-row aggregates, put side by side.
    return one_row(rows, balance).select(
        "missing_pct",
        F.when(F.col("n_rows") == 0, 0.0).otherwise(F.col("balance_ratio")).alias("balance_ratio"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Join aggregates that each have exactly one row by construction."""
    keyed = [f.withColumn("_one", F.lit(1)) for f in frames]
    result = keyed[0]
    for other in keyed[1:]:
        result = result.join(F.broadcast(other), "_one")
    return result.drop("_one")


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Grouping key of a full row: long text enters as its SHA-256 digest to keep shuffles narrow."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or S.data_columns(df)
    return [
        (F.unhex(F.sha2(F.col(c), 256)) if isinstance(kinds[c], T.StringType) else F.col(c)).alias(
            f"k{i}"
        )
        for i, c in enumerate(columns)
    ]


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls compare equal."""
    groups = df.groupBy(*row_key(df, columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("n_duplicates"),
    )
