"""Scalar and aggregate column expressions used by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.constants import (
    DEFAULT_PUBLISHED,
    IQR_MULTIPLIER,
    IQR_MULTIPLIER_MEDICAL,
    LABEL,
    REWARD_CEILING,
    REWARD_FLOOR,
    SESSION_TTL_SECONDS,
    TARGET_FACTOR,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Schema helpers: these look at the schema only and start no job.


def feature_columns(df: DataFrame, label: str = LABEL) -> list[str]:
    """All columns but the label and ``_`` metadata columns."""
    return [c for c in df.columns if c != label and not c.startswith("_")]


def numeric_features(df: DataFrame, label: str = LABEL) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in feature_columns(df, label) if isinstance(kinds[c], T.NumericType)]


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def data_columns(df: DataFrame) -> list[str]:
    """Features and label, without metadata columns."""
    return [c for c in df.columns if not c.startswith("_")]


def all_present(columns: list[str]) -> Column:
    """True when none of the columns is null.

    One test per column: a single wide test (as ``na.drop`` builds) would make the optimizer
    infer a constraint for every combination of column aliases.
    """
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


# Row expressions.


def sentinel_to_null(c: Column | str, sentinel: str = "?") -> Column:
    return F.nullif(_col(c), F.lit(sentinel))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL in every float column."""
    floats = {
        f.name: F.nanvl(F.col(f.name), F.lit(None))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def log1p_floor(c: Column | str) -> Column:
    """log(1 + max(x, 0)), null stays null (``greatest`` alone would skip nulls)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


def clip(c: Column | str, lower: float, upper: float) -> Column:
    c = _col(c)
    return F.when(c < lower, F.lit(lower)).when(c > upper, F.lit(upper)).otherwise(c)


def clamp_reward(c: Column) -> Column:
    return F.least(F.lit(REWARD_CEILING), F.greatest(F.lit(REWARD_FLOOR), c))


def flip_label(c: Column | str) -> Column:
    return F.lit(1) - _col(c)


def interpolate(a: Column, b: Column, alpha: Column) -> Column:
    return a * alpha + b * (F.lit(1.0) - alpha)


def round_even(c: Column | str, digits: int) -> Column:
    """Round half to even on the binary value, as Python does; ``F.round`` rounds the printed
    decimal half up, which differs on ties."""
    scale = float(10**digits)
    return F.rint(_col(c) * scale) / scale


def target_accuracy(published: Column | str) -> Column:
    return round_even(F.coalesce(_col(published), F.lit(DEFAULT_PUBLISHED)) * TARGET_FACTOR, 4)


def accuracy_gap(current: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), target - current)


def iqr_multiplier(domain: Column | str) -> Column:
    return F.when(_col(domain).contains("medical"), IQR_MULTIPLIER_MEDICAL).otherwise(
        IQR_MULTIPLIER
    )


def recommendation_id(prefix: Column, *keys: Column) -> Column:
    """Replay-stable id: prefix plus six hex digits of the keys."""
    return F.concat(prefix, F.lit("_"), F.substring(F.md5(F.concat_ws("/", *keys)), 1, 6))


def mentions(texts: Column | str, word: str) -> Column:
    """Does any text of an array contain the word, whatever its case?"""
    return F.exists(_col(texts), lambda t: F.lower(t).contains(word.lower()))


def unix_to_timestamp(seconds: Column | str) -> Column:
    return F.timestamp_millis(F.round(_col(seconds) * 1000).cast("bigint"))


def is_expired(created: Column, now: Column, ttl_seconds: int = SESSION_TTL_SECONDS) -> Column:
    return now > created + F.make_dt_interval(secs=F.lit(ttl_seconds))


# Aggregates.


def null_count(c: Column | str) -> Column:
    return F.coalesce(F.sum(_col(c).isNull().cast("bigint")), F.lit(0).cast("bigint"))


def null_share(c: Column | str) -> Column:
    return F.avg(_col(c).isNull().cast("double"))


def zero_count(c: Column | str) -> Column:
    return F.count(F.when(_col(c) == 0, F.lit(1)))


def zero_share(c: Column | str) -> Column:
    return F.try_divide(zero_count(c), F.count(F.lit(1)))


def skew_corrected(c: Column | str) -> Column:
    """Bias-corrected (G1) skewness; 0 for constant columns and fewer than three values."""
    c = _col(c).cast("double")
    n = F.count(c).cast("double")
    g1 = F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1.0)), n - 2.0)
    return F.coalesce(F.when(n > 2, g1), F.lit(0.0))


def outlier_count(c: Column | str, lower: float, upper: float) -> Column:
    c = _col(c)
    return F.count(F.when((c < lower) | (c > upper), F.lit(1)))


def missing_cells(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [null_count(c) for c in columns], F.lit(0).cast("bigint"))


def missing_share(columns: list[str]) -> Column:
    """Mean of the per-column null shares."""
    if not columns:
        return F.lit(0.0)
    total = reduce(lambda a, b: a + b, [null_share(c) for c in columns])
    return F.coalesce(total / F.lit(float(len(columns))), F.lit(0.0))
