"""Profiles and exact quantiles on frames with answers worked by hand."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mendframe.functions import scalar as S
from mendframe.operators import profile
from mendframe.operators import profile_state as P
from mendframe.operators.quantiles import fit_order_statistic, fit_quantiles

VALUES = [1.0, 2.0, 2.0, 2.0, 3.5, -4.0, 0.0, -0.0, 1e300, -1e-300, 7.25, 1e-12, None]


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_row_id bigint, v {kind}")


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.1, 0.333, 0.9]])
@pytest.mark.parametrize(
    "values", [VALUES, [5.0] * 9, [1.0], [3.0, None, None], [0.1 * i for i in range(101)]]
)
def test_both_quantile_paths_agree(spark, values, probs):
    df = frame(spark, values).select("v")
    built_in = fit_quantiles(df, ["v"], probs)["v"]
    narrowed = fit_quantiles(df, ["v"], probs, final_rows=3)["v"]
    want = np.quantile([v for v in values if v is not None], probs)
    assert narrowed == pytest.approx(built_in, rel=1e-12)
    assert narrowed == pytest.approx(list(want), rel=1e-9)


def test_quantiles_of_many_columns_with_close_values(spark):
    df = spark.range(5000).select(
        (F.lit(100.0) + F.col("id") * 1e-9).alias("a"),
        (F.col("id") % 7).alias("b"),
        F.lit(None).cast("double").alias("c"),
    )
    built_in = fit_quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    assert fit_quantiles(df, ["a", "b", "c"], [0.25, 0.5], final_rows=3) == built_in
    assert built_in["c"] == [None, None]


def test_order_statistic_of_large_whole_numbers(spark):
    keys = [2**62 + i * 3 for i in range(50)] + [-(2**61)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert [fit_order_statistic(df, "k", r) for r in (0, 1, 50)] == [min(keys), 2**62, max(keys)]
    assert fit_order_statistic(df, "k", 51) is None


def test_skew_matches_the_corrected_formula(spark):
    x = np.array([1.0, 2.0, 2.5, 9.0, 4.0])
    n, d = len(x), x - x.mean()
    want = math.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5
    got = frame(spark, x.tolist()).agg(S.skew_corrected("v")).first()[0]
    assert got == pytest.approx(want)
    assert frame(spark, [3.0] * 4).agg(S.skew_corrected("v")).first()[0] == 0.0
    assert frame(spark, [3.0, 4.0]).agg(S.skew_corrected("v")).first()[0] == 0.0


def test_missing_shares_differ_with_and_without_label(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 0), (2.0, None, 1), (None, 3.0, None), (4.0, 4.0, 1)], "a double, b double, label int"
    )
    row = profile.missing_summary(df).first()
    assert row["missing_pct_features"] == pytest.approx(3 / 8)
    assert row["missing_pct_all"] == pytest.approx(4 / 12)
    assert (row["missing_cells"], row["columns_with_missing"]) == (4, 2)


def test_nan_counts_as_missing_after_loading(spark):
    df = S.nan_to_null(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double"))
    assert df.agg(S.null_count("v")).first()[0] == 2


def test_class_ties_and_single_class(spark):
    tie = spark.createDataFrame([(1.0, c) for c in (0, 1, 0, 1, 2, 2)], "v double, label int")
    row = profile.label_summary(tie).first()
    assert (row["minority"], row["majority"]) == (0, 2)
    assert row["ratio_minmax"] == 0.5 and row["balance_ratio"] == pytest.approx(1 / 3)
    one = profile.label_summary(tie.filter("label = 1")).first()
    assert one["balance_ratio"] == 1.0 and one["n_classes"] == 1


def test_outliers_need_values_and_spread(spark):
    flat = frame(spark, [1.0] * 20 + [99.0])
    assert profile.outlier_profile(flat).first()["n_outliers"] == 0  # no spread
    short = frame(spark, [1.0, 2.0, 3.0, 500.0])
    assert profile.outlier_profile(short).first()["n_outliers"] == 0  # fewer than ten values
    long = frame(spark, [float(i) for i in range(20)] + [500.0, None])
    assert profile.outlier_profile(long).first()["n_outliers"] == 1


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, None, "x"), (3, 0.0, "x"), (4, -0.0, "x"), (5, None, None)],
        "_row_id int, a double, t string",
    )
    assert profile.duplicate_summary(df).first()["n_duplicates"] == 2


def test_empty_frame_has_zero_stats(spark):
    empty = spark.createDataFrame([], "a double, label int")
    row = profile.quality_stats(empty).first()
    assert (row["missing_pct"], row["balance_ratio"]) == (0.0, 0.0)
    assert profile.duplicate_summary(empty).first()["n_duplicates"] == 0


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(
        (F.col("id") % 97 * 0.5).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")
    )
    rows = [
        profile.column_profile(df.repartition(n)).select(
            "column", "n_null", "median", "q1", "q3", F.round("skew", 9)
        ).collect()
        for n in (1, 7, 200)
    ]
    assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize("final_rows", [200_000, 40])
def test_quantiles_of_many_rows_are_exact(spark, final_rows):
    """Enough rows for the sketch, with hot values on the wanted ranks, skew and both signs."""
    rng = np.random.default_rng(4)
    columns = {
        "a": rng.normal(size=60_000) ** 3,
        "b": np.where(rng.random(60_000) < 0.6, 1.5, rng.random(60_000)),
        "c": rng.integers(-3, 4, 60_000).astype(float),
        "d": np.concatenate([np.full(30_000, -1.0), rng.random(30_000)]),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    probs = [0.0, 0.0001, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = fit_quantiles(df, list(columns), probs, final_rows=final_rows)
    for name, values in columns.items():
        assert got[name] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12)


def test_profile_states_add_up_and_are_renewed(spark):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 7 == 0 else float(rng.normal() ** 3) + 5, float(i % 5), "t" if i % 3 else None, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "_row_id bigint, a double, b double, c string, label int")

    def told(state):
        return {r["column"]: [r[f] for f in ("n", "n_null", "n_zero", "mean", "std", "skew")] for r in P.profile_of(state).collect()}

    whole = told(P.state_of(df))
    parts = [P.state_of(df.where(F.col("_row_id") % 3 == i)) for i in range(3)]
    empty = P.state_of(df.limit(0))
    for column, facts in told(P.merged(*parts, empty)).items():
        assert facts[:3] == whole[column][:3]
        assert [f or 0 for f in facts[3:]] == pytest.approx([f or 0 for f in whole[column][3:]], rel=1e-9)
    null = {r["column"]: r for r in profile.null_profile(df).collect()}
    for column in "abc":
        assert whole[column][:3] == [400, null[column]["n_null"], null[column]["n_zero"]]
        assert whole[column][5] == pytest.approx(null[column]["skew"], abs=1e-9)
    fixed = df.withColumn("a", F.coalesce("a", F.lit(0.0))).drop("c")
    assert told(P.renewed(P.state_of(df), fixed, ["a"])) == told(P.state_of(fixed))
    assert told(P.renewed(P.state_of(df), fixed.limit(9), None)) == told(P.state_of(fixed.limit(9)))
    one = P.missing_share(P.state_of(df)).first()
    assert (one["n_rows"], round(one["missing_pct"], 6)) == (400, round((58 + 0 + 134) / 1200, 6))
