"""Evaluation against a Newton solver, guards, undo and the repair sequence."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.operators import evaluate as E
from mendframe.operators import synth
from mendframe.plans.auto_repair import auto_repair
from mendframe.sources.versions import Versions


def newton(x, y, penalty=1.0, steps=50):
    """Logistic regression with a free intercept and an L2 penalty on the summed loss."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    ridge = penalty * np.eye(x1.shape[1])
    ridge[0, 0] = 0.0
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x1 @ w))
        grad = x1.T @ (p - y) + ridge @ w
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, grad)
    return w


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    y = (x[:, 0] + x[:, 1] / 10 - 0.5 + rng.normal(size=300) > 0).astype(int)
    rows = [(i, *map(float, r), 1.0, int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(
        rows, "_row_id int, a double, b double, c double, d double, constant double, label int"
    )
    return x, y, df


def test_model_matches_a_newton_solver(tables):
    x, y, df = tables
    train, holdout = df.filter("_row_id < 240"), df.filter("_row_id >= 240")
    result = E.evaluate(train, holdout)
    xs, ys = x[:240], y[:240]
    mean, std = xs.mean(axis=0), xs.std(axis=0)
    w = newton((xs - mean) / std, ys)
    got = [result.coefficients[c] for c in "abcd"]
    assert got == pytest.approx(list(w[1:]), abs=1e-4)
    assert result.coefficients["constant"] == pytest.approx(0.0, abs=1e-6)
    predicted = (np.hstack([np.ones((60, 1)), (x[240:] - mean) / std]) @ w > 0).astype(int)
    assert result.accuracy == pytest.approx((predicted == y[240:]).mean())


def test_rows_with_nulls_and_text_columns(tables):
    _, _, df = tables
    train, holdout = df.filter("_row_id < 240"), df.filter("_row_id >= 240")
    holes = train.withColumn("a", F.when(F.col("_row_id") % 2 == 0, F.col("a"))).withColumn("t", F.lit("x"))
    assert E.evaluate(holes, holdout).n_train == 120
    dropped = E.evaluate(train.drop("a"), holdout)
    assert set(dropped.coefficients) == {"b", "c", "d", "constant"}


def test_guards_give_zero_with_a_reason(tables):
    _, _, df = tables
    holdout = df.filter("_row_id >= 240")
    reasons = [
        E.evaluate(df.limit(10), holdout).reason,
        E.evaluate(df, holdout.limit(2)).reason,
        E.evaluate(df.filter("label = 1"), holdout).reason,
        E.evaluate(df, holdout.filter("label = 1")).reason,
        E.evaluate(df.select("_row_id", "label"), holdout).reason,
    ]
    assert reasons == [
        "too few training rows", "too few holdout rows", "one training class", "one holdout class",
        "no shared features",
    ]


def test_importance_is_ranked_after_rounding(spark):
    weights = {"a": 0.5, "b": -0.2, "c": 0.00001, "d": 0.7, "e": 0.50001, "f": 0.1, "g": 0.2, "h": -0.9}
    got = sorted(map(tuple, E.feature_importance(spark, weights).collect()))
    assert got == [
        ("negative", 1, "h", -0.9), ("negative", 2, "b", -0.2),
        ("positive", 1, "d", 0.7), ("positive", 2, "a", 0.5), ("positive", 3, "e", 0.5), ("positive", 4, "g", 0.2),
    ]


def test_explanations_take_the_first_match(spark):
    def frame(n, nulls=0, ones=0):
        return spark.createDataFrame(
            [(None if i < nulls else 1.0, 1 if i % 100 < ones else 0) for i in range(n)], "a double, label int"
        )

    def cause(df, now=0.7, start=300):
        row = E.regression_explanation(df, 0.8, now, start).first()
        return row and row["likely_cause"]

    assert cause(frame(900, ones=50)) == "large_augmentation_overfitting"
    assert cause(frame(300, nulls=120, ones=50)) == "high_residual_missing"
    assert cause(frame(300, ones=10)) == "worsened_class_imbalance"
    assert cause(frame(100, ones=50)) == "too_few_training_rows"
    assert cause(frame(300, ones=50)) == "unknown"
    # The same shares give the same answers at any size.
    assert cause(frame(90, ones=50), start=30) == "large_augmentation_overfitting"
    assert cause(frame(2000, ones=50), start=6000) == "too_few_training_rows"
    assert cause(frame(2000, ones=50), start=2000) == "unknown"
    assert cause(frame(100, ones=50), now=0.799) is None


def test_versions_undo(spark):
    store = Versions.start(spark.range(5))
    for n in (4, 3, 2, 1):
        store.commit(spark.range(n))
    assert store.rollback() and store.read().count() == 2
    store.commit(spark.range(9))
    assert store.latest == 5 and store.read().count() == 9
    assert store.rollback() and store.read().count() == 2
    assert store.rollback() and store.read().count() == 3
    assert not store.rollback()  # three rollbacks are all there are


def test_repair_sequence_keeps_its_budget(spark):
    ids = spark.range(260).withColumnRenamed("id", "_row_id")
    dirty = synth.archetype_table(ids, "fraud", "medium").drop("_golden")
    train, holdout = E.frozen_split(dirty)
    repaired, trace = auto_repair(train, holdout, {"domain": "generic"}, target=0.999)
    log = trace.orderBy("step").collect()
    assert log[0]["action"] == "query_analyst" and log[-1]["budget_remaining"] >= 0
    assert sum(r["cost"] for r in log) <= 12
    # A repair that the integrity guard refuses has no reward.
    assert all(r["reward"] is None if r["outcome"].startswith("rejected") else 0 < r["reward"] < 1 for r in log)
    for a, b in zip(log, log[1:]):
        if b["action"] == "rollback":
            assert a["accuracy_after"] < a["accuracy_before"] - 0.001
            assert b["accuracy_after"] == a["accuracy_before"]
    last = log[-1]
    assert repaired.count() == last["rows_after"]
