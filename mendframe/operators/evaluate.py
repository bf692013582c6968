"""Model-based evaluation: a fixed logistic regression, scored on a frozen holdout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators.profile import class_counts, label_summary, one_row
from mendframe.operators.ranking import PICKED
from mendframe.operators.sampling import mark_holdout
from mendframe.session import materialise

MAX_ITERATIONS = 500
TOLERANCE = 1e-8


@dataclass(frozen=True)
class Evaluation:
    """Result of one fit. ``reason`` says which minimum-evidence guard gave accuracy 0.0."""

    accuracy: float
    n_train: int
    n_holdout: int
    coefficients: dict[str, float] = field(default_factory=dict)
    class_coefficients: dict[int, dict[str, float]] = field(default_factory=dict)
    reason: str | None = None


def frozen_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Stratified training and holdout tables, each written once and only read after."""
    marked = mark_holdout(df, **options)
    stored = materialise(marked, "split")
    return (
        stored.filter(~F.col(PICKED)).drop(PICKED),
        stored.filter(F.col(PICKED)).drop(PICKED),
    )


def shared_features(train: DataFrame, holdout: DataFrame, label: str = K.LABEL) -> list[str]:
    """Numeric features of the holdout that the training table still has as numbers."""
    present = set(S.numeric_features(train, label))
    return [c for c in S.numeric_features(holdout, label) if c in present]


def evaluate(train: DataFrame, holdout: DataFrame, label: str = K.LABEL) -> Evaluation:
    """Scale, fit on complete training rows, score on complete holdout rows.

    The model is logistic regression on features scaled by their population deviation, with
    an L2 penalty of weight one on the summed loss and a free intercept. With more than two classes it
    is multinomial; the penalty makes the coefficients of a feature sum to zero over the classes, so
    their mean says nothing and ``class_coefficients`` tells them apart. Errors of the fit are raised.
    """
    features = shared_features(train, holdout, label)
    if not features:
        return Evaluation(0.0, train.count(), holdout.count(), reason="no shared features")
    rows = _vectors(train, features, label).persist()
    tests = _vectors(holdout, features, label).persist()
    try:
        n_train, train_classes = _sizes(rows)
        n_holdout, holdout_classes = _sizes(tests)
        guards = {
            "too few holdout rows": n_holdout < K.MIN_HOLDOUT_ROWS,
            "too few training rows": n_train < K.MIN_TRAIN_ROWS,
            "one training class": train_classes < 2,
            "one holdout class": holdout_classes < 2,
        }
        reason = next((name for name, hit in guards.items() if hit), None)
        if reason:
            return Evaluation(0.0, n_train, n_holdout, reason=reason)
        # Spark scales by the sample deviation, which is larger by the factor `stretch`; the
        # penalty and the coefficients are converted to the population scale.
        stretch = (n_train / (n_train - 1)) ** 0.5
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(rows)
        model = LogisticRegression(
            featuresCol="x",
            labelCol="y",
            maxIter=MAX_ITERATIONS,
            regParam=1.0 / n_train / stretch**2,
            elasticNetParam=0.0,
            standardization=False,
            tol=TOLERANCE,
        ).fit(scaler.transform(rows).select("x", "y"))
        scored = model.transform(scaler.transform(tests))
        accuracy = scored.agg(accuracy_of("prediction", "y")).first()[0]
    finally:
        rows.unpersist()
        tests.unpersist()
    matrix = model.coefficientMatrix.toArray() / stretch
    by_class = {k: dict(zip(features, row.tolist(), strict=True)) for k, row in enumerate(matrix)} if len(matrix) > 1 else {}
    means = dict(zip(features, matrix.mean(axis=0).tolist(), strict=True))
    return Evaluation(accuracy, n_train, n_holdout, means, by_class)


def _vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Complete rows as feature vector and label; the assembler skips rows with a null feature."""
    others = [c for c in S.data_columns(df) if c not in features]
    assembler = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip")
    rows = assembler.transform(df.filter(S.all_present(others)))
    return rows.select("raw", F.col(label).cast("double").alias("y"))


def _sizes(rows: DataFrame) -> tuple[int, int]:
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")).first()
    return row["n"], row["classes"]


def accuracy_of(prediction: str, label: str) -> Column:
    return F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy")


def evaluation_row(spark: SparkSession, result: Evaluation, holdout: DataFrame) -> DataFrame:
    """One row: sizes, accuracy and the majority baseline of the holdout."""
    row = spark.createDataFrame(
        [(result.n_train, result.n_holdout, round(result.accuracy, 4), result.reason)],
        "n_train bigint, n_holdout bigint, accuracy double, reason string",
    )
    return one_row(row, majority_baseline(holdout))


def majority_baseline(holdout: DataFrame, label: str = K.LABEL) -> DataFrame:
    """Accuracy of always answering the largest class of the complete holdout rows."""
    return class_counts(holdout, label, clean=True).agg(
        F.coalesce(S.round_even(F.max("n") / F.sum("n"), 4), F.lit(0.0)).alias("majority_baseline")
    )


def feature_importance(
    spark: SparkSession, coefficients: dict[str, float], top: int = K.TOP_FEATURES
) -> DataFrame:
    """The strongest positive and negative coefficients, rounded before they are ranked.

    There is one coefficient per column, so a sorted list holds them.
    """
    return class_importance(spark, {0: coefficients}, top).drop("class")


def class_importance(
    spark: SparkSession, class_coefficients: dict[int, dict[str, float]], top: int = K.TOP_FEATURES, digits: int = 4
) -> DataFrame:
    """The same for every class of a fit on more than two."""
    rounded = [(k, name, round(weight, digits)) for k, found in class_coefficients.items() for name, weight in found.items()]
    table = spark.createDataFrame(rounded, "class int, feature string, coef double")
    signed = table.filter(F.col("coef") != 0).withColumn(
        "sign", F.when(F.col("coef") > 0, "positive").otherwise("negative")
    )
    entry = F.struct((-F.abs("coef")).alias("o"), "feature", "coef")
    ranked = signed.groupBy("class", "sign").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, top).alias("l"))
    return ranked.select("class", "sign", F.posexplode("l").alias("at", "f")).select(
        "class", "sign", (F.col("at") + 1).alias("rank"), "f.feature", "f.coef"
    )


def regression_explanation(
    train: DataFrame,
    previous: float,
    accuracy: float,
    start_rows: int,
    growth: float = K.REGRESSION_GROWTH,
    loss: float = K.REGRESSION_LOSS,
    label: str = K.LABEL,
) -> DataFrame:
    """Likely cause of a drop in accuracy; no row unless it fell by more than 0.005.

    A table counts as heavily augmented or thinned out by the share of rows it has gained or lost
    since the start of the session (``start_rows``), so the answer does not depend on its size.
    """
    columns = S.data_columns(train)
    facts = one_row(
        train.agg(
            F.count_if(S.all_present(columns)).alias("n_rows"),
            S.missing_cells(columns).alias("n_missing_cells"),
        ),
        label_summary(train, label).select("balance_ratio"),
    )
    rows = F.col("n_rows")
    share = F.col("n_missing_cells") / F.greatest(rows * len(columns), F.lit(1))
    cause = (
        F.when(rows > start_rows * (1 + growth), "large_augmentation_overfitting")
        .when(share > K.REGRESSION_MISSING, "high_residual_missing")
        .when(F.col("balance_ratio") < K.REGRESSION_BALANCE, "worsened_class_imbalance")
        .when(rows < start_rows * (1 - loss), "too_few_training_rows")
        .otherwise("unknown")
    )
    advice = F.create_map(*[F.lit(x) for pair in K.REGRESSION_CAUSES.items() for x in pair])
    dropped = accuracy < previous - K.REGRESSION_DROP
    return (
        facts.filter(F.lit(dropped))
        .withColumn("likely_cause", cause)
        .select(
            F.lit(round(accuracy - previous, 4)).alias("accuracy_delta"),
            "likely_cause",
            advice[F.col("likely_cause")].alias("suggestion"),
            "n_rows",
            "n_missing_cells",
            S.round_even("balance_ratio", 4).alias("class_balance"),
        )
    )


def comparison(evaluations: DataFrame) -> DataFrame:
    """Current accuracy against target, start, majority and published figures.

    ``evaluations`` has ``accuracy``, ``start_accuracy``, ``majority_baseline`` and
    ``published_baseline``.
    """
    target = S.target_accuracy("published_baseline")
    accuracy = F.col("accuracy")
    return evaluations.withColumns(
        {
            "target_accuracy": target,
            "accuracy_gap": S.round_even(S.accuracy_gap(accuracy, target), 4),
            "improvement_over_start": S.round_even(accuracy - F.col("start_accuracy"), 4),
            "improvement_over_majority": S.round_even(accuracy - F.col("majority_baseline"), 4),
            "success": accuracy >= target,
        }
    )
