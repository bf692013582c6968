"""Catalogue of the known datasets: fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.functions.scalar import target_accuracy

# Dataset entries.
CATALOGUE = {
    "adult_census": {
        "display_name": "UCI Adult Census Income",
        "description": "Predict whether income exceeds $50K based on census data.",
        "target_column": "class",
        "published_baseline": 0.871,
        "domain": "income_prediction",
        "difficulty_weight": 1,
        "known_issues": [
            "~14% of rows have '?' for occupation, workclass, native-country (real missing data)",
            "capital-gain is 97% zero with heavy right skew — needs log transform",
            "education and education-num are redundant (same info, two encodings)",
            "Class imbalance: 76% income<=50K, 24% income>50K",
        ],
        "domain_rules": {
            "zeros_as_missing": [],
            "log_transform_candidates": ["capital-gain", "capital-loss"],
            "redundant_features": ["education"],
        },
    },
    "diabetes_pima": {
        "display_name": "Pima Indians Diabetes Dataset",
        "description": "Predict diabetes onset in Pima Indian women based on medical measurements.",
        "target_column": "class",
        "published_baseline": 0.770,
        "domain": "medical_diagnosis",
        "difficulty_weight": 2,
        "known_issues": [
            "Glucose, BloodPressure, BMI = 0 are medically impossible — zeros mean missing",
            "Insulin has 374 zeros (49% are actually missing)",
            "SkinThickness has 227 zeros (30% are actually missing)",
            "Class imbalance: 65% negative, 35% positive",
        ],
        "domain_rules": {
            "zeros_as_missing": ["Glucose", "BloodPressure", "BMI", "Insulin", "SkinThickness"],
            "log_transform_candidates": [],
            "redundant_features": [],
        },
    },
    "breast_cancer": {
        "display_name": "Wisconsin Breast Cancer Diagnostic",
        "description": "Classify tumors as malignant or benign from cell nucleus measurements.",
        "target_column": "target",
        "published_baseline": 0.973,
        "domain": "medical_imaging",
        "difficulty_weight": 1,
        "known_issues": [
            "Several feature groups are highly correlated (mean/SE/worst versions of same measurement)",
            "Some outlier samples represent rare aggressive tumor types — IQR removal is dangerous",
            "Feature scales vary wildly: radius ~10-30, fractal_dimension ~0.05-0.10",
        ],
        "domain_rules": {
            "zeros_as_missing": [],
            "log_transform_candidates": [],
            "redundant_features": [],
        },
    },
    "german_credit": {
        "display_name": "German Credit Risk",
        "description": "Classify loan applicants as good or bad credit risks.",
        "target_column": "class",
        "published_baseline": 0.768,
        "domain": "credit_risk",
        "difficulty_weight": 2,
        "known_issues": [
            "Mix of categorical and numeric features — encoding strategy matters",
            "Cost-sensitive: misclassifying bad credit as good is 5x more expensive",
            "Class imbalance: 70% good credit, 30% bad credit",
            "Several ordinal features encoded as integers — scaling affects model significantly",
        ],
        "domain_rules": {
            "zeros_as_missing": [],
            "log_transform_candidates": [],
            "redundant_features": [],
        },
    },
    "heart_disease": {
        "display_name": "Cleveland Heart Disease",
        "description": "Predict presence of heart disease from clinical measurements.",
        "target_column": "class",
        "published_baseline": 0.855,
        "domain": "medical_diagnosis",
        "difficulty_weight": 3,
        "known_issues": [
            "Real missing values in: ca (4 missing), thal (2 missing)",
            "Target is originally 0-4 severity scale — binarized as 0 vs >0",
            "slope, ca, thal are ordinal but treated as continuous",
            "Small dataset (303 rows) — train/test split matters a lot",
        ],
        "domain_rules": {
            "zeros_as_missing": [],
            "log_transform_candidates": [],
            "redundant_features": [],
        },
    },
}

# Datasets per difficulty.
DIFFICULTY_DATASETS = {
    "easy": ["adult_census", "breast_cancer"],
    "medium": ["diabetes_pima", "german_credit"],
    "hard": ["heart_disease"],
}

META_SCHEMA = """
    name string, display_name string, description string, target_column string,
    published_baseline double, domain string, difficulty_weight int,
    known_issues array<string>,
    domain_rules struct<zeros_as_missing array<string>,
        log_transform_candidates array<string>, redundant_features array<string>>
"""


def dataset_meta(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, with its difficulty and target accuracy."""
    rows = [{"name": name, **entry} for name, entry in CATALOGUE.items()]
    level = {d: level for level, names in DIFFICULTY_DATASETS.items() for d in names}
    difficulty = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])
    return (
        spark.createDataFrame(rows, META_SCHEMA)
        .withColumn("difficulty", difficulty[F.col("name")])
        .withColumn("target_accuracy", target_accuracy("published_baseline"))
    )


def datasets_for(spark: SparkSession, difficulty: str) -> DataFrame:
    """Entries of one difficulty; an unknown one falls back to the first dataset."""
    names = DIFFICULTY_DATASETS.get(difficulty, ["adult_census"])
    return dataset_meta(spark).filter(F.col("name").isin(names))


def with_metadata(rows: DataFrame, dataset_column: str = "dataset") -> DataFrame:
    """Join rows to their dataset entry; the catalogue has one row per known dataset."""
    meta = dataset_meta(rows.sparkSession).withColumnRenamed("name", dataset_column)
    return rows.join(F.broadcast(meta), dataset_column)
