"""Thresholds, costs, weights and message formats.

Every operator takes these as parameters; the values here are the defaults.
"""

LABEL = "label"
ROW_ID = "_row_id"

# Diagnosis thresholds (fixed values).
TOP_RECOMMENDATIONS = 4
MEDIAN_SKEW_LIMIT = 1.0
LOG_SKEW_LIMIT = 2.0
LOG_ZERO_SHARE = 0.5
MIN_NON_NULL_TO_IMPUTE = 5
MIN_VALUES_FOR_OUTLIERS = 10
MIN_ROWS_TO_AUGMENT = 10
IQR_MULTIPLIER = 3.0
IQR_MULTIPLIER_MEDICAL = 5.0
AUGMENT_SHARE = 0.85
AUGMENT_WARNING_SHARE = 1.0
BALANCED_RATIO = 0.45
SEVERE_IMBALANCE = 0.35
PLAN_MISSING_SHARE = 0.05
REPORT_MIN_CLASS_SHARE = 0.2

# Split, guard and evaluation limits (fixed values).
HOLDOUT_SHARE = 0.20
SEED = 42
DELETION_LIMIT = 0.10
MIN_TRAIN_ROWS = 20
MIN_HOLDOUT_ROWS = 5
TARGET_FACTOR = 0.97
DEFAULT_PUBLISHED = 0.80
REGRESSION_DROP = 0.005
REGRESSION_GROWTH = 0.3
REGRESSION_MISSING = 0.15
REGRESSION_BALANCE = 0.25
REGRESSION_LOSS = 0.3
TOP_FEATURES = 4

# Step log rules (fixed values).
BUDGET = 12
STREAK = 3
MAX_ROLLBACKS = 3
UNDO_DEPTH = 3
EFFECT_BAND = 0.001
RECENT_STEPS = 5
SESSION_TTL_SECONDS = 1800
QUERY_COSTS = {
    "query_cleaner": 1,
    "query_augmenter": 1,
    "query_balancer": 1,
    "query_validator": 2,
    "query_analyst": 2,
}
QUERY_ACTIONS = list(QUERY_COSTS)
VALID_ACTIONS = QUERY_ACTIONS + ["apply", "rollback"]
DIFFICULTIES = ["easy", "medium", "hard"]
EXPENSIVE_ACTIONS = ["query_validator", "query_analyst"]
EXPENSIVE_MIN_BUDGET = 3
LOW_BUDGET = 2
AGENTS = ["cleaner", "augmenter", "balancer", "relabeler", "validator"]

# Reward constants (fixed values).
REWARD_WEIGHTS = {
    "format": 0.15,
    "accuracy": 0.35,
    "quality": 0.20,
    "efficiency": 0.15,
    "completion": 0.15,
}
# Graders are lines: a base, and a slope for what is gained, left or issued.
NEUTRAL_SCORE = 0.5
QUERY_BASE, QUERY_PER_REC, RECS_REWARDED = 0.45, 0.05, 3
GAIN_SLOPE, QUERY_LEFT_SLOPE, PROGRESS_SLOPE = 0.49, 0.3, 0.4
DONE_BASE, DONE_LEFT_SLOPE = 0.9, 0.09
REWARD_FLOOR = 0.001
REWARD_CEILING = 0.999
ROLLBACK_REWARD = 0.3
BLOCKED_REWARD = 0.001

# Corruption recipes by difficulty (fixed values).
CORRUPTION = {
    "easy": {"missing": 0.05, "noise": 0.05, "keep": 0.80, "target": 0.82},
    "medium": {"missing": 0.15, "noise": 0.12, "keep": 0.60, "target": 0.77},
    "hard": {"missing": 0.28, "noise": 0.22, "keep": 0.35, "target": 0.72},
}
# Generator archetypes: informative features, redundant features, class separation (fixed values).
ARCHETYPES = {
    "credit_risk": (5, 2, 1.0),
    "churn": (4, 3, 0.8),
    "fraud": (6, 1, 1.2),
    "medical": (5, 2, 0.9),
    "supply_chain": (4, 2, 1.1),
}
GOLDEN_ROWS = 10
SMOTE_NEIGHBOURS = 5

# Message formats (fixed values), filled with format_string.
TEXT_ZERO = (
    "'%s' has %d zero values (%.1f%%). In %s, zero is medically/logically impossible"
    " — these are missing values."
)
TEXT_FEW = "'%s': too few non-null values (%d) — drop rows."
TEXT_MEDIAN = "'%s': skewness=%.2f (right-skewed) → median fill."
TEXT_MEAN = "'%s': skewness=%.2f (symmetric) → mean fill."
TEXT_LOG = (
    "'%s' is %.0f%% zero with skewness=%.2f."
    " Log1p transform will reduce skew and help the classifier."
)
TEXT_REDUNDANT = (
    "'%s' is redundant — it encodes the same information as another feature."
    " Dropping reduces noise."
)
TEXT_AUGMENT = (
    "Class %s has %d rows (ratio=%.2f)."
    " Adding %d synthetic rows via interpolation between existing samples.%s"
)
TEXT_AUGMENT_WARNING = (
    " WARNING: Large augmentation may reduce holdout accuracy — consider balancing instead."
)
TEXT_OVERSAMPLE = "Oversample class %s: %d → %d rows."
TEXT_UNDERSAMPLE = "Undersample class %s: %d → %d rows."
TRADEOFF_OVERSAMPLE = (
    "Increases training size. May introduce near-duplicates. Better for small datasets."
)
TRADEOFF_UNDERSAMPLE = (
    "Reduces training size. Loses majority-class information."
    " Better when majority is very large."
)
TEXT_DUPLICATES = "%d exact duplicate rows — removing is always safe."
TEXT_OUTLIERS = "%d extreme outliers in '%s' (%.1f×IQR)%s."
TEXT_MEDICAL_NOTE = " (using conservative 5× IQR — medical outliers may be real)"
TEXT_PLAN_DOMAIN = "Domain-specific issues found: %s. Start here."
TEXT_PLAN_DUPLICATES = "%d duplicates — free accuracy gain, always remove first."
TEXT_PLAN_MISSING = "%.1f%% missing values — impute before resampling."
TEXT_PLAN_SEVERE = "Severe imbalance (ratio=%.2f) — synthesize minority rows."
TEXT_PLAN_MILD = "Imbalance (ratio=%.2f) — resample."
TEXT_PLAN_CLEAN = "Dataset looks clean statistically. Check business rule violations."
TEXT_ISSUE_ZERO = "'%s' has %d impossible zeros (domain: missing data)"
TEXT_ISSUE_REDUNDANT = "'%s' is a redundant feature (domain-informed)"
TEXT_ISSUE_SKEW = (
    "'%s' is heavily right-skewed (skew=%.1f) — log transform recommended"
)

# Reports of the augmenter, balancer and validator (fixed values).
TEXT_AUGMENT_FEW = "Too few clean rows."
TEXT_AUGMENT_ONE_CLASS = "Only one class present."
TEXT_AUGMENT_FINE = "Class %s already well-represented (ratio=%.2f)."
TEXT_AUGMENT_FOUND = "Imbalance detected: minority=%s (%d rows, ratio=%.2f)."
SUMMARY_AUGMENT_NONE = "0 recommendations."
SUMMARY_AUGMENT_FINE = "No augmentation needed."
SUMMARY_AUGMENT_FOUND = "1 recommendation."
TEXT_BALANCE_ONE_CLASS = "Only one class."
TEXT_BALANCE_FINE = "Classes balanced (ratio=%.2f)."
TEXT_BALANCE_FOUND = "Imbalance: ratio=%.2f (minority=%s: %d, majority=%s: %d)."
SUMMARY_BALANCE_NONE = "0 recs."
SUMMARY_BALANCE_FINE = "No action needed."
SUMMARY_BALANCE_FOUND = (
    "2 strategies: oversample minority (preserves data) OR undersample majority"
    " (faster, loses info)."
)
SUMMARY_VALIDATOR = "%d recs. Budget cost: %d."

# What a repair did (fixed values).
DONE_ZEROS = "Converted %d medically-impossible zeros to NaN, then median-imputed."
DONE_LOG = "Applied log1p transform to '%s' (was heavily right-skewed)."
DONE_DROP_COLUMN = "Dropped redundant feature '%s'."
DONE_DROP_ROWS = "Dropped %d rows with NaN values."
DONE_IMPUTE = "Applied %s to ['%s']. Fixed %d missing values."
DONE_AUGMENT = "Added %d synthetic rows for class %s via SMOTE-like interpolation."
DONE_UNDERSAMPLE = "Undersampled majority to %d rows/class."
DONE_OVERSAMPLE = "Oversampled class %s by %d rows."
DONE_DUPLICATES = "Removed %d duplicate rows."
DONE_CLIP = "Clipped '%s' outliers to [%s, %s]."

# Regression causes and suggestions (fixed values).
REGRESSION_CAUSES = {
    "large_augmentation_overfitting": (
        "Large augmentation overfits the training set — synthetic rows don't generalise"
        " to holdout. Try 'query_balancer' with undersample_majority instead, or rollback."
    ),
    "high_residual_missing": (
        "Many missing values remain. Apply 'query_cleaner' again on remaining columns."
    ),
    "worsened_class_imbalance": (
        "Class imbalance got worse. The classifier is biased toward majority on holdout."
        " Apply 'query_balancer' or 'query_augmenter'."
    ),
    "too_few_training_rows": (
        "Row deletion left too few examples. Prefer imputation over drop_rows, or rollback."
    ),
    "unknown": "Try a different approach or rollback this step.",
}

# Fixed value: the actions named in every observation.
AVAILABLE_ACTIONS = (
    "query_cleaner | query_augmenter | query_balancer | query_validator (cost 2) |"
    " query_analyst (cost 2) | apply {rec_id} | rollback (undo last apply, max 3/episode)"
)
