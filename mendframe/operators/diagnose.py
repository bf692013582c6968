"""Diagnostic jobs: which repairs does a table need?

Each job reads the table through one or two aggregates and turns the resulting summary
(one row per column or per class) into recommendation rows with plain column rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators.profile import (
    duplicate_summary,
    fused_profile,
    label_summary,
    missing_summary,
    null_profile,
    one_row,
    outlier_profile,
)

# Fields of a recommendation and their types; fields a job does not use stay null.
RECOMMENDATION = {
    "rec_id": "string",
    "agent": "string",
    "priority": "int",
    "type": "string",
    "column": "string",
    "strategy": "string",
    "reason": "string",
    "domain_informed": "boolean",
    "count": "bigint",
    "pct": "double",
    "skewness": "double",
    "lower": "double",
    "upper": "double",
    "target_class": "int",
    "current_count": "bigint",
    "target_count": "bigint",
    "n_to_add": "bigint",
    "tradeoff": "string",
}


def rules_of(meta: dict | None) -> dict[str, list[str]]:
    rules = (meta or {}).get("domain_rules", {})
    names = ("zeros_as_missing", "log_transform_candidates", "redundant_features")
    return {n: list(rules.get(n, [])) for n in names}


def unmatched_rules(df: DataFrame, meta: dict | None) -> list[tuple[str, str]]:
    """Rule columns the table does not have: such rules can never fire."""
    return [(rule, c) for rule, cols in rules_of(meta).items() for c in cols if c not in df.columns]


def _names(columns: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns]).cast("array<string>")


def _candidate(section: int, pos: Column, applies: Column, **fields: Column) -> Column:
    """One possible recommendation of a summary row, ordered by section and position."""
    typed = [
        fields.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in RECOMMENDATION.items()
        if name != "priority"
    ]
    return F.struct(
        F.lit(section).alias("section"), pos.cast("int").alias("pos"), applies.alias("applies"), *typed
    )


def _ranked(summary: DataFrame, candidates: list[Column], limit: int | None = None) -> DataFrame:
    """The candidates in section order, numbered from 1; only the first ``limit`` if one is given.

    The summary has one row per column or class of the schema, so one list holds it.
    """
    rows = summary.select(F.inline(F.filter(F.array(*candidates), lambda c: c["applies"])))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("recs"))
    shown = F.col("recs") if limit is None else F.slice("recs", 1, limit)
    return (
        ordered.select(F.posexplode(shown).alias("at", "rec"))
        .select((F.col("at") + 1).alias("priority"), "rec.*")
        .select(*RECOMMENDATION)
    )


def _rec_id(prefix: str, dataset: str, kind: str, column: Column) -> Column:
    return S.recommendation_id(F.lit(prefix), F.lit(dataset), F.lit(kind), column)


def cleaner_recommendations(
    df: DataFrame,
    meta: dict | None = None,
    dataset: str = "dataset",
    limit: int | None = None,
) -> DataFrame:
    """Impossible zeros, nulls, skewed columns and redundant columns, in this order.

    ``limit`` cuts the list in section order. Text columns take no fill value and are left out of
    the null section.
    """
    rules = rules_of(meta)
    domain = (meta or {}).get("domain", "this domain")
    profile = null_profile(df).withColumn("filled", F.col("n") - F.col("n_null"))
    column, zero_share = F.col("column"), F.try_divide(F.col("n_zero"), F.col("n"))
    skew = F.col("skew")
    at = {rule: F.array_position(_names(cols), column) for rule, cols in rules.items()}
    few = F.col("filled") < K.MIN_NON_NULL_TO_IMPUTE
    median = F.abs(skew) > K.MEDIAN_SKEW_LIMIT
    candidates = [
        _candidate(
            1,
            at["zeros_as_missing"],
            (at["zeros_as_missing"] > 0) & (F.col("n_zero") > 0),
            rec_id=_rec_id("clean", dataset, "zero_to_nan_impute", column),
            agent=F.lit("cleaner"),
            type=F.lit("zero_to_nan_impute"),
            column=column,
            strategy=F.lit("zero_to_nan_then_median"),
            reason=F.format_string(
                K.TEXT_ZERO, column, F.col("n_zero"), zero_share * 100, F.lit(domain)
            ),
            domain_informed=F.lit(True),
            count=F.col("n_zero"),
            pct=S.round_even(zero_share, 4),
        ),
        _candidate(
            2,
            F.col("ord"),
            F.col("numeric") & (F.col("n_null") > 0),
            rec_id=_rec_id("clean", dataset, "impute", column),
            agent=F.lit("cleaner"),
            type=F.lit("impute"),
            column=column,
            strategy=F.when(few, "drop_rows").when(median, "median_impute").otherwise("mean_impute"),
            reason=F.when(few, F.format_string(K.TEXT_FEW, column, F.col("filled")))
            .when(median, F.format_string(K.TEXT_MEDIAN, column, skew))
            .otherwise(F.format_string(K.TEXT_MEAN, column, skew)),
            domain_informed=F.lit(False),
            count=F.col("n_null"),
            pct=S.round_even(F.try_divide(F.col("n_null"), F.col("n")), 4),
        ),
        _candidate(
            3,
            at["log_transform_candidates"],
            (at["log_transform_candidates"] > 0)
            & ((skew > K.LOG_SKEW_LIMIT) | (zero_share > K.LOG_ZERO_SHARE)),
            rec_id=_rec_id("clean", dataset, "log_transform", column),
            agent=F.lit("cleaner"),
            type=F.lit("log_transform"),
            column=column,
            strategy=F.lit("log1p"),
            reason=F.format_string(K.TEXT_LOG, column, zero_share * 100, skew),
            domain_informed=F.lit(True),
            pct=S.round_even(zero_share, 4),
            skewness=S.round_even(skew, 2),
        ),
        _candidate(
            4,
            at["redundant_features"],
            at["redundant_features"] > 0,
            rec_id=_rec_id("clean", dataset, "drop_redundant", column),
            agent=F.lit("cleaner"),
            type=F.lit("drop_redundant"),
            column=column,
            strategy=F.lit("drop_column"),
            reason=F.format_string(K.TEXT_REDUNDANT, column),
            domain_informed=F.lit(True),
        ),
    ]
    return _ranked(profile, candidates, limit)


def cleaner_report(df: DataFrame, meta: dict | None = None, dataset: str = "dataset") -> DataFrame:
    """One row: missing cells, number of recommendations, diagnosis and summary text."""
    meta = meta or {}
    hint = f" [{meta['display_name']}]" if meta.get("display_name") else ""
    recs = cleaner_recommendations(df, meta, dataset).agg(
        F.count(F.lit(1)).alias("n_recommendations"),
        F.count_if(F.col("domain_informed")).alias("n_domain_informed"),
        F.min_by(F.concat(F.col("strategy"), F.lit(" on '"), F.col("column"), F.lit("'.")), "priority").alias(
            "top"
        ),
    )
    cells = df.agg(S.missing_cells(S.feature_columns(df)).alias("missing_cells"))
    return one_row(recs, cells).select(
        F.lit("cleaner").alias("agent"),
        F.lit(meta.get("domain", "generic")).alias("domain"),
        "missing_cells",
        "n_recommendations",
        "n_domain_informed",
        F.when(
            F.col("n_recommendations") == 0,
            F.lit(f"No missing values or known domain issues detected.{hint}"),
        )
        .otherwise(
            F.format_string(
                "Found %d missing cells + %d domain-specific issues.%s Top recommendation: %s",
                "missing_cells",
                "n_domain_informed",
                F.lit(hint),
                "top",
            )
        )
        .alias("diagnosis"),
        F.format_string(
            "%d recommendations (%d domain-informed).", "n_recommendations", "n_domain_informed"
        ).alias("summary"),
    )


def augmenter_recommendation(
    df: DataFrame,
    target_class: int | None = None,
    dataset: str = "dataset",
    cap: int | None = None,
    label: str = K.LABEL,
) -> DataFrame:
    """Grow one class (the minority by default) towards 85% of the majority class.

    ``cap`` limits the rows to add. A class that would grow by more than its own size is warned of.
    """
    current = _augment_facts(df, target_class, label)
    cls, needed = F.col("cls"), F.col("needed")
    to_add = F.least(needed, F.lit(cap)) if cap is not None else needed
    warning = F.when(needed > F.col("current") * K.AUGMENT_WARNING_SHARE, K.TEXT_AUGMENT_WARNING).otherwise("")
    applies = (
        (F.col("n_labelled") >= K.MIN_ROWS_TO_AUGMENT) & (F.col("n_classes") >= 2) & (needed > 0)
    )
    candidate = _candidate(
        1,
        F.lit(1),
        applies,
        rec_id=_rec_id("aug", dataset, "augment", cls.cast("string")),
        agent=F.lit("augmenter"),
        type=F.lit("augment"),
        strategy=F.lit("interpolation"),
        reason=F.format_string(
            K.TEXT_AUGMENT, cls.cast("string"), F.col("current"), F.col("ratio_minmax"), to_add, warning
        ),
        domain_informed=F.lit(False),
        target_class=cls,
        current_count=F.col("current"),
        target_count=F.col("goal"),
        n_to_add=to_add,
    )
    return _ranked(current, [candidate])


def _augment_facts(df: DataFrame, target_class: int | None, label: str) -> DataFrame:
    """One row: class counts, the class to grow, its rows, the rows it should have and lacks."""
    clean = label_summary(df, label, clean=True)
    if target_class is None:
        facts = clean.withColumns({"cls": F.col("minority"), "current": F.col("minority_count")})
    else:
        rows = df.filter(S.all_present(S.data_columns(df)) & (F.col(label) == target_class))
        facts = one_row(clean, rows.agg(F.count(F.lit(1)).alias("current"))).withColumn("cls", F.lit(target_class))
    goal = F.floor(F.col("majority_count") * K.AUGMENT_SHARE)
    return facts.withColumn("goal", goal).withColumn(
        "needed", F.greatest(F.lit(0).cast("bigint"), F.col("goal") - F.col("current"))
    )


def augmenter_report(df: DataFrame, target_class: int | None = None, label: str = K.LABEL) -> DataFrame:
    """One row: number of recommendations, diagnosis and summary, also when there is nothing to do."""
    few, one = F.col("n_labelled") < K.MIN_ROWS_TO_AUGMENT, F.col("n_classes") < 2
    fine = F.col("needed") == 0
    return _augment_facts(df, target_class, label).select(
        F.lit("augmenter").alias("agent"),
        F.when(few | one | fine, 0).otherwise(1).alias("n_recommendations"),
        F.when(few, K.TEXT_AUGMENT_FEW)
        .when(one, K.TEXT_AUGMENT_ONE_CLASS)
        .when(fine, F.format_string(K.TEXT_AUGMENT_FINE, F.col("cls").cast("string"), F.col("ratio_minmax")))
        .otherwise(
            F.format_string(
                K.TEXT_AUGMENT_FOUND, F.col("minority").cast("string"), F.col("minority_count"), F.col("ratio_minmax")
            )
        )
        .alias("diagnosis"),
        F.when(few | one, K.SUMMARY_AUGMENT_NONE)
        .when(fine, K.SUMMARY_AUGMENT_FINE)
        .otherwise(K.SUMMARY_AUGMENT_FOUND)
        .alias("summary"),
    )


def balancer_report(df: DataFrame, label: str = K.LABEL) -> DataFrame:
    """One row: number of strategies, diagnosis and summary, also when there is nothing to do."""
    one, fine = F.col("n_classes") < 2, F.col("ratio_minmax") >= K.BALANCED_RATIO
    names = [F.col("minority").cast("string"), F.col("minority_count"), F.col("majority").cast("string"), F.col("majority_count")]
    return label_summary(df, label, clean=True).select(
        F.lit("balancer").alias("agent"),
        F.when(one | fine, 0).otherwise(2).alias("n_recommendations"),
        F.when(one, K.TEXT_BALANCE_ONE_CLASS)
        .when(fine, F.format_string(K.TEXT_BALANCE_FINE, F.col("ratio_minmax")))
        .otherwise(F.format_string(K.TEXT_BALANCE_FOUND, F.col("ratio_minmax"), *names))
        .alias("diagnosis"),
        F.when(one, K.SUMMARY_BALANCE_NONE)
        .when(fine, K.SUMMARY_BALANCE_FINE)
        .otherwise(K.SUMMARY_BALANCE_FOUND)
        .alias("summary"),
    )


def balancer_recommendations(
    df: DataFrame, dataset: str = "dataset", label: str = K.LABEL
) -> DataFrame:
    """Offer over- and undersampling when the smaller class is below 45% of the pair."""
    counts = label_summary(df, label, clean=True)
    applies = (F.col("n_classes") >= 2) & (F.col("ratio_minmax") < K.BALANCED_RATIO)
    minority, majority = F.col("minority_count"), F.col("majority_count")

    def offer(pos, strategy, cls, text, tradeoff, now, goal):
        return _candidate(
            1,
            F.lit(pos),
            applies,
            rec_id=_rec_id("bal", dataset, strategy, cls.cast("string")),
            agent=F.lit("balancer"),
            type=F.lit("balance"),
            strategy=F.lit(strategy),
            reason=F.format_string(text, cls.cast("string"), now, goal),
            domain_informed=F.lit(False),
            target_class=cls,
            current_count=now,
            target_count=goal,
            tradeoff=F.lit(tradeoff),
        )

    offers = [
        offer(
            1, "oversample_minority", F.col("minority"), K.TEXT_OVERSAMPLE,
            K.TRADEOFF_OVERSAMPLE, minority, majority,
        ),
        offer(
            2, "undersample_majority", F.col("majority"), K.TEXT_UNDERSAMPLE,
            K.TRADEOFF_UNDERSAMPLE, majority, minority,
        ),
    ]
    return _ranked(counts, offers)


def _domain_multiplier(meta: dict | None) -> float:
    medical = "medical" in (meta or {}).get("domain", "generic")
    return K.IQR_MULTIPLIER_MEDICAL if medical else K.IQR_MULTIPLIER


def _violations(df: DataFrame, meta: dict | None, **options) -> DataFrame:
    """Duplicates (one row, first) and outliers per column with their fences."""
    duplicates = duplicate_summary(df).select(
        F.lit(-1).alias("ord"),
        F.lit(None).cast("string").alias("column"),
        F.col("n_duplicates").alias("found"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
    )
    outliers = outlier_profile(df, _domain_multiplier(meta), **options).withColumnRenamed(
        "n_outliers", "found"
    )
    return duplicates.unionByName(outliers).filter(F.col("found") > 0)


def validator_recommendations(
    df: DataFrame,
    meta: dict | None = None,
    dataset: str = "dataset",
    limit: int | None = None,
    **options,
) -> DataFrame:
    """Remove duplicates and clip columns with extreme values."""
    multiplier = _domain_multiplier(meta)
    note = K.TEXT_MEDICAL_NOTE if multiplier == K.IQR_MULTIPLIER_MEDICAL else ""
    is_dup = F.col("column").isNull()
    kind = F.when(is_dup, "remove_duplicates").otherwise("clip_outliers")
    candidate = _candidate(
        1,
        F.col("ord"),
        F.lit(True),
        rec_id=S.recommendation_id(F.lit("val"), F.lit(dataset), kind, F.coalesce("column", F.lit("all"))),
        agent=F.lit("validator"),
        type=kind,
        column=F.col("column"),
        strategy=F.when(is_dup, "drop_duplicates").otherwise("clip_iqr"),
        reason=F.when(is_dup, F.format_string(K.TEXT_DUPLICATES, "found")).otherwise(
            F.format_string(
                K.TEXT_OUTLIERS, F.col("found"), F.col("column"), F.lit(multiplier), F.lit(note)
            )
        ),
        domain_informed=F.lit(False),
        count=F.col("found"),
        lower=S.round_even("lower", 4),
        upper=S.round_even("upper", 4),
    )
    return _ranked(_violations(df, meta, **options), [candidate], limit)


def validator_report(df: DataFrame, meta: dict | None = None, **options) -> DataFrame:
    """One row with the full list of violations."""
    text = F.when(
        F.col("column").isNull(), F.format_string("duplicate_rows: %d", "found")
    ).otherwise(F.format_string("outliers_%s: %d", "column", "found"))
    listed = _violations(df, meta, **options).agg(
        F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("v")
    )
    n = F.size("v")
    multiplier = _domain_multiplier(meta)
    domain = (meta or {}).get("domain", "generic")
    return listed.select(
        F.lit("validator").alias("agent"),
        n.alias("n_violations"),
        F.when(n == 0, "No violations found.")
        .otherwise(F.format_string("%d violation(s): %s.", n, F.array_join("v.text", "; ")))
        .alias("diagnosis"),
        F.lit(f"IQR threshold: {multiplier}× (domain={domain})").alias("domain_note"),
        F.lit(K.QUERY_COSTS["query_validator"]).alias("budget_cost"),
        F.format_string(K.SUMMARY_VALIDATOR, n, F.lit(K.QUERY_COSTS["query_validator"])).alias("summary"),
    )


def analyst_report(
    df: DataFrame, meta: dict | None = None, label: str = K.LABEL, **options
) -> DataFrame:
    """One row: missing share, duplicates, imbalance, outliers, domain issues, action plan."""
    meta = meta or {}
    rules = rules_of(meta)
    columns, totals = fused_profile(df, K.IQR_MULTIPLIER, label, **options)
    issue_rows = columns.select(
        F.inline(
            F.filter(
                F.array(
                    _issue(
                        1, rules["zeros_as_missing"], F.col("n_zero") > 0,
                        F.format_string(K.TEXT_ISSUE_ZERO, "column", "n_zero"),
                    ),
                    _issue(
                        2, rules["redundant_features"], F.lit(True),
                        F.format_string(K.TEXT_ISSUE_REDUNDANT, "column"),
                    ),
                    _issue(
                        3, rules["log_transform_candidates"], F.col("skew") > K.LOG_SKEW_LIMIT,
                        F.format_string(K.TEXT_ISSUE_SKEW, "column", "skew"),
                    ),
                ),
                lambda x: x["applies"],
            )
        )
    )
    issues = issue_rows.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section", "pos", "text"))), lambda x: x["text"]
        ).alias("domain_issues")
    )
    facts = one_row(totals, duplicate_summary(df), label_summary(df, label), issues)
    missing, ratio = F.col("missing_pct_all"), F.col("balance_ratio")
    duplicates, found = F.col("n_duplicates"), F.col("domain_issues")
    has_issue = F.size(found) > 0
    plan = F.filter(
        F.array(
            _plan(has_issue, "query_cleaner",
                  F.format_string(K.TEXT_PLAN_DOMAIN, F.array_join(F.slice(found, 1, 2), "; "))),
            _plan(duplicates > 0, "query_validator", F.format_string(K.TEXT_PLAN_DUPLICATES, duplicates)),
            _plan((missing > K.PLAN_MISSING_SHARE) & ~has_issue, "query_cleaner",
                  F.format_string(K.TEXT_PLAN_MISSING, missing * 100)),
            _plan(ratio < K.SEVERE_IMBALANCE, "query_augmenter", F.format_string(K.TEXT_PLAN_SEVERE, ratio)),
            _plan((ratio >= K.SEVERE_IMBALANCE) & (ratio < K.BALANCED_RATIO), "query_balancer",
                  F.format_string(K.TEXT_PLAN_MILD, ratio)),
        ),
        lambda s: s["applies"],
    )
    fallback = F.array(_plan(F.lit(True), "query_validator", F.lit(K.TEXT_PLAN_CLEAN)))
    name = meta.get("display_name")
    published = meta.get("published_baseline")
    note = f" Published benchmark: {published:.1%} accuracy on this dataset." if published else ""
    return facts.select(
        F.lit("analyst").alias("agent"),
        F.lit(name or "Unknown dataset").alias("dataset"),
        S.round_even(missing, 4).alias("missing_pct"),
        F.col("columns_with_missing").alias("missing_columns"),
        duplicates.alias("duplicate_count"),
        S.round_even(ratio, 4).alias("imbalance_ratio"),
        "total_outliers",
        "domain_issues",
        _names(meta.get("known_issues", [])).alias("known_issues"),
        F.transform(
            F.when(F.size(plan) > 0, plan).otherwise(fallback),
            lambda s, i: F.struct(
                (i + 1).alias("step"), s["action"].alias("action"), s["reason"].alias("reason")
            ),
        ).alias("action_plan"),
        F.lit(K.QUERY_COSTS["query_analyst"]).alias("budget_cost"),
        F.format_string(
            "Dataset: %s. %d domain-specific issues + %d missing + %d imbalance.%s",
            F.lit(name or "unknown"),
            F.size(found),
            (missing > K.PLAN_MISSING_SHARE).cast("int"),
            (ratio < K.BALANCED_RATIO).cast("int"),
            F.lit(note),
        ).alias("summary"),
    )


def _issue(section: int, columns: list[str], applies: Column, text: Column) -> Column:
    pos = F.array_position(_names(columns), F.col("column"))
    return F.struct(
        F.lit(section).alias("section"),
        pos.alias("pos"),
        ((pos > 0) & applies).alias("applies"),
        text.alias("text"),
    )


def _plan(applies: Column, action: str, reason: Column) -> Column:
    return F.struct(
        applies.alias("applies"), F.lit(action).alias("action"), reason.alias("reason")
    )


def quality_report(df: DataFrame, label: str = K.LABEL) -> DataFrame:
    """Short check: missing share, smallest class, duplicates, and the issues they raise."""
    facts = one_row(missing_summary(df, label), duplicate_summary(df), label_summary(df, label))
    missing, duplicates = F.col("missing_pct_all"), F.col("n_duplicates")
    smallest = F.try_divide("minority_count", "n_labelled")
    issues = F.filter(
        F.array(
            F.when(missing > K.PLAN_MISSING_SHARE,
                   F.format_string("High missing rate: %.1f%%", missing * 100)),
            F.when(smallest < K.REPORT_MIN_CLASS_SHARE, "Class imbalance detected"),
            F.when(duplicates > 0, F.format_string("Removed %d duplicate rows", duplicates)),
        ),
        lambda x: x.isNotNull(),
    )
    return facts.select(
        S.round_even(missing, 6).alias("missing_pct"),
        S.round_even(smallest, 6).alias("min_class_share"),
        duplicates.alias("n_duplicates"),
        F.when(F.size(issues) > 0, F.array_join(issues, "; "))
        .otherwise("No major issues found.")
        .alias("report"),
    )
