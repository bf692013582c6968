"""Profiles and diagnoses of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators import diagnose, profile
from mendframe.plans.inputs import (
    DIRTY_EVENTS_SQL,
    DOCS_META,
    DOCS_SQL,
    EVENT_FEATURES,
    EVENT_META,
    MEDICAL_META,
    dirty_events,
    docs_labelled,
    table,
)
from mendframe.plans.registry import query

NUMERIC = [c for c in EVENT_FEATURES if c != "etype"]
KEYS = ", ".join([*EVENT_FEATURES, "label"])


def rounded(df, digits=6):
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _skew(c):
    return f"coalesce(CASE WHEN count({c}) > 2 THEN skewness({c}) END, 0)"


def _fences(c, k):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return f"{q1} - {k} * ({q3} - {q1})", f"{q3} + {k} * ({q3} - {q1})"


def _outliers(source, c, k):
    """Outlier count of a column as a scalar subquery."""
    low, high = _fences(c, k)
    return (
        f"(SELECT CASE WHEN b.n < 10 OR b.lo = b.hi THEN 0 ELSE"
        f" (SELECT count(*) FROM {source} WHERE {c} < b.lo OR {c} > b.hi) END"
        f" FROM (SELECT count({c}) AS n, {low} AS lo, {high} AS hi FROM {source}) b)"
    )


def _profile_sql(source, c):
    return f"""
    SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS n_null,
      round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS null_pct,
      count(*) FILTER ({c} = 0) AS n_zero,
      round((count(*) FILTER ({c} = 0))::DOUBLE / count(*), 6) AS zero_pct,
      round(avg({c}), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
      round(stddev_samp({c}), 6) AS std, round({_skew(c)}, 6) AS skew,
      round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1,
      round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3,
      round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 6) AS iqr,
      {_outliers(source, c, 3)} AS n_outlier_3, {_outliers(source, c, 5)} AS n_outlier_5
    FROM {source}"""


@query(
    "column_profile",
    f"WITH {DIRTY_EVENTS_SQL} " + " UNION ALL ".join(_profile_sql("dirty", c) for c in NUMERIC),
)
def column_profile(spark, sf):
    return rounded(profile.column_profile(dirty_events(spark, sf)).drop("ord"))


_LINE = "(SELECT l_discount, l_tax, l_quantity FROM lineitem)"


@query(
    "zero_as_missing_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} = 0) AS n_zero,
        round((count(*) FILTER ({c} = 0))::DOUBLE / count(*), 6) AS zero_pct,
        round(quantile_cont({c}, 0.5) FILTER ({c} <> 0), 6) AS median_non_zero FROM lineitem"""
        for c in ("l_discount", "l_tax")
    ),
)
def zero_as_missing_profile(spark, sf):
    from mendframe.operators.quantiles import fit_medians

    df = table(spark, sf, "lineitem").select("l_discount", "l_tax")
    medians = fit_medians(df.select(*[F.nullif(c, F.lit(0.0)).alias(c) for c in df.columns]), df.columns)
    wide = df.agg(
        *[
            e
            for i, c in enumerate(df.columns)
            for e in (
                S.zero_count(c).alias(f"n_zero__{i}"),
                S.zero_share(c).alias(f"zero_pct__{i}"),
                F.lit(medians[c]).alias(f"median_non_zero__{i}"),
            )
        ]
    )
    fields = ["n_zero", "zero_pct", "median_non_zero"]
    return rounded(profile.unpivot_row(wide, df.columns, fields).drop("ord"))


_MISSING = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in EVENT_FEATURES)


@query(
    "missing_summary",
    f"""WITH {DIRTY_EVENTS_SQL}
    SELECT round(sum({_MISSING})::DOUBLE / (count(*) * {len(EVENT_FEATURES)}), 6)
        AS missing_pct_features,
      round(sum({_MISSING})::DOUBLE / (count(*) * {len(EVENT_FEATURES) + 1}), 6) AS missing_pct_all,
      sum({_MISSING})::BIGINT AS missing_cells,
      {" + ".join(f"(CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)" for c in EVENT_FEATURES)}
        AS columns_with_missing
    FROM dirty""",
)
def missing_summary(spark, sf):
    return rounded(profile.missing_summary(dirty_events(spark, sf)))


_DUP = f"""SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_duplicates
    FROM (SELECT count(*) AS n FROM {{source}} GROUP BY {{keys}})"""


@query(
    "duplicate_profile",
    f"WITH {DIRTY_EVENTS_SQL} SELECT 'events' AS source, * FROM"
    f" ({_DUP.format(source='dirty', keys=KEYS)}) UNION ALL SELECT 'documents', * FROM"
    f" ({_DUP.format(source='documents', keys='text, lang, source, n_chars')})",
)
def duplicate_profile(spark, sf):
    events = profile.duplicate_summary(dirty_events(spark, sf))
    docs = profile.duplicate_summary(table(spark, sf, "documents").drop("doc_id"))
    return events.select(F.lit("events").alias("source"), "*").unionByName(
        docs.select(F.lit("documents").alias("source"), "*")
    )


def _label_sql(source, label, name):
    return f"""SELECT '{name}' AS source, CAST({label} AS VARCHAR) AS label, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS frac FROM {source}
      WHERE {label} IS NOT NULL GROUP BY {label}"""


@query(
    "label_profile",
    f"WITH {DOCS_SQL} {_label_sql('docs', 'label', 'quality')} UNION ALL "
    f"{_label_sql('docs', 'toxic', 'toxic')} UNION ALL "
    f"{_label_sql('events', 'event_type', 'event_type')}",
)
def label_profile(spark, sf):
    parts = [
        ("quality", docs_labelled(spark, sf)),
        ("toxic", docs_labelled(spark, sf, "toxic")),
        ("event_type", table(spark, sf, "events").withColumnRenamed("event_type", "label")),
    ]
    shares = [
        rounded(profile.class_shares(df)).select(
            F.lit(name).alias("source"), F.col("label").cast("string").alias("label"), "n", "frac"
        )
        for name, df in parts
    ]
    return shares[0].unionByName(shares[1]).unionByName(shares[2])


def _summary_sql(source, label, name):
    return f"""SELECT '{name}' AS source, count(*) AS n_classes,
      CAST(arg_min(label, (n, label)) AS VARCHAR) AS minority,
      CAST(arg_max(label, (n, label)) AS VARCHAR) AS majority,
      min(n) AS minority_count, max(n) AS majority_count, sum(n)::BIGINT AS n_labelled,
      round(min(n)::DOUBLE / (min(n) + max(n)), 6) AS ratio_minmax,
      round(min(n)::DOUBLE / sum(n), 6) AS balance_ratio
    FROM (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY {label})"""


@query(
    "label_summary",
    f"WITH {DOCS_SQL} {_summary_sql('docs', 'label', 'quality')} UNION ALL "
    f"{_summary_sql('events', 'event_type', 'event_type')}",
)
def label_summary(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", "label")
    parts = [("quality", docs_labelled(spark, sf)), ("event_type", events)]
    rows = [
        rounded(profile.label_summary(df)).select(
            F.lit(name).alias("source"),
            "*",
        )
        for name, df in parts
    ]
    text = {c: F.col(c).cast("string") for c in ("minority", "majority")}
    return rows[0].withColumns(text).unionByName(rows[1].withColumns(text))


def _outlier_sql(source, c, name, k):
    low, high = _fences(c, k)
    return f"""SELECT '{name}' AS "column", {k}.0::DOUBLE AS multiplier,
      {_outliers(source, c, k)} AS n_outliers,
      round({low}, 6) AS lower, round({high}, 6) AS upper FROM {source}"""


@query(
    "iqr_outliers",
    " UNION ALL ".join(
        _outlier_sql(source, c, c, k)
        for source, c in (("events", "value"), ("documents", "n_chars"))
        for k in (3, 5)
    ),
)
def iqr_outliers(spark, sf):
    parts = []
    for name, c in (("events", "value"), ("documents", "n_chars")):
        found = profile.outlier_profiles(table(spark, sf, name).select(c), [3.0, 5.0])
        parts.append(rounded(found.drop("ord")))
    return parts[0].unionByName(parts[1])


# Recommendations. The SQL builds the same rows from the fixed formats.

_REC_TAIL = {name: kind for name, kind in diagnose.RECOMMENDATION.items() if name != "priority"}
_SQL_TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER"}


def _rec_sql(where, section, pos, source, **fields):
    cells = ", ".join(
        f'CAST({fields.get(name, "NULL")} AS {_SQL_TYPES[kind]}) AS "{name}"'
        for name, kind in _REC_TAIL.items()
    )
    return f"SELECT {section} AS section, {pos} AS pos, {cells} FROM {source} WHERE {where}"


def _rec_id_sql(prefix, dataset, kind, column):
    return f"'{prefix}_' || substr(md5('{dataset}/{kind}/' || {column}), 1, 6)"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _ranked_sql(head, parts, limit=None):
    """Number the candidates in section order, and keep the first ones if there is a limit."""
    return (
        f"WITH {head}, recs AS ({' UNION ALL '.join(parts)}) SELECT * EXCLUDE (section, pos) FROM"
        f" (SELECT *, CAST(row_number() OVER (ORDER BY section, pos) AS INTEGER) AS priority"
        f" FROM recs)" + (f" WHERE priority <= {limit}" if limit else "")
    )


def _cleaner_profile_sql(columns):
    """One row per column with the facts the cleaner rules use."""
    rows = []
    for i, c in enumerate(columns):
        numeric = c != "etype"
        zeros = f"count(*) FILTER ({c} = 0)" if numeric else "0"
        skew = _skew(c) if numeric else "0.0"
        rows.append(
            f"""SELECT {i} AS ord, '{c}' AS col, count(*) AS n, count(*) - count({c}) AS n_null,
            {str(numeric).upper()} AS numeric_, {zeros} AS n_zero, {skew}::DOUBLE AS skew FROM dirty"""
        )
    return f"{DIRTY_EVENTS_SQL}, facts AS ({' UNION ALL '.join(rows)})"


def _cleaner_sql(columns, dataset, limit=None):
    share = "n_zero::DOUBLE / n"
    filled = "n - n_null"
    null_strategy = (
        f"CASE WHEN {filled} < 5 THEN 'drop_rows' WHEN abs(skew) > 1 THEN 'median_impute'"
        " ELSE 'mean_impute' END"
    )
    null_reason = (
        f"CASE WHEN {filled} < 5 THEN printf({_quoted(K.TEXT_FEW)}, col, {filled})"
        f" WHEN abs(skew) > 1 THEN printf({_quoted(K.TEXT_MEDIAN)}, col, skew)"
        f" ELSE printf({_quoted(K.TEXT_MEAN)}, col, skew) END"
    )
    parts = [
        _rec_sql(
            "col = 'value_z' AND n_zero > 0", 1, 1, "facts",
            rec_id=_rec_id_sql("clean", dataset, "zero_to_nan_impute", "col"),
            agent="'cleaner'", type="'zero_to_nan_impute'", column="col",
            strategy="'zero_to_nan_then_median'",
            reason=f"printf({_quoted(K.TEXT_ZERO)}, col, n_zero, {share} * 100, 'web_activity')",
            domain_informed="TRUE", count="n_zero", pct=f"round_even({share}, 4)",
        ),
        _rec_sql(
            "numeric_ AND n_null > 0", 2, "ord", "facts",
            rec_id=_rec_id_sql("clean", dataset, "impute", "col"), agent="'cleaner'",
            type="'impute'", column="col", strategy=null_strategy, reason=null_reason,
            domain_informed="FALSE", count="n_null", pct="round_even(n_null::DOUBLE / n, 4)",
        ),
        _rec_sql(
            f"col = 'value_s' AND (skew > 2 OR {share} > 0.5)", 3, 1, "facts",
            rec_id=_rec_id_sql("clean", dataset, "log_transform", "col"), agent="'cleaner'",
            type="'log_transform'", column="col", strategy="'log1p'",
            reason=f"printf({_quoted(K.TEXT_LOG)}, col, {share} * 100, skew)",
            domain_informed="TRUE", pct=f"round_even({share}, 4)", skewness="round_even(skew, 2)",
        ),
        _rec_sql(
            "col = 'etype'", 4, 1, "facts",
            rec_id=_rec_id_sql("clean", dataset, "drop_redundant", "col"), agent="'cleaner'",
            type="'drop_redundant'", column="col", strategy="'drop_column'",
            reason=f"printf({_quoted(K.TEXT_REDUNDANT)}, col)", domain_informed="TRUE",
        ),
    ]
    return _ranked_sql(_cleaner_profile_sql(columns), parts, limit)


@query("cleaner_recommendations", _cleaner_sql(EVENT_FEATURES, "events"))
def cleaner_recommendations(spark, sf):
    return diagnose.cleaner_recommendations(dirty_events(spark, sf), EVENT_META, "events")


@query("cleaner_top", _cleaner_sql(EVENT_FEATURES, "events", K.TOP_RECOMMENDATIONS))
def cleaner_top(spark, sf):
    """The first recommendations only, as shown to a user."""
    return diagnose.cleaner_recommendations(
        dirty_events(spark, sf), EVENT_META, "events", limit=K.TOP_RECOMMENDATIONS
    )


@query(
    "cleaner_domain_recommendations",
    f"SELECT * FROM ({_cleaner_sql(EVENT_FEATURES, 'events')}) WHERE domain_informed",
)
def cleaner_domain_recommendations(spark, sf):
    return diagnose.cleaner_recommendations(dirty_events(spark, sf), EVENT_META, "events").filter("domain_informed")


@query(
    "cleaner_report",
    f"""WITH recs AS ({_cleaner_sql(EVENT_FEATURES, "events")}),
    {DIRTY_EVENTS_SQL},
    cells AS (SELECT sum({_MISSING})::BIGINT AS missing_cells FROM dirty),
    totals AS (SELECT count(*) AS n_recommendations,
      count(*) FILTER (domain_informed) AS n_domain_informed,
      arg_min(strategy || ' on ''' || "column" || '''.', priority) AS top FROM recs)
    SELECT 'cleaner' AS agent, 'web_activity' AS domain, missing_cells, n_recommendations,
      n_domain_informed,
      printf('Found %d missing cells + %d domain-specific issues. [Web activity]'
        || ' Top recommendation: %s', missing_cells, n_domain_informed, top) AS diagnosis,
      printf('%d recommendations (%d domain-informed).', n_recommendations, n_domain_informed)
        AS summary
    FROM totals, cells""",
)
def cleaner_report(spark, sf):
    return diagnose.cleaner_report(dirty_events(spark, sf), EVENT_META, "events")


_PAIR = f"""{DOCS_SQL}, counts AS (SELECT label, count(*) AS n FROM docs
      WHERE n_chars IS NOT NULL AND text_len IS NOT NULL AND label IS NOT NULL GROUP BY label),
    pair AS (SELECT arg_min(label, (n, label)) AS minority, arg_max(label, (n, label)) AS majority,
      min(n) AS lo, max(n) AS hi, min(n)::DOUBLE / (min(n) + max(n)) AS ratio FROM counts)"""


def _augment_sql(cls, current):
    goal = "CAST(floor(hi * 0.85::DOUBLE) AS BIGINT)"
    need = f"greatest(0, {goal} - {current})"
    return _ranked_sql(
        _PAIR,
        [
            _rec_sql(
                f"{need} > 0", 1, 1, "pair",
                rec_id=_rec_id_sql("aug", "documents", "augment", cls), agent="'augmenter'",
                type="'augment'", strategy="'interpolation'",
                reason=f"printf({_quoted(K.TEXT_AUGMENT)}, CAST({cls} AS VARCHAR), {current}, ratio,"
                f" {need}, CASE WHEN {need} > {current} THEN"
                f" {_quoted(K.TEXT_AUGMENT_WARNING)} ELSE '' END)",
                domain_informed="FALSE", target_class=cls, current_count=current,
                target_count=goal, n_to_add=need,
            )
        ],
    )


@query("augmenter_recommendation", _augment_sql("minority", "lo"))
def augmenter_recommendation(spark, sf):
    return diagnose.augmenter_recommendation(docs_labelled(spark, sf), dataset="documents")


@query(
    "augmenter_target_class",
    _augment_sql("0", "(SELECT coalesce(sum(n), 0)::BIGINT FROM counts WHERE label = 0)"),
)
def augmenter_target_class(spark, sf):
    return diagnose.augmenter_recommendation(docs_labelled(spark, sf), 0, "documents")


# The same rows under labels that leave an agent something to do, or nothing.
_CASES = {
    "minority": ("TRUE", "label"),
    "one_class": ("TRUE", "1"),
    "even": ("TRUE", "CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END"),
    "few": ("n_chars > 1000000000", "label"),
}


def _case_counts(rows, label):
    return f"""(SELECT count(*) AS k, coalesce(sum(n), 0)::BIGINT AS total, arg_min(label, (n, label)) AS minority,
      arg_max(label, (n, label)) AS majority, min(n) AS lo, max(n) AS hi, min(n)::DOUBLE / (min(n) + max(n)) AS ratio,
      greatest(0, CAST(floor(max(n) * 0.85::DOUBLE) AS BIGINT) - min(n)) AS needed
      FROM (SELECT {label} AS label, count(*) AS n FROM docs WHERE {rows} AND n_chars IS NOT NULL
      AND text_len IS NOT NULL GROUP BY 1))"""


def _cases(spark, sf, report):
    docs = docs_labelled(spark, sf)
    rows = [
        report(docs.filter(rows).withColumn("label", F.expr(label).cast("int"))).select(F.lit(name).alias("source"), "*")
        for name, (rows, label) in _CASES.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "augmenter_report",
    f"WITH {DOCS_SQL} " + " UNION ALL ".join(
        f"""SELECT '{name}' AS source, 'augmenter' AS agent, CASE WHEN total < 10 OR k < 2 OR needed = 0 THEN 0 ELSE 1 END
          AS n_recommendations, CASE WHEN total < 10 THEN '{K.TEXT_AUGMENT_FEW}' WHEN k < 2 THEN '{K.TEXT_AUGMENT_ONE_CLASS}'
          WHEN needed = 0 THEN printf('{K.TEXT_AUGMENT_FINE}', CAST(minority AS VARCHAR), ratio)
          ELSE printf('{K.TEXT_AUGMENT_FOUND}', CAST(minority AS VARCHAR), lo, ratio) END AS diagnosis,
          CASE WHEN total < 10 OR k < 2 THEN '{K.SUMMARY_AUGMENT_NONE}' WHEN needed = 0 THEN '{K.SUMMARY_AUGMENT_FINE}'
          ELSE '{K.SUMMARY_AUGMENT_FOUND}' END AS summary FROM {_case_counts(*case)}"""
        for name, case in _CASES.items()
    ),
)
def augmenter_report(spark, sf):
    return _cases(spark, sf, diagnose.augmenter_report)


@query(
    "balancer_report",
    f"WITH {DOCS_SQL} " + " UNION ALL ".join(
        f"""SELECT '{name}' AS source, 'balancer' AS agent, CASE WHEN k < 2 OR ratio >= 0.45 THEN 0 ELSE 2 END
          AS n_recommendations, CASE WHEN k < 2 THEN '{K.TEXT_BALANCE_ONE_CLASS}'
          WHEN ratio >= 0.45 THEN printf('{K.TEXT_BALANCE_FINE}', ratio)
          ELSE printf('{K.TEXT_BALANCE_FOUND}', ratio, CAST(minority AS VARCHAR), lo, CAST(majority AS VARCHAR), hi) END
          AS diagnosis, CASE WHEN k < 2 THEN '{K.SUMMARY_BALANCE_NONE}' WHEN ratio >= 0.45 THEN '{K.SUMMARY_BALANCE_FINE}'
          ELSE '{K.SUMMARY_BALANCE_FOUND}' END AS summary FROM {_case_counts(*case)}"""
        for name, case in _CASES.items()
    ),
)
def balancer_report(spark, sf):
    return _cases(spark, sf, diagnose.balancer_report)


def _offer_sql(pos, strategy, cls, text, tradeoff, now, goal):
    return _rec_sql(
        "ratio < 0.45", 1, pos, "pair",
        rec_id=_rec_id_sql("bal", "documents", strategy, cls), agent="'balancer'",
        type="'balance'", strategy=f"'{strategy}'",
        reason=f"printf({_quoted(text)}, CAST({cls} AS VARCHAR), {now}, {goal})",
        domain_informed="FALSE", target_class=cls, current_count=now, target_count=goal,
        tradeoff=_quoted(tradeoff),
    )


@query(
    "balancer_recommendations",
    _ranked_sql(
        _PAIR,
        [
            _offer_sql(1, "oversample_minority", "minority", K.TEXT_OVERSAMPLE,
                       K.TRADEOFF_OVERSAMPLE, "lo", "hi"),
            _offer_sql(2, "undersample_majority", "majority", K.TEXT_UNDERSAMPLE,
                       K.TRADEOFF_UNDERSAMPLE, "hi", "lo"),
        ],
    ),
)
def balancer_recommendations(spark, sf):
    return diagnose.balancer_recommendations(docs_labelled(spark, sf), "documents")


def _violations_sql(k):
    dup = _DUP.format(source="dirty", keys=KEYS)
    rows = [
        f"SELECT -1 AS ord, NULL AS col, (SELECT n_duplicates FROM ({dup})) AS found,"
        " NULL::DOUBLE AS lower, NULL::DOUBLE AS upper"
    ]
    for i, c in enumerate(NUMERIC):
        low, high = _fences(f"{c}::DOUBLE", k)
        rows.append(
            f"SELECT {i}, '{c}', {_outliers('dirty', c, k)}, {low}, {high} FROM dirty"
        )
    return f"{DIRTY_EVENTS_SQL}, violations AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE found > 0)"


def _validator_sql(dataset, k, note):
    kind = "CASE WHEN col IS NULL THEN 'remove_duplicates' ELSE 'clip_outliers' END"
    return _ranked_sql(
        _violations_sql(k),
        [
            _rec_sql(
                "TRUE", 1, "ord", "violations",
                rec_id=f"'val_' || substr(md5('{dataset}/' || {kind} || '/' || coalesce(col, 'all')), 1, 6)",
                agent="'validator'", type=kind, column="col",
                strategy="CASE WHEN col IS NULL THEN 'drop_duplicates' ELSE 'clip_iqr' END",
                reason=f"CASE WHEN col IS NULL THEN printf({_quoted(K.TEXT_DUPLICATES)}, found)"
                f" ELSE printf({_quoted(K.TEXT_OUTLIERS)}, found, col, {k}.0::DOUBLE, {_quoted(note)}) END",
                domain_informed="FALSE", count="found", lower="round_even(lower, 4)",
                upper="round_even(upper, 4)",
            )
        ],
    )


@query("validator_recommendations", _validator_sql("events", 3, ""))
def validator_recommendations(spark, sf):
    return diagnose.validator_recommendations(dirty_events(spark, sf), EVENT_META, "events")


@query("validator_medical_recommendations", _validator_sql("events", 5, K.TEXT_MEDICAL_NOTE))
def validator_medical_recommendations(spark, sf):
    return diagnose.validator_recommendations(dirty_events(spark, sf), MEDICAL_META, "events")


@query(
    "validator_report",
    f"""WITH {_violations_sql(3)}
    SELECT 'validator' AS agent, CAST(count(*) AS INTEGER) AS n_violations,
      CASE WHEN count(*) = 0 THEN 'No violations found.' ELSE printf('%d violation(s): %s.', count(*),
        string_agg(CASE WHEN col IS NULL THEN printf('duplicate_rows: %d', found)
          ELSE printf('outliers_%s: %d', col, found) END, '; ' ORDER BY ord)) END AS diagnosis,
      'IQR threshold: 3.0× (domain=web_activity)' AS domain_note, 2 AS budget_cost,
      printf('%d recs. Budget cost: 2.', count(*)) AS summary
    FROM violations""",
)
def validator_report(spark, sf):
    return diagnose.validator_report(dirty_events(spark, sf), EVENT_META)


def _analyst_facts_sql():
    total = " + ".join(_outliers("dirty", c, 3) for c in NUMERIC)
    dup = _DUP.format(source="dirty", keys=KEYS)
    return f"""{_cleaner_profile_sql(EVENT_FEATURES)},
    issues AS (
      SELECT 1 AS section, printf({_quoted(K.TEXT_ISSUE_ZERO)}, col, n_zero) AS text FROM facts
        WHERE col = 'value_z' AND n_zero > 0
      UNION ALL SELECT 2, printf({_quoted(K.TEXT_ISSUE_REDUNDANT)}, col) FROM facts WHERE col = 'etype'
      UNION ALL SELECT 3, printf({_quoted(K.TEXT_ISSUE_SKEW)}, col, skew) FROM facts
        WHERE col = 'value_s' AND skew > 2),
    f AS (SELECT
      (SELECT sum({_MISSING})::DOUBLE / (count(*) * {len(EVENT_FEATURES) + 1}) FROM dirty) AS missing,
      (SELECT count(*) FROM facts WHERE n_null > 0) AS missing_columns,
      (SELECT n_duplicates FROM ({dup})) AS duplicates,
      (SELECT min(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY label)) AS ratio,
      {total} AS outliers,
      (SELECT list(text ORDER BY section) FROM issues) AS texts),
    plan AS (
      SELECT 1 AS pos, 'query_cleaner' AS action,
        printf({_quoted(K.TEXT_PLAN_DOMAIN)}, array_to_string(texts[1:2], '; ')) AS reason FROM f
        WHERE len(texts) > 0
      UNION ALL SELECT 2, 'query_validator', printf({_quoted(K.TEXT_PLAN_DUPLICATES)}, duplicates)
        FROM f WHERE duplicates > 0
      UNION ALL SELECT 3, 'query_cleaner', printf({_quoted(K.TEXT_PLAN_MISSING)}, missing * 100)
        FROM f WHERE missing > 0.05 AND coalesce(len(texts), 0) = 0
      UNION ALL SELECT 4, 'query_augmenter', printf({_quoted(K.TEXT_PLAN_SEVERE)}, ratio) FROM f
        WHERE ratio < 0.35
      UNION ALL SELECT 4, 'query_balancer', printf({_quoted(K.TEXT_PLAN_MILD)}, ratio) FROM f
        WHERE ratio >= 0.35 AND ratio < 0.45)"""


@query(
    "analyst_report",
    f"""WITH {_analyst_facts_sql()}
    SELECT 'analyst' AS agent, 'Web activity' AS dataset, round_even(missing, 4) AS missing_pct,
      CAST(missing_columns AS INTEGER) AS missing_columns, duplicates AS duplicate_count,
      round_even(ratio, 4) AS imbalance_ratio, CAST(outliers AS BIGINT) AS total_outliers,
      array_to_string(texts, ' | ') AS domain_issues, 2 AS budget_cost,
      printf('Dataset: Web activity. %d domain-specific issues + %d missing + %d imbalance.'
        || ' Published benchmark: 80.0%% accuracy on this dataset.', len(texts),
        CAST(missing > 0.05 AS INTEGER), CAST(ratio < 0.45 AS INTEGER)) AS summary
    FROM f""",
)
def analyst_report(spark, sf):
    report = diagnose.analyst_report(dirty_events(spark, sf), EVENT_META)
    return report.drop("known_issues", "action_plan").withColumn(
        "domain_issues", F.array_join("domain_issues", " | ")
    )


@query(
    "analyst_action_plan",
    f"""WITH {_analyst_facts_sql()}
    SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS step, action, reason FROM plan""",
)
def analyst_action_plan(spark, sf):
    report = diagnose.analyst_report(dirty_events(spark, sf), EVENT_META)
    return report.select(F.inline("action_plan"))


@query(
    "quality_report",
    f"""WITH {DIRTY_EVENTS_SQL}, f AS (SELECT
      (SELECT sum({_MISSING})::DOUBLE / (count(*) * {len(EVENT_FEATURES) + 1}) FROM dirty) AS missing,
      (SELECT min(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY label)) AS smallest,
      (SELECT n_duplicates FROM ({_DUP.format(source='dirty', keys=KEYS)})) AS duplicates)
    SELECT round_even(missing, 6) AS missing_pct, round_even(smallest, 6) AS min_class_share,
      duplicates AS n_duplicates,
      coalesce(nullif(concat_ws('; ',
        CASE WHEN missing > 0.05 THEN printf('High missing rate: %.1f%%', missing * 100) END,
        CASE WHEN smallest < 0.2 THEN 'Class imbalance detected' END,
        CASE WHEN duplicates > 0 THEN printf('Removed %d duplicate rows', duplicates) END), ''),
        'No major issues found.') AS report FROM f""",
)
def quality_report(spark, sf):
    return diagnose.quality_report(dirty_events(spark, sf))


@query(
    "quality_stats",
    f"""WITH {DIRTY_EVENTS_SQL}
    SELECT round((SELECT sum({_MISSING})::DOUBLE / (count(*) * {len(EVENT_FEATURES)}) FROM dirty), 6)
        AS missing_pct,
      round((SELECT min(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY label)), 6)
        AS balance_ratio""",
)
def quality_stats(spark, sf):
    return rounded(profile.quality_stats(dirty_events(spark, sf)))


@query(
    "log_candidates",
    f"""WITH {DOCS_SQL} SELECT 'n_chars' AS "column", round_even(skewness(n_chars), 2) AS skewness,
      skewness(n_chars) > 2 AS recommended FROM docs""",
)
def log_candidates(spark, sf):
    df = docs_labelled(spark, sf)
    names = DOCS_META["domain_rules"]["log_transform_candidates"]
    return profile.null_profile(df, names).select(
        "column", S.round_even("skew", 2).alias("skewness"), (F.col("skew") > K.LOG_SKEW_LIMIT).alias("recommended")
    )


_KEPT = ("value_n", "k_n", "value_z", "etype")


@query(
    "profile_state",
    f"WITH {DIRTY_EVENTS_SQL}, again AS (SELECT _row_id, value_n, k_n, CASE WHEN value_z = 0 THEN NULL ELSE value_z END AS value_z, etype FROM dirty) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS n_null, {f"count(*) FILTER ({c} = 0)" if c != "etype" else "0::BIGINT"} AS n_zero,
      {f"round(avg({c}), 6)" if c != "etype" else "NULL::DOUBLE"} AS mean, {f"round(stddev_samp({c}), 6)" if c != "etype" else "NULL::DOUBLE"} AS std,
      {f"round(skewness({c}), 6)" if c != "etype" else "0.0::DOUBLE"} AS skew FROM again""" for c in _KEPT
    ),
)
def profile_state(spark, sf):
    """Profiles of two halves put together, then renewed for the one column that a repair has changed."""
    from mendframe.operators import profile_state as P

    df = dirty_events(spark, sf).select("_row_id", *_KEPT)
    halves = [P.state_of(df.where(F.col("_row_id") % 2 == part)) for part in (0, 1)]
    repaired = df.withColumn("value_z", F.nullif("value_z", F.lit(0.0)))
    found = P.profile_of(P.renewed(P.merged(*halves), repaired, ["value_z"]))
    return found.select("column", "n", "n_null", "n_zero", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skew")])
