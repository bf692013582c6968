"""Model evaluation, automatic repair, sources and streams over the test tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators import evaluate as E
from mendframe.operators import sampling
from mendframe.operators import steps as L
from mendframe.operators.profile import one_row
from mendframe.operators.registry import Context, standard
from mendframe.operators.scan import as_of
from mendframe.plans.auto_repair import auto_repair
from mendframe.plans.inputs import (
    DIRTY_EVENTS,
    DIRTY_EVENTS_SQL,
    DOCS_SQL,
    EVENT_FEATURES,
    ORDERS_SQL,
    docs_labelled,
    dirty_events,
    embedding_features,
    labelled_orders,
    table,
)
from mendframe.plans.diagnosis import _quoted
from mendframe.plans.registry import query
from mendframe.plans.repairs import _CODES, _split_sql
from mendframe.plans.step_log import (
    _AUDIT_SQL,
    _SCORED_SQL,
    LOG_SQL,
    _STATE_SQL,
    DAY,
    action_log,
    issued_recs,
    scored_steps,
    audited,
    stored_log,
)
from mendframe.session import materialise, scratch_path
from mendframe.sources import event_log, samples, tables
from mendframe.sources.catalogue import CATALOGUE, DIFFICULTY_DATASETS, with_metadata
from mendframe.streaming.audit import stream_audit
from mendframe.streaming.quality import quality_windows
from mendframe.streaming.sessions import session_totals, stream_sessions
from mendframe.streaming.sinks import run_append, run_update

_POSITIVE = "label < 5"


def _embedding_split(spark, sf):
    return E.frozen_split(embedding_features(spark, sf, _POSITIVE))


# Baselines and accuracy.


@query(
    "majority_baseline",
    f"""WITH {DOCS_SQL}, split AS ({_split_sql(DOCS_SQL, 'docs')})
    SELECT round_even(max(n)::DOUBLE / sum(n), 4) AS majority_baseline FROM
      (SELECT label, count(*) AS n FROM split WHERE holdout GROUP BY label)""",
)
def majority_baseline(spark, sf):
    _, holdout = sampling.stratified_split(docs_labelled(spark, sf))
    return E.majority_baseline(holdout)


@query(
    "accuracy",
    f"""WITH {DOCS_SQL} SELECT round(avg((CASE WHEN 0.002::DOUBLE * n_chars - 0.8::DOUBLE > 0
      THEN 1 ELSE 0 END = label)::INTEGER), 6) AS accuracy FROM docs""",
)
def accuracy(spark, sf):
    rule = F.when(F.col("n_chars") * 0.002 - 0.8 > 0, 1).otherwise(0)
    scored = docs_labelled(spark, sf).withColumn("prediction", rule)
    return scored.agg(E.accuracy_of("prediction", "label")).select(
        F.round("accuracy", 6).alias("accuracy")
    )


@query("holdout_evaluation")
def holdout_evaluation(spark, sf):
    train, holdout = _embedding_split(spark, sf)
    return E.evaluation_row(spark, E.evaluate(train, holdout), holdout)


@query("feature_importance")
def feature_importance(spark, sf):
    train, holdout = _embedding_split(spark, sf)
    return E.feature_importance(spark, E.evaluate(train, holdout).coefficients)


# A fit on two features, whose Newton steps SQL can write out.
_RULE = "CASE WHEN k / 50.0 + value_z / 60.0 + (_row_id * 37 % 100) / 100.0 > 2.2 THEN 1 ELSE 0 END"
_DET = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
_NEWTON_SQL = f"""WITH RECURSIVE {DIRTY_EVENTS_SQL}, src AS (SELECT _row_id, k::DOUBLE AS a, value_z AS b, {_RULE} AS label FROM dirty),
    split AS ({_split_sql(f"{DIRTY_EVENTS_SQL}, src AS (SELECT _row_id, k::DOUBLE AS a, value_z AS b, {_RULE} AS label FROM dirty)", "src")}),
    parts AS (SELECT src.*, holdout FROM src JOIN split USING (_row_id)),
    st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM parts WHERE NOT holdout),
    z AS (SELECT (a - ma) / sa AS x1, (b - mb) / sb AS x2, label AS y, holdout FROM parts, st),
    newton AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL SELECT i + 1,
      w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {_DET},
      w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {_DET},
      w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {_DET}
      FROM (SELECT i, w0, w1, w2, sum(p - y) AS g0, sum((p - y) * x1) + w1 AS g1, sum((p - y) * x2) + w2 AS g2,
        sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x1) AS h01, sum(p * (1 - p) * x2) AS h02,
        sum(p * (1 - p) * x1 * x1) + 1 AS h11, sum(p * (1 - p) * x1 * x2) AS h12, sum(p * (1 - p) * x2 * x2) + 1 AS h22
        FROM (SELECT n.*, x1, x2, y, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) AS p FROM newton n, z
          WHERE i < 15 AND NOT holdout) GROUP BY i, w0, w1, w2)),
    w AS (SELECT * FROM newton WHERE i = 15)"""


def _two_features(spark, sf):
    df = dirty_events(spark, sf).select(
        "_row_id", F.col("k").cast("double").alias("a"), F.col("value_z").alias("b"), F.expr(_RULE).alias("label")
    )
    return E.frozen_split(df)


@query(
    "fit_accuracy",
    f"""{_NEWTON_SQL}, h AS (SELECT y, CASE WHEN w0 + w1 * x1 + w2 * x2 > 0 THEN 1 ELSE 0 END AS found FROM z, w WHERE holdout)
    SELECT (SELECT count(*) FROM z WHERE NOT holdout) AS n_train, count(*) AS n_holdout,
      round_even(avg((y = found)::INTEGER), 4) AS accuracy, NULL::VARCHAR AS reason,
      round_even(greatest(sum(y), count(*) - sum(y))::DOUBLE / count(*), 4) AS majority_baseline FROM h""",
)
def fit_accuracy(spark, sf):
    train, holdout = _two_features(spark, sf)
    return E.evaluation_row(spark, E.evaluate(train, holdout), holdout)


@query(
    "fit_coefficients",
    f"""{_NEWTON_SQL}, c AS (SELECT unnest(['a', 'b']) AS feature, unnest([w1, w2]) AS coef FROM w)
    SELECT CASE WHEN coef > 0 THEN 'positive' ELSE 'negative' END AS sign, CAST(row_number() OVER (PARTITION BY coef > 0
      ORDER BY abs(coef) DESC) AS INTEGER) AS rank, feature, round(coef, 2) AS coef FROM c""",
)
def fit_coefficients(spark, sf):
    train, holdout = _two_features(spark, sf)
    found = E.feature_importance(spark, E.evaluate(train, holdout).coefficients)
    return found.withColumn("coef", F.round("coef", 2))


# Three classes and six features, fitted by block Newton steps: one weight at a time, each from all rows.
_SIX = {
    "a": "CAST(k AS DOUBLE)", "b": "CAST(value_z AS DOUBLE)", **{
        n: f"CAST(_row_id * {m} % {q} AS DOUBLE)" for n, m, q in (("c", 37, 101), ("d", 53, 97), ("e", 71, 89), ("f", 61, 79))
    },
}
#: A feature of the holdout that the training table has lost.
_LOST = "CAST(_row_id % 7 AS DOUBLE)"
_NOISE = "CAST(_row_id * 29 % 83 AS DOUBLE) / 83 * 5"
_SUM = "CAST(k AS DOUBLE) / 50 + CAST(value_z AS DOUBLE) / 60 + " + " + ".join(
    f"({w}) * {_SIX[n]} / {q}" for n, w, q in (("c", "0.9", 101), ("d", "-0.7", 97), ("e", "0.5", 89), ("f", "0.6", 79))
)
_THREE = f"CASE WHEN {_SUM} + {_NOISE} > 5.6 THEN 2 WHEN {_SUM} + {_NOISE} > 3.7 THEN 1 ELSE 0 END"
_WIDTH, _SWEEPS = len(_SIX) + 1, 40
_THREE_SRC = f"{DIRTY_EVENTS_SQL}, src AS (SELECT _row_id, {', '.join(f'{v} AS {n}' for n, v in _SIX.items())}, {_THREE} AS label FROM dirty)"
_XS = "[1.0::DOUBLE, " + ", ".join(f"(p.{n} - m{n}) / s{n}" for n in _SIX) + "]"
_SCORE = "list_dot_product(xs, w[{a}:{b}])"
_SCORES = ", ".join(f"{_SCORE.format(a=k * _WIDTH + 1, b=(k + 1) * _WIDTH)} AS t{k}" for k in range(3))
_BLOCK_SQL = f"""WITH RECURSIVE {_THREE_SRC}, split AS ({_split_sql(_THREE_SRC, "src")}),
    parts AS (SELECT src.*, holdout FROM src JOIN split USING (_row_id)),
    st AS (SELECT {", ".join(f"avg({n}) AS m{n}, stddev_pop({n}) AS s{n}" for n in _SIX)} FROM parts WHERE NOT holdout),
    z AS MATERIALIZED (SELECT {_XS} AS xs, label AS y, holdout FROM parts p, st),
    newton AS (SELECT 0 AS i, list_transform(range({3 * _WIDTH}), lambda j: 0.0::DOUBLE) AS w UNION ALL
      SELECT i + 1, list_transform(range({3 * _WIDTH}), lambda j: w[j + 1] - CASE WHEN j % {_WIDTH} = i % {_WIDTH} THEN ((j = i % {3 * _WIDTH})::INT - 1.0::DOUBLE / 3) * g / h ELSE 0 END) FROM
      (SELECT i, w, sum((p - (y = c)::INT) * x) + ridge * w[i % {3 * _WIDTH} + 1] AS g, sum(p * (1 - p) * x * x) + ridge AS h FROM
        (SELECT i, w, y, c, x, ridge, exp(CASE c WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END - greatest(t0, t1, t2))
          / (exp(t0 - greatest(t0, t1, t2)) + exp(t1 - greatest(t0, t1, t2)) + exp(t2 - greatest(t0, t1, t2))) AS p FROM
          (SELECT i, w, y, i % {3 * _WIDTH} // {_WIDTH} AS c, xs[i % {_WIDTH} + 1] AS x, (i % {_WIDTH} > 0)::INT AS ridge, {_SCORES}
            FROM newton, z WHERE i < {3 * _WIDTH * _SWEEPS} AND NOT holdout)) GROUP BY i, w, ridge)),
    w AS (SELECT w FROM newton WHERE i = {3 * _WIDTH * _SWEEPS})"""


def _three_classes(spark, sf):
    """The training table has lost a feature that the holdout still has."""
    df = dirty_events(spark, sf).select(
        "_row_id", *[F.expr(v).alias(n) for n, v in _SIX.items()], F.expr(_LOST).alias("lost"), F.expr(_THREE).alias("label")
    )
    train, holdout = E.frozen_split(df)
    return E.evaluate(train.drop("lost"), holdout), holdout


@query(
    "multiclass_fit",
    f"""{_BLOCK_SQL}, h AS (SELECT y, CASE WHEN t0 >= t1 AND t0 >= t2 THEN 0 WHEN t1 >= t2 THEN 1 ELSE 2 END AS found
      FROM (SELECT y, {_SCORES} FROM z, w WHERE holdout))
    SELECT (SELECT count(*) FROM z WHERE NOT holdout) AS n_train, count(*) AS n_holdout,
      round_even(avg((y = found)::INTEGER), 4) AS accuracy, NULL::VARCHAR AS reason,
      (SELECT round_even(max(n)::DOUBLE / sum(n), 4) FROM (SELECT count(*) AS n FROM h GROUP BY y)) AS majority_baseline FROM h""",
)
def multiclass_fit(spark, sf):
    result, holdout = _three_classes(spark, sf)
    return E.evaluation_row(spark, result, holdout)


@query(
    "multiclass_coefficients",
    f"""{_BLOCK_SQL}, c AS (SELECT j // {len(_SIX)} AS class, {list(_SIX)}[j % {len(_SIX)} + 1] AS feature,
      round(w[j // {len(_SIX)} * {_WIDTH} + j % {len(_SIX)} + 2], 2) AS coef FROM w, unnest(range({3 * len(_SIX)})) AS u(j))
    SELECT class::INTEGER AS class, sign, rank, feature, coef FROM (SELECT *, CASE WHEN coef > 0 THEN 'positive' ELSE 'negative' END AS sign,
      CAST(row_number() OVER (PARTITION BY class, coef > 0 ORDER BY abs(coef) DESC, feature) AS INTEGER) AS rank FROM c WHERE coef <> 0) WHERE rank <= {K.TOP_FEATURES}""",
)
def multiclass_coefficients(spark, sf):
    """The strongest features of every class: of five positive ones the fifth is cut off."""
    result, _ = _three_classes(spark, sf)
    return E.class_importance(spark, result.class_coefficients, digits=2)


# Tables of one origin that lost accuracy for different reasons: columns, label, rows at the start.
_DROPS = {
    "grown": (["k"], "label", 0.5),
    "holes": (EVENT_FEATURES, "label", 0.0005),
    "skewed": (["k"], "label", 1.0),
    "thinned": (["k"], "CASE WHEN _row_id % 2 = 0 THEN 1 ELSE 0 END", 2.0),
    "unclear": (["k"], "CASE WHEN _row_id % 2 = 0 THEN 1 ELSE 0 END", 1.0),
}


def _drop_sql(name, columns, label, factor):
    everything = [*columns, "label"]
    nulls = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in everything)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in everything)
    return f"""SELECT '{name}' AS source, count(*) FILTER ({whole}) AS n_rows, sum({nulls})::BIGINT AS n_missing_cells,
      least(sum(label), count(*) - sum(label))::DOUBLE / count(*) AS balance, {len(everything)} AS width,
      floor((SELECT count(*) FROM events) * {factor})::BIGINT AS start_rows
      FROM (SELECT {", ".join(columns)}, {label} AS label FROM dirty)"""


@query(
    "regression_explanation",
    f"""WITH {DIRTY_EVENTS_SQL}, f AS ({" UNION ALL ".join(_drop_sql(n, *d) for n, d in _DROPS.items())}),
    c AS (SELECT *, CASE WHEN n_rows > start_rows * 1.3 THEN 'large_augmentation_overfitting'
      WHEN n_missing_cells::DOUBLE / greatest(n_rows * width, 1) > 0.15
        THEN 'high_residual_missing' WHEN balance < 0.25 THEN 'worsened_class_imbalance'
      WHEN n_rows < start_rows * 0.7 THEN 'too_few_training_rows' ELSE 'unknown' END AS likely_cause FROM f)
    SELECT source, -0.05::DOUBLE AS accuracy_delta, likely_cause, CASE likely_cause
      {" ".join(f"WHEN '{k}' THEN '" + v.replace("'", "''") + "'" for k, v in K.REGRESSION_CAUSES.items())}
      END AS suggestion, n_rows, n_missing_cells, round_even(balance, 4) AS class_balance FROM c""",
)
def regression_explanation(spark, sf):
    events = table(spark, sf, "events").count()
    parts = [
        E.regression_explanation(
            dirty_events(spark, sf).select(*columns, F.expr(label).alias("label")), 0.80, 0.75, int(events * factor)
        ).select(F.lit(name).alias("source"), "*")
        for name, (columns, label, factor) in _DROPS.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _meta_sql(field):
    return (
        "CASE dataset "
        + " ".join(f"WHEN '{n}' THEN {e[field]!r}" for n, e in CATALOGUE.items())
        + " END"
    )


_NAMES = list(CATALOGUE)
_DATASET = "CASE session_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


_ISSUES = "CASE dataset " + " ".join(
    f"WHEN '{n}' THEN [{', '.join(_quoted(i) for i in e['known_issues'])}]" for n, e in CATALOGUE.items()
) + " END"
_MAJORITY = f"(SELECT round_even(max(n)::DOUBLE / sum(n), 4) FROM (SELECT count(*) AS n FROM docs GROUP BY label))"


@query(
    "comparison",
    f"""WITH {LOG_SQL}, {DOCS_SQL}, s AS (SELECT session_id, {_DATASET} AS dataset,
      arg_max(accuracy_after, step) AS accuracy, arg_min(accuracy_before, step) AS start_accuracy,
      {_MAJORITY} AS majority_baseline FROM log GROUP BY session_id),
    m AS (SELECT *, {_meta_sql('published_baseline')}::DOUBLE AS published_baseline,
      {_meta_sql('domain')} AS domain, {_ISSUES} AS issues, CASE
      {" ".join(f"WHEN dataset IN ({', '.join(repr(n) for n in names)}) THEN '{level}'"
                for level, names in DIFFICULTY_DATASETS.items())} END AS difficulty FROM s),
    t AS (SELECT *, round_even(published_baseline * 0.97::DOUBLE, 4) AS target_accuracy FROM m)
    SELECT session_id, dataset, domain, difficulty, accuracy, majority_baseline, published_baseline, target_accuracy,
      round_even(greatest(0, target_accuracy - accuracy), 4) AS accuracy_gap,
      round_even(accuracy - start_accuracy, 4) AS improvement_over_start,
      round_even(accuracy - majority_baseline, 4) AS improvement_over_majority,
      accuracy >= target_accuracy AS success, CASE WHEN domain LIKE '%medical%' THEN 5.0 ELSE 3.0 END::DOUBLE
        AS iqr_multiplier, array_to_string(issues[1:2], ' | ') AS first_issues,
      lower(array_to_string(issues, ' ')) LIKE '%imbalance%' AS names_imbalance FROM t""",
)
def comparison(spark, sf):
    """Sessions of the log spread over the catalogued datasets, joined to their entries."""
    sessions = (
        action_log(spark, sf)
        .groupBy("session_id")
        .agg(
            F.max_by("accuracy_after", "step").alias("accuracy"),
            F.min_by("accuracy_before", "step").alias("start_accuracy"),
        )
        .withColumn("dataset", F.expr(_DATASET))
    )
    baseline = E.majority_baseline(docs_labelled(spark, sf))
    known = with_metadata(sessions).withColumn("_one", F.lit(1))
    joined = known.join(F.broadcast(baseline.withColumn("_one", F.lit(1))), "_one")
    return E.comparison(joined).select(
        "session_id", "dataset", "domain", "difficulty", "accuracy", "majority_baseline", "published_baseline",
        "target_accuracy", "accuracy_gap", "improvement_over_start", "improvement_over_majority",
        "success",
        S.iqr_multiplier("domain").alias("iqr_multiplier"),
        F.array_join(samples.first_issues("known_issues"), " | ").alias("first_issues"),
        S.mentions("known_issues", "imbalance").alias("names_imbalance"),
    )


@query("auto_repair")
def auto_repair_trace(spark, sf):
    """Embeddings with holes and a rare class, repaired step by step."""
    df = embedding_features(spark, sf, _POSITIVE)
    dirty = sampling.thin_class(sampling.inject_missing(df, 0.08, ["e0", "e1", "e2"]), 0.4)
    train, holdout = E.frozen_split(dirty)
    meta = {"display_name": "Embeddings", "domain": "vectors"}
    _, trace = auto_repair(train, holdout, meta, target=0.99)
    return trace.select(
        "step", "action", "rec_type", "outcome", "accuracy_before", "accuracy_after",
        "rows_before", "rows_after", "missing_after", "balance_after", "budget_remaining", "reward",
    )


# An own diagnosis and its repair, registered beside the standard ones.
_CEILING = 40.0
_WATCHED = ["value_n", "k"]


def _own_registry():
    known = standard()

    @known.diagnosis("query_ceiling")
    def too_high(df, context):
        above = df.agg(*[F.count_if(F.col(c) > _CEILING).alias(c) for c in _WATCHED])
        found = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("count")) for c in _WATCHED])).alias("f")
        return above.select(found).select("f.*").where("count > 0").select(
            F.concat_ws("/", F.lit(context.session_id), F.lit("ceiling"), "column").alias("rec_id"),
            F.lit("ceiling").alias("type"), F.lit(2).alias("priority"), "column", "count",
        )

    @known.repair("ceiling")
    def lower(df, rec, context):
        column = F.col(rec["column"])
        return df.withColumn(rec["column"], F.when(column > _CEILING, _CEILING).otherwise(column))

    return known


@query(
    "own_repairs",
    f"""WITH {DIRTY_EVENTS_SQL} """ + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT 'own/ceiling/{c}' AS rec_id, 2::INTEGER AS priority, count(*) FILTER ({c} > {_CEILING}) AS n_above, TRUE AS accepted,
        count(*) AS rows_before, count(*) AS rows_after, 0::BIGINT AS missing_fixed, round(sum(CASE WHEN {c} > {_CEILING} THEN {_CEILING}::DOUBLE ELSE {c}::DOUBLE END), 4) AS total
        FROM dirty) WHERE n_above > 0""" for c in _WATCHED
    ),
)
def own_repairs(spark, sf):
    """A diagnosis and a repair of one's own through dispatch, guard and report."""
    known, context = _own_registry(), Context(session_id="own")
    df = dirty_events(spark, sf).select("_row_id", *_WATCHED)
    parts = []
    for rec in known.diagnose(df, "query_ceiling", context).collect():  # one per watched column at most
        rec = rec.asDict()
        after, accepted = known.guarded(df, rec, context)
        total = after.agg(F.round(F.sum(F.col(rec["column"]).cast("double")), 4).alias("total"))
        told = [F.lit(rec["rec_id"]).alias("rec_id"), F.lit(rec["priority"]).alias("priority"), F.lit(rec["count"]).alias("n_above"), F.lit(accepted).alias("accepted")]
        parts.append(one_row(known.report(df, rec, context), total).select(*told, "rows_before", "rows_after", "missing_fixed", "total"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# Sources and sinks.


# Orders as they might land: a sentinel in a text column, some labels missing.
_PRIORITY = "CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE o_orderpriority END"
_STATUS = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END"


@query(
    "normalise_landing",
    f"""WITH l AS (SELECT o_orderkey AS _row_id, o_totalprice, nullif({_PRIORITY}, '?') AS p, {_STATUS} AS s
      FROM orders WHERE o_orderkey % 17 <> 0),
    p AS (SELECT p, {_CODES.format(c='p')} AS code FROM (SELECT DISTINCT p FROM l WHERE p IS NOT NULL)),
    s AS (SELECT s, {_CODES.format(c='s')} AS code FROM (SELECT DISTINCT s FROM l))
    SELECT _row_id, o_totalprice, p.code AS o_orderpriority, s.code AS label
    FROM l LEFT JOIN p USING (p) JOIN s USING (s)""",
)
def normalise_landing(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("_row_id"), "o_totalprice",
        F.expr(_PRIORITY).alias("o_orderpriority"), F.expr(_STATUS).alias("o_orderstatus"),
    )
    return tables.normalise_landing(df, "o_orderstatus")


@query("read_table", "SELECT * RENAME (o_orderstatus AS label) FROM orders")
def read_table(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet", "o_orderstatus")


@query(
    "without_metadata",
    f"WITH {ORDERS_SQL} SELECT price, custkey, label FROM ords",
)
def without_metadata(spark, sf):
    return S.drop_metadata(sampling.mark_golden(labelled_orders(spark, sf)))


@query("csv_roundtrip", f"WITH {DIRTY_EVENTS_SQL} SELECT * FROM dirty")
def csv_roundtrip(spark, sf):
    df = dirty_events(spark, sf)
    path = scratch_path(spark, "events-csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


@query(
    "event_log_roundtrip",
    """SELECT CAST(date_trunc('milliseconds', ts + INTERVAL 500 MICROSECOND) AS TIMESTAMP) AS ts,
      'INFO' AS level, 'step' AS event, CAST(user_id AS VARCHAR) AS session_id,
      event_type AS action, props FROM events""",
)
def event_log_roundtrip(spark, sf):
    path = scratch_path(spark, "event-log")
    lines = event_log.to_event_lines(
        table(spark, sf, "events"), "step", "ts", "user_id", ["event_type", "props"]
    )
    event_log.write_event_log(lines, path)
    return event_log.read_event_log(spark, path).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "event", "session_id",
        F.col("attrs.event_type").alias("action"), F.col("attrs.props").alias("props"),
    )


_COMPLETION_SQL = """CASE WHEN rec_id IS NULL THEN '{"action":"' || action || '"}'
      ELSE '{"action":"' || action || '","rec_id":"' || rec_id || '"}' END"""


@query(
    "training_samples",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} SELECT 'session ' || session_id || ' step ' || step AS prompt,
      {_COMPLETION_SQL} AS completion, reward FROM scored WHERE reward > 0.001""",
)
def training_samples(spark, sf):
    rows = scored_steps(spark, sf).select(
        F.format_string("session %d step %d", "session_id", "step").alias("prompt"),
        samples.action_json().alias("completion"),
        "reward",
    )
    return samples.training_samples(rows)


def _json(**fields):
    """A JSON object as SQL text; values are SQL expressions of JSON text."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || coalesce(CAST({v} AS VARCHAR), 'null')" for k, v in fields.items()) + " || '}'"


def _text(value):
    return f"'\"' || {value} || '\"'"


def _issues_json(shown=None):
    return "CASE dataset " + " ".join(
        f"WHEN '{n}' THEN {_quoted(json.dumps(e['known_issues'][:shown], ensure_ascii=False, separators=(',', ':')))}"
        for n, e in CATALOGUE.items()
    ) + " END"


# Evaluations on record: one at every seventh event of a session.
_EVALUATED = {
    "majority_class_baseline": "CAST(500 + event_id % 100 AS DOUBLE) / 1000",
    "n_train_rows": "CAST(100000 - event_id % 1000 AS BIGINT)",
    "n_holdout_rows": "CAST(event_id % 500 AS BIGINT)",
    "n_cols": "CAST(event_id % 50 AS BIGINT)",
}
_FEATURE = "CAST(event_id % {m} AS STRING)"
_COEF = "CAST({sign} * (event_id % {m} + 1) AS DOUBLE) / 100"
_TOPS = {"top_positive": ("", [(9, 97), (7, 89), (5, 83)]), "top_negative": ("-", [(11, 79)])}
_EVALS_SQL = "evals AS (SELECT session_id, step, " + ", ".join(f"{v} AS {n}" for n, v in _EVALUATED.items()) + ", " + ", ".join(
    "'[' || " + " || ',' || ".join(
        _json(feature=_text(f"'f' || {_FEATURE.format(m=a).replace('STRING', 'VARCHAR')}"), coef=_COEF.format(sign=sign + "1", m=b)) for a, b in tops
    ) + f" || ']' AS {name}, " + _json(feature=_text(f"'f' || {_FEATURE.format(m=tops[0][0]).replace('STRING', 'VARCHAR')}"), coef=_COEF.format(sign=sign + "1", m=tops[0][1]))
    + f" AS {name}_1" + (
        ", " + _json(feature=_text(f"'f' || {_FEATURE.format(m=tops[1][0]).replace('STRING', 'VARCHAR')}"), coef=_COEF.format(sign=sign + "1", m=tops[1][1])) + f" AS {name}_2" if len(tops) > 1 else ""
    )
    for name, (sign, tops) in _TOPS.items()
) + " FROM log WHERE event_id % 7 = 0)"
_TYPE = "CASE priority WHEN 1 THEN 'fill' WHEN 2 THEN 'clip' ELSE 'drop' END"
_REASON = "repeat(concat(agent, ' recommends ', rec_id, '; '), 8)"


def evaluations(steps):
    """What an evaluation after every seventh event of a session told."""
    tops = {
        name: F.array(*[F.struct(F.expr(f"concat('f', {_FEATURE.format(m=a)})").alias("feature"), F.expr(_COEF.format(sign=sign + "1", m=b)).alias("coef")) for a, b in found])
        for name, (sign, found) in _TOPS.items()
    }
    return steps.where("event_id % 7 = 0").select(
        "session_id", "step", *[F.expr(v).alias(n) for n, v in _EVALUATED.items()], *[c.alias(n) for n, c in tops.items()]
    )


def _described(recs):
    return recs.withColumns({"type": F.expr(_TYPE), "reason": F.expr(_REASON), "domain_informed": F.col("priority") % 2 == 0})


def _seen(spark, sf):
    """The full observation of every session."""
    steps = audited(spark, sf)
    sessions = steps.select("session_id").distinct().withColumn("dataset", F.expr(_DATASET))
    meta = with_metadata(sessions)
    return L.observations(steps, _described(issued_recs(steps)), meta, evaluations(steps))


_LEVEL = "CASE " + " ".join(
    f"WHEN dataset IN ({', '.join(repr(n) for n in names)}) THEN '{level}'" for level, names in DIFFICULTY_DATASETS.items()
) + " END"
_BENCHMARKS = _json(
    majority_class_baseline="majority_class_baseline",
    starting_accuracy="round_even(start, 4)",
    improvement_over_start="round_even(accuracy - start, 4)",
    improvement_over_baseline="round_even(accuracy - majority_class_baseline, 4)",
    published_baseline=f"{_meta_sql('published_baseline')}::DOUBLE",
)
_STATS = _json(
    n_train_rows="n_train_rows", n_holdout_rows="n_holdout_rows", n_cols="n_cols",
    missing_pct="round_even(missing, 4)", balance_ratio="round_even(balance, 4)",
)


def _pending_json(reason, *more):
    told = dict(agent=_text("agent"), type=_text(_TYPE), **dict(more), reason=_text(reason), domain_informed="priority % 2 = 0")
    return f"'{{' || string_agg({_text('rec_id')} || ':' || {_json(**told)}, ',' ORDER BY priority, rec_id) || '}}'"


def _trace_json(shown):
    told = _json(step="step", action=_text("action"), rec_id=_text("rec_id"), outcome=_text("outcome"), rule=_text("rule"), accuracy_after="accuracy_after")
    return f"""(SELECT session_id, '[' || string_agg({told}, ',' ORDER BY step) || ']' AS trace FROM (SELECT *, row_number() OVER
      (PARTITION BY session_id ORDER BY step DESC) AS r FROM audit WHERE outcome IN ('executed', 'blocked', 'undone')) WHERE r <= {shown} GROUP BY session_id)"""


_ASKED_JSON = _json(agent=_text("substr(action, 7, 20)"), n_recs="n_recs", rec_ids="ids")
_SEEN_SQL = f"""{LOG_SQL}, {_AUDIT_SQL}, {_STATE_SQL}, {_EVALS_SQL},
    listed AS (SELECT session_id, {_pending_json("substr(" + _REASON + ", 1, 120)")} AS short, {_pending_json(_REASON, ("priority", "priority"))} AS listed FROM pending GROUP BY session_id),
    given AS (SELECT session_id, step, '[' || string_agg({_text('rec_id')}, ',' ORDER BY priority, rec_id) || ']' AS ids FROM recs GROUP BY ALL),
    asked AS (SELECT a.session_id, a.step, {_ASKED_JSON} AS asked FROM (SELECT session_id, step, action, n_recs, coalesce(ids, '[]') AS ids
      FROM audit LEFT JOIN given USING (session_id, step) WHERE outcome = 'executed' AND action LIKE 'query%') a),
    ends AS (SELECT session_id, max(step) AS step FROM audit GROUP BY session_id),
    seen AS (SELECT s.*, e.* EXCLUDE (session_id, step), q.asked, {_DATASET.replace("session_id", "s.session_id")} AS dataset, short, listed, t.trace, u.trace AS trace3
      FROM state s JOIN ends n USING (session_id) ASOF LEFT JOIN evals e ON e.session_id = n.session_id AND n.step >= e.step
      ASOF LEFT JOIN asked q ON q.session_id = n.session_id AND n.step >= q.step LEFT JOIN listed l ON l.session_id = n.session_id
      LEFT JOIN {_trace_json(5)} t ON t.session_id = n.session_id LEFT JOIN {_trace_json(samples.TRACE_SHOWN)} u ON u.session_id = n.session_id)"""
_NESTED = ("dataset", "benchmarks", "dataset_stats", "feature_importance", "episode_trace", "pending_recommendations", "last_query_result")


@query(
    "observations",
    f"""WITH RECURSIVE {_SEEN_SQL} SELECT session_id, {_json(
        name=_text(_meta_sql("display_name")), domain=_text(_meta_sql("domain")), description=_text(_meta_sql("description")),
        known_issues=_issues_json(), published_baseline=f"{_meta_sql('published_baseline')}::DOUBLE")} AS dataset,
      round_even(accuracy, 4) AS current_accuracy, 0.9::DOUBLE AS target_accuracy, round_even(greatest(0, 0.9::DOUBLE - accuracy), 4) AS accuracy_gap,
      budget_remaining, {_LEVEL} AS difficulty, {_BENCHMARKS} AS benchmarks, {_STATS} AS dataset_stats,
      {_json(top_positive="top_positive", top_negative="top_negative")} AS feature_importance, trace AS episode_trace,
      listed AS pending_recommendations, asked AS last_query_result, '{K.AVAILABLE_ACTIONS}' AS available_actions FROM seen""",
)
def observations(spark, sf):
    found = _seen(spark, sf)
    return found.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in _NESTED})


@query(
    "evaluations_as_of",
    f"""WITH {LOG_SQL}, {_EVALS_SQL} SELECT l.session_id, l.step, e.n_train_rows, e.majority_class_baseline
    FROM log l ASOF LEFT JOIN evals e ON e.session_id = l.session_id AND l.step >= e.step""",
)
def evaluations_as_of(spark, sf):
    """Every step with the evaluation that was the latest then."""
    steps = stored_log(spark, sf)
    return as_of(steps.select("session_id", "step"), evaluations(steps), ["session_id"], "step", ["n_train_rows", "majority_class_baseline"])


_SHOWN = _json(
    dataset=_text(_meta_sql("display_name")),
    domain=_text(_meta_sql("domain")),
    known_issues=_issues_json(samples.ISSUES_SHOWN),
    current_accuracy="round_even(accuracy, 4)",
    target_accuracy="0.9",
    accuracy_gap="round_even(greatest(0, 0.9::DOUBLE - accuracy), 4)",
    benchmarks=_BENCHMARKS,
    budget_remaining="budget_remaining",
    dataset_stats=_STATS,
    pending_recommendations="coalesce(short, '{}')",
    episode_trace="trace3",
    feature_importance="'[' || top_positive_1 || ',' || top_positive_2 || ']'",
    available_actions=_text(f"'{K.AVAILABLE_ACTIONS}'"),
)
_PROMPTS_SQL = f"""WITH RECURSIVE {_SEEN_SQL}, shown AS (SELECT session_id, {_LEVEL} AS difficulty, {_SHOWN} AS obs FROM seen),
    prompts AS (SELECT *, '<|system|>' || chr(10) || '{samples.SYSTEM_TEXT}' || chr(10) || '<|user|>' || chr(10)
      || 'Current environment state:' || chr(10) || obs || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM shown)"""


@query("prompt_json", f"{_PROMPTS_SQL} SELECT session_id, prompt FROM prompts")
def prompt_json(spark, sf):
    state = samples.prompt_state(_seen(spark, sf))
    shown = F.struct(*[c for c in state.columns if c not in ("session_id", "difficulty")])
    return state.select("session_id", samples.prompt_text(shown).alias("prompt"))


@query("prompt_dataset", f"{_PROMPTS_SQL} SELECT prompt, difficulty, obs AS initial_obs FROM prompts")
def prompt_dataset(spark, sf):
    state = samples.prompt_state(_seen(spark, sf))
    return samples.prompt_dataset(state, [c for c in state.columns if c not in ("session_id", "difficulty")])


# Streams. Each reads a folder of files to its end.


_WINDOW_FEATURES = EVENT_FEATURES
_WINDOW_NULLS = " + ".join(f"sum(({c} IS NULL)::INTEGER)" for c in _WINDOW_FEATURES)
_WINDOW_SQL = f"""WITH d AS (SELECT ts, {", ".join(f"{DIRTY_EVENTS[c]} AS {c}" for c in (*_WINDOW_FEATURES, "label"))}
      FROM events)
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n_rows,
      round(({_WINDOW_NULLS})::DOUBLE / count(*) / {len(_WINDOW_FEATURES)}, 6) AS missing_pct,
      round(least(sum(label), count(*) - sum(label))::DOUBLE / count(*), 6) AS balance_ratio
    FROM d GROUP BY ALL"""


def _window_input(events):
    return events.select("ts", *[F.expr(DIRTY_EVENTS[c]).alias(c) for c in (*_WINDOW_FEATURES, "label")])


def _plain_start(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("quality_windows", _WINDOW_SQL)
def quality_windows_batch(spark, sf):
    return _plain_start(quality_windows(_window_input(table(spark, sf, "events")), _WINDOW_FEATURES))


@query("stream_quality_windows", _WINDOW_SQL)
def quality_windows_stream(spark, sf):
    windows = quality_windows(_window_input(_event_stream(spark, sf)), _WINDOW_FEATURES)
    return _plain_start(run_update(windows, "quality", ["window_start"]))


@query(
    "stream_session_metrics",
    """WITH s AS (SELECT user_id, min(ts) AS created FROM events GROUP BY user_id)
    SELECT user_id AS session_id,
      count(*) FILTER (epoch_us(ts) / 1000000.0 <= epoch_us(created) / 1000000.0 + 864000) AS n_steps,
      count(*) FILTER (epoch_us(ts) / 1000000.0 > epoch_us(created) / 1000000.0 + 864000) AS n_rejected
    FROM events JOIN s USING (user_id) GROUP BY user_id""",
)
def stream_session_metrics(spark, sf):
    steps = _event_stream(spark, sf).select(F.col("user_id").alias("session_id"), "ts")
    snapshots = run_append(stream_sessions(steps, ttl_seconds=10 * DAY), "sessions")
    return session_totals(snapshots).select("session_id", "n_steps", "n_rejected")


@query(
    "stream_rule_audit",
    f"""WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}
    SELECT session_id, step, action, rec_id, outcome, budget_before, streak, rule FROM audit""",
)
def stream_rule_audit(spark, sf):
    steps = action_log(spark, sf)
    prefix = F.concat_ws("_", F.col("session_id").cast("string"), F.col("event_id").cast("string"))
    numbers = F.when(F.col("n_recs") > 0, F.sequence(F.lit(0), F.col("n_recs") - 1))
    issued = F.transform(numbers, lambda j: F.concat_ws("_", prefix, j.cast("string")))
    path = scratch_path(spark, "steps")
    full = steps.withColumn("issued", issued)
    full.write.parquet(path)
    stream = spark.readStream.schema(full.schema).parquet(path)
    return run_append(stream_audit(stream), "audit")




def _log_lines(spark, sf):
    """The step log as lines of JSON, some of them followed by a broken one."""
    steps = action_log(spark, sf)
    prefix = F.concat_ws("_", F.col("session_id").cast("string"), F.col("event_id").cast("string"))
    numbers = F.when(F.col("n_recs") > 0, F.sequence(F.lit(0), F.col("n_recs") - 1))
    issued = F.to_json(F.transform(numbers, lambda j: F.concat_ws("_", prefix, j.cast("string"))))
    named = ["step", "action", "rec_id", "issued", "accuracy_after", "target_accuracy"]
    lines = event_log.to_event_lines(steps.withColumn("issued", issued), "step", "ts", "session_id", named)
    broken = lines.where(F.pmod(F.crc32("value"), F.lit(97)) == 0).select(F.substring("value", 1, 40).alias("value"))
    path = scratch_path(spark, "step-lines")
    event_log.write_event_log(lines.unionByName(broken), path)
    event_log.write_event_log(steps.where("event_id % 89 = 0").select(F.lit("no json").alias("value")), path)
    return path


@query(
    "stream_log_audit",
    f"""WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}
    SELECT session_id, step, action, rec_id, outcome, budget_before, streak, rule FROM audit""",
)
def stream_log_audit(spark, sf):
    """The live audit, fed by the log's lines; broken lines are kept apart."""
    good, _ = event_log.stream_event_log(spark, _log_lines(spark, sf))
    return run_append(stream_audit(event_log.steps_of(good), delay="400 days"), "log-audit")


@query("stream_bad_lines", "SELECT 'no json' AS value, count(*) AS n FROM events WHERE event_id % 89 = 0")
def stream_bad_lines(spark, sf):
    """Malformed lines of one kind, counted as the stream meets them."""
    _, bad = event_log.stream_event_log(spark, _log_lines(spark, sf))
    return run_append(bad, "bad-lines").where("value = 'no json'").groupBy("value").agg(F.count("*").alias("n"))
