"""Step-log analytics over a log derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import parsing as P
from mendframe.functions import scalar as S
from mendframe.operators import steps as L
from mendframe.operators.scan import Running, count, moving_average, range_chunks, scan
from mendframe.plans.inputs import table
from mendframe.plans.registry import query
from mendframe.session import materialise

# Both engines read these expressions alike.
ACTION = """CASE WHEN event_id % 23 = 0 THEN 'rollback' WHEN event_type = 'signup' THEN 'query_cleaner'
    WHEN event_type = 'view' THEN 'query_augmenter' WHEN event_type = 'error' THEN 'query_validator'
    WHEN event_type = 'purchase' THEN 'query_analyst' ELSE 'apply' END"""
COST = """CASE WHEN action IN ('query_cleaner', 'query_augmenter', 'rollback') THEN 1
    WHEN action IN ('query_validator', 'query_analyst') THEN 2 ELSE 0 END"""
N_RECS = "CAST(CASE WHEN action LIKE 'query%' THEN event_id % 5 ELSE 0 END AS INT)"
REC_ID = """CASE WHEN action <> 'apply' OR event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0
    THEN 'bogus' WHEN asked IS NULL THEN 'none'
    ELSE concat(CAST(session_id AS STRING), '_', CAST(asked AS STRING), '_0') END"""
MEASURES = {
    "accuracy": ("CAST(event_id * 37 % 1000 AS DOUBLE) / 1000", 0.5),
    "missing": ("CAST(event_id * 13 % 100 AS DOUBLE) / 1000", 0.1),
    "balance": ("CAST(event_id * 7 % 500 AS DOUBLE) / 1000", 0.25),
}
TARGET = 0.9
DAY = 86_400


def action_log(spark, sf):
    """One step per event: the user is the session, the event type the action."""
    events = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("session_id"),
        F.expr(ACTION).alias("action"),
    )
    events = events.withColumns({"cost": F.expr(COST), "n_recs": F.expr(N_RECS)})
    applied = F.col("action") == "apply"
    running = {"step": count(), "asked": Running(
        "last", F.when(F.col("action").startswith("query"), F.col("event_id")), through=False)}
    for name, (value, _) in MEASURES.items():
        now = F.when(applied, F.expr(value))
        running[f"{name}_before"] = Running("last", now, through=False)
        running[f"{name}_after"] = Running("last", now)
    ranged = range_chunks(events, ["session_id", "ts", "event_id"])
    log = scan(ranged, ["session_id"], ["ts", "event_id"], F.col("_part"), **running).drop("_part")
    filled = {
        f"{name}_{when}": F.coalesce(F.col(f"{name}_{when}"), F.lit(start))
        for name, (_, start) in MEASURES.items()
        for when in ("before", "after")
    }
    return (
        log.withColumns(filled)
        .withColumn("rec_id", F.expr(REC_ID))
        .withColumn("target_accuracy", F.lit(TARGET))
        .drop("asked")
    )


def stored_log(spark, sf):
    """The step log as a written table, for queries that read it more than once."""
    return materialise(action_log(spark, sf), "steps")


def issued_recs(steps):
    """Recommendations of the query steps: up to four each, numbered by priority."""
    number = F.explode(F.sequence(F.lit(0), F.col("n_recs") - 1)).alias("j")
    return (
        steps.filter(F.col("n_recs") > 0)
        .select("session_id", "event_id", "step", "action", number)
        .select(
            "session_id",
            F.concat_ws("_", F.col("session_id").cast("string"), F.col("event_id").cast("string"), F.col("j").cast("string")).alias("rec_id"),
            "step",
            F.substring("action", 7, 20).alias("agent"),
            (F.col("j") + 1).alias("priority"),
        )
    )


def _log_sql():
    by = "PARTITION BY session_id ORDER BY ts, event_id"
    sql = lambda text: text.replace("STRING", "VARCHAR")
    measures = ", ".join(
        f"""coalesce(last_value(CASE WHEN action = 'apply' THEN {value} END IGNORE NULLS) OVER ({by}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {start}::DOUBLE) AS {name}_before,
        coalesce(last_value(CASE WHEN action = 'apply' THEN {value} END IGNORE NULLS) OVER ({by}
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {start}::DOUBLE) AS {name}_after"""
        for name, (value, start) in MEASURES.items()
    )
    return f"""ev AS (SELECT event_id, ts, user_id AS session_id, {ACTION} AS action FROM events),
    ev2 AS (SELECT *, {COST} AS cost, {N_RECS} AS n_recs FROM ev),
    ev3 AS (SELECT *, row_number() OVER ({by}) AS step, {measures},
      last_value(CASE WHEN action LIKE 'query%' THEN event_id END IGNORE NULLS) OVER ({by}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM ev2),
    log AS (SELECT * EXCLUDE (asked), {sql(REC_ID)} AS rec_id, {TARGET}::DOUBLE AS target_accuracy
      FROM ev3),
    recs AS (SELECT session_id, session_id || '_' || event_id || '_' || j AS rec_id, step,
      substr(action, 7, 20) AS agent, CAST(j + 1 AS INTEGER) AS priority
      FROM (SELECT *, unnest(range(n_recs)) AS j FROM log WHERE n_recs > 0))"""


def _walk_sql(budget=12):
    """The steps of every session one after the other, each on the state the one before left."""
    return f"""handed AS (SELECT l.*, coalesce(ids, []::VARCHAR[]) AS ids FROM log l LEFT JOIN
      (SELECT session_id, step, list(rec_id) AS ids FROM recs GROUP BY ALL) USING (session_id, step)),
    walk AS (SELECT session_id, 0::BIGINT AS step, {budget}::BIGINT AS budget_before,
        {budget}::BIGINT AS budget_remaining, FALSE AS done, NULL::VARCHAR AS last, 0::BIGINT AS streak,
        0::BIGINT AS run, []::VARCHAR[] AS issued, []::VARCHAR[] AS applied, 0 AS stack, 0 AS undone,
        NULL::VARCHAR AS rule, ''::VARCHAR AS outcome, 0::BIGINT AS charged, FALSE AS ends_session
      FROM (SELECT DISTINCT session_id FROM log)
      UNION ALL
      SELECT session_id, step, budget_before, left_now, done OR ends, last, streak, run, issued, applied,
        stack, undone, rule, outcome, charged, ends FROM (SELECT *,
          outcome <> 'after_end' AND outcome <> 'refused' AND (left_now <= 0
            OR (outcome = 'executed' AND action = 'apply' AND reached)) AS ends
        FROM (SELECT *, greatest(0, budget_before - charged)::BIGINT AS left_now,
          CASE WHEN outcome = 'executed' AND action <> 'apply' THEN list_concat(issued0, ids) ELSE issued0 END AS issued,
          CASE WHEN outcome = 'executed' AND action = 'apply' THEN list_append(applied0, rec_id) ELSE applied0 END AS applied,
          CASE WHEN outcome = 'executed' AND action = 'apply' THEN least(3, stack0 + 1)
            WHEN outcome = 'undone' THEN stack0 - 1 ELSE stack0 END AS stack,
          CASE WHEN outcome = 'undone' THEN undone0 + 1 ELSE undone0 END AS undone
        FROM (SELECT *, CASE outcome WHEN 'undone' THEN 1 WHEN 'blocked' THEN 1 WHEN 'executed' THEN cost ELSE 0 END::BIGINT AS charged
        FROM (SELECT *, CASE WHEN done THEN 'after_end'
            WHEN action = 'rollback' THEN CASE WHEN undone0 < 3 AND stack0 > 0 THEN 'undone' ELSE 'refused' END
            WHEN rule IS NOT NULL THEN 'blocked' ELSE 'executed' END AS outcome
        FROM (SELECT *, CASE WHEN done OR action = 'rollback' THEN NULL
            WHEN budget_before <= 0 THEN 'budget_exhausted'
            WHEN streak >= 3 AND action <> 'apply' THEN 'action_spam'
            WHEN action IN ('query_validator', 'query_analyst') AND budget_before < 3 THEN 'low_budget_expensive_query'
            WHEN action = 'apply' AND coalesce(rec_id, '') = '' THEN 'missing_rec_id'
            WHEN action = 'apply' AND list_contains(applied0, rec_id) THEN 'duplicate_apply'
            WHEN action = 'apply' AND NOT list_contains(issued0, rec_id) THEN 'invalid_rec_id' END AS rule
        FROM (SELECT h.session_id, h.step, h.action, h.rec_id, h.cost, h.ids, w.done, w.undone AS undone0,
            w.stack AS stack0, w.issued AS issued0, w.applied AS applied0, w.budget_remaining AS budget_before,
            coalesce(h.accuracy_after >= h.target_accuracy, FALSE) AS reached,
            CASE WHEN w.done OR h.action = 'rollback' THEN 0 WHEN h.action = w.last THEN w.run + 1 ELSE 1 END::BIGINT AS streak,
            CASE WHEN w.done OR h.action = 'rollback' THEN w.run WHEN h.action = w.last THEN w.run + 1 ELSE 1 END::BIGINT AS run,
            CASE WHEN w.done OR h.action = 'rollback' THEN w.last ELSE h.action END AS last
          FROM walk w JOIN handed h ON h.session_id = w.session_id AND h.step = w.step + 1)))))) ),
    audit AS (SELECT l.*, w.outcome, w.rule, w.charged, w.budget_before, w.budget_remaining, w.streak, w.ends_session
      FROM log l JOIN walk w USING (session_id, step))"""


LOG_SQL = _log_sql()
_AUDIT_SQL = _walk_sql()
LOG_COLUMNS = (
    "session_id, step, event_id, action, rec_id, cost, n_recs, accuracy_before, accuracy_after,"
    " missing_before, missing_after, balance_before, balance_after, target_accuracy"
)
_NAMES = [c.strip() for c in LOG_COLUMNS.split(",")]


@query("step_log", f"WITH {LOG_SQL} SELECT {LOG_COLUMNS} FROM log")
def step_log(spark, sf):
    return action_log(spark, sf).select(*_NAMES)


@query("issued_recs", f"WITH {LOG_SQL} SELECT * FROM recs")
def issued(spark, sf):
    return issued_recs(action_log(spark, sf))


@query(
    "budget_ledger",
    f"WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL} SELECT session_id, step, action, outcome, charged, budget_before,"
    " budget_remaining FROM audit",
)
def budget_ledger(spark, sf):
    return audited(spark, sf).select(
        "session_id", "step", "action", "outcome", "charged", "budget_before", "budget_remaining"
    )


_STREAK_SQL = """runs AS (SELECT *, row_number() OVER (PARTITION BY session_id, action, island ORDER BY step) AS streak
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) -
      row_number() OVER (PARTITION BY session_id, action ORDER BY step) AS island
      FROM log WHERE action <> 'rollback'))"""


@query(
    "action_streaks",
    f"""WITH {LOG_SQL}, {_STREAK_SQL}
    SELECT session_id, step, action, streak FROM runs WHERE streak >= 3 AND action <> 'apply'""",
)
def action_streaks(spark, sf):
    return L.action_streaks(stored_log(spark, sf)).select("session_id", "step", "action", "streak")


@query(
    "type_streaks",
    """SELECT user_id, event_id, event_type FROM (SELECT *,
      lag(event_type, 1) OVER w AS l1, lag(event_type, 2) OVER w AS l2 FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = l1 AND event_type = l2 AND event_type <> 'click'""",
)
def type_streaks(spark, sf):
    """Streaks of raw event types, with clicks in the role of apply."""
    events = table(spark, sf, "events").select(
        "event_id", "event_type", F.col("user_id").alias("session_id"),
        F.when(F.col("event_type") == "click", "apply").otherwise(F.col("event_type")).alias("action"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("cost"),
    )
    ranged = range_chunks(events, ["session_id", "ts", "event_id"])
    steps = scan(ranged, ["session_id"], ["ts", "event_id"], F.col("_part"), step=count()).drop("_part")
    return L.action_streaks(steps).select(
        F.col("session_id").alias("user_id"), "event_id", "event_type"
    )


def audited(spark, sf, budget=K.BUDGET):
    steps = stored_log(spark, sf)
    return materialise(L.rule_audit(steps, issued_recs(steps), budget), "audit")


@query(
    "rule_audit",
    f"""WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}
    SELECT session_id, step, action, rec_id, outcome, budget_before, streak, rule FROM audit""",
)
def rule_audit(spark, sf):
    return audited(spark, sf).select(
        "session_id", "step", "action", "rec_id", "outcome", "budget_before", "streak", "rule"
    )


@query(
    "rule_audit_long",
    f"""WITH RECURSIVE {LOG_SQL}, {_walk_sql(60)}
    SELECT session_id, step, action, rec_id, outcome, budget_before, streak, rule FROM audit""",
)
def rule_audit_long(spark, sf):
    """With a budget that outlasts most sessions, so that every outcome occurs often."""
    return audited(spark, sf, budget=60).select(
        "session_id", "step", "action", "rec_id", "outcome", "budget_before", "streak", "rule"
    )


@query(
    "invalid_applies",
    f"""WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL} SELECT session_id, step, rec_id FROM audit
    WHERE rule = 'invalid_rec_id'""",
)
def invalid_applies(spark, sf):
    return L.invalid_applies(audited(spark, sf)).select("session_id", "step", "rec_id")


@query(
    "duplicate_applies",
    f"""WITH RECURSIVE {LOG_SQL}, {_walk_sql(60)} SELECT session_id, step, rec_id FROM audit
    WHERE rule = 'duplicate_apply'""",
)
def duplicate_applies(spark, sf):
    return L.duplicate_applies(audited(spark, sf, budget=60)).select("session_id", "step", "rec_id")


# The same order of operations as the column expressions, so the doubles agree.
_CLAMP = "least(0.999::DOUBLE, greatest(0.001::DOUBLE, {}))"
_Q = "action LIKE 'query%'"
_GAIN = "(accuracy_after - accuracy_before)"
_LESS = "(missing_before - missing_after)"
_MORE = "(balance_after - balance_before)"
_LEFT = "(budget_remaining / 12.0::DOUBLE)"
_SCORES = {
    "format": f"""CASE WHEN {_Q} OR (action = 'apply' AND rec_id IS NOT NULL) THEN 0.999::DOUBLE
      WHEN action = 'apply' THEN 0.2::DOUBLE ELSE 0.001::DOUBLE END""",
    "accuracy": _CLAMP.format(
        f"""CASE WHEN {_Q} THEN 0.45::DOUBLE + 0.05::DOUBLE * least(n_recs, 3) ELSE 0.5::DOUBLE + 0.49::DOUBLE *
      ({_GAIN} / greatest(0.001::DOUBLE, target_accuracy - accuracy_before)) END"""
    ),
    "quality": _CLAMP.format(
        f"CASE WHEN {_Q} THEN 0.45::DOUBLE ELSE 0.5::DOUBLE + ({_LESS} + {_MORE}) END"
    ),
    "efficiency": f"""CASE WHEN {_Q} AND budget_remaining <= 2 THEN 0.15::DOUBLE
      WHEN action = 'apply' AND {_GAIN} <= 0 AND {_LESS} <= 0 AND {_MORE} <= 0 THEN 0.1::DOUBLE
      WHEN {_Q} THEN {_CLAMP.format(f'0.5::DOUBLE + 0.3::DOUBLE * {_LEFT}')}
      ELSE {_CLAMP.format(f'0.5::DOUBLE + 0.49::DOUBLE * {_LEFT}')} END""",
    "completion": f"""CASE WHEN accuracy_after >= target_accuracy
      THEN {_CLAMP.format(f'0.9::DOUBLE + 0.09::DOUBLE * {_LEFT}')}
      WHEN accuracy_after > accuracy_before
      THEN {_CLAMP.format('0.5::DOUBLE + 0.4::DOUBLE * (accuracy_after / target_accuracy)')}
      WHEN {_Q} AND n_recs > 0 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END""",
}
_SCORED_SQL = f"""{_AUDIT_SQL},
    graded AS (SELECT *, {", ".join(f"{sql} AS {name}_score" for name, sql in _SCORES.items())} FROM audit),
    scored AS (SELECT *, outcome = 'executed' AS in_history,
      CASE outcome WHEN 'undone' THEN 0.3::DOUBLE WHEN 'blocked' THEN 0.001::DOUBLE WHEN 'executed' THEN
        round_even({_CLAMP.format(" + ".join(f"{n}_score * {w}::DOUBLE" for n, w in K.REWARD_WEIGHTS.items()))}, 4)
      END AS reward FROM graded)"""


def scored_steps(spark, sf):
    return L.score_steps(audited(spark, sf))


@query(
    "reward_scores",
    f"WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} SELECT session_id, step, action, outcome, rule, in_history, reward FROM scored",
)
def reward_scores(spark, sf):
    return scored_steps(spark, sf).select(
        "session_id", "step", "action", "outcome", "rule", "in_history", "reward"
    )


@query(
    "reward_components",
    f"WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT session_id, step, reward, '{n}' AS grader, round_even({n}_score, 4) AS score,
        {w}::DOUBLE AS weight, round_even({n}_score * {w}::DOUBLE, 4) AS contribution FROM scored
        WHERE in_history"""
        for n, w in K.REWARD_WEIGHTS.items()
    ),
)
def reward_components(spark, sf):
    return L.reward_decomposition(audited(spark, sf))


@query(
    "reward_range_check",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} SELECT count(reward) AS n_rewards,
      count(*) FILTER (NOT (reward > 0 AND reward < 1)) AS n_violations FROM scored""",
)
def reward_range_check(spark, sf):
    return L.reward_range_violations(scored_steps(spark, sf))


@query(
    "done_flag",
    f"""WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL} SELECT session_id, step, ends_session,
      outcome = 'after_end' AS after_end FROM audit""",
)
def done_flag(spark, sf):
    return L.done_flags(audited(spark, sf)).select("session_id", "step", "ends_session", "after_end")


@query(
    "accuracy_deltas",
    f"""WITH {LOG_SQL}, d AS (SELECT *, round_even(accuracy_after - accuracy_before, 4) AS accuracy_delta,
      first_value(accuracy_before) OVER (PARTITION BY session_id ORDER BY step) AS start FROM log)
    SELECT session_id, step, accuracy_delta, CASE WHEN accuracy_delta > 0.001 THEN 'improved'
      WHEN accuracy_delta < -0.001 THEN 'hurt' ELSE 'neutral' END AS effect,
      round_even(accuracy_after - start, 4) AS improvement_over_start FROM d WHERE action = 'apply'""",
)
def accuracy_deltas(spark, sf):
    return L.accuracy_deltas(stored_log(spark, sf)).select(
        "session_id", "step", "accuracy_delta", "effect", "improvement_over_start"
    )


@query(
    "recent_trace",
    f"""WITH {LOG_SQL} SELECT session_id, step, action, accuracy_after FROM (SELECT *,
      row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS r FROM log) WHERE r <= 5""",
)
def recent_trace(spark, sf):
    return L.recent_trace(action_log(spark, sf)).select("session_id", "step", "action", "accuracy_after")


_PENDING_SQL = """pending AS (SELECT r.* FROM recs r JOIN audit q ON q.session_id = r.session_id AND q.step = r.step
      AND q.outcome = 'executed' WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.action = 'apply'
      AND a.outcome = 'executed' AND a.session_id = r.session_id AND a.rec_id = r.rec_id)),
    best AS (SELECT session_id, arg_min(rec_id, (priority, rec_id)) AS rec_id,
      min(priority) AS priority, count(*) AS n_pending FROM pending GROUP BY session_id)"""


@query("pending_recs", f"WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}, {_PENDING_SQL} SELECT * FROM pending")
def pending_recs(spark, sf):
    steps = audited(spark, sf)
    return L.pending_recs(steps, issued_recs(steps)).select(
        "session_id", "rec_id", "step", "agent", "priority"
    )


@query("best_pending", f"WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}, {_PENDING_SQL} SELECT * FROM best")
def best_pending(spark, sf):
    steps = audited(spark, sf)
    return L.best_pending(steps, issued_recs(steps))


_CHANGED = "(outcome = 'undone' OR (outcome = 'executed' AND action = 'apply'))"
_LATEST = ", ".join(
    f"""coalesce(arg_max({m}_after, step) FILTER (WHERE {_CHANGED}), arg_min({m}_before, step)) AS {m}"""
    for m in ("missing", "balance", "accuracy")
)
_STATE_SQL = f"""{_PENDING_SQL}, state AS (SELECT session_id, {_LATEST},
      arg_min(accuracy_before, step) AS start, min(budget_remaining) AS budget_remaining,
      {", ".join(f"bool_or(action = '{a}' AND outcome = 'executed') AS asked_{a[6:]}" for a in K.QUERY_ACTIONS)}
      FROM audit GROUP BY session_id)"""
_NEXT_SQL = f"""chosen AS (SELECT s.session_id, b.rec_id,
      CASE WHEN budget_remaining <= 0 THEN 'stop'
      WHEN NOT ({" OR ".join(f"asked_{a[6:]}" for a in K.QUERY_ACTIONS)}) THEN 'query_analyst'
      WHEN b.rec_id IS NOT NULL THEN 'apply'
      WHEN missing > 0.05 AND NOT asked_cleaner THEN 'query_cleaner'
      WHEN balance < 0.45 AND NOT asked_balancer THEN 'query_balancer'
      WHEN NOT asked_augmenter THEN 'query_augmenter' ELSE 'stop' END AS next_action
      FROM state s LEFT JOIN best b USING (session_id))
    SELECT session_id, next_action, CASE WHEN next_action = 'apply' THEN rec_id END AS rec_id,
      CASE WHEN next_action = 'query_augmenter' THEN 1 END AS target_class FROM chosen"""


@query("next_action", f"WITH RECURSIVE {LOG_SQL}, {_AUDIT_SQL}, {_STATE_SQL}, {_NEXT_SQL}")
def next_action(spark, sf):
    steps = audited(spark, sf)
    return L.next_action(steps, issued_recs(steps))


@query("next_action_early", f"WITH RECURSIVE {LOG_SQL}, {_walk_sql(1000)}, {_STATE_SQL}, {_NEXT_SQL}")
def next_action_early(spark, sf):
    """With a budget so large that sessions end by their target alone."""
    steps = audited(spark, sf, budget=1000)
    return L.next_action(steps, issued_recs(steps))


@query(
    "rollback_state",
    f"""WITH RECURSIVE {LOG_SQL}, n AS (SELECT session_id, step, action, count(*) FILTER (action = 'apply')
      OVER (PARTITION BY session_id ORDER BY step) AS applied FROM log),
    moves AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) AS i FROM n
      WHERE action IN ('apply', 'rollback')),
    walk AS (SELECT session_id, 0::BIGINT AS i, 0::BIGINT AS version, []::BIGINT[] AS stack,
        0::BIGINT AS undone, 0::BIGINT AS refused, 0::BIGINT AS applies
      FROM (SELECT DISTINCT session_id FROM log)
      UNION ALL
      SELECT w.session_id, m.i,
        CASE WHEN m.action = 'apply' THEN w.applies + 1
          WHEN w.undone < 3 AND len(w.stack) > 0 THEN w.stack[-1] ELSE w.version END,
        CASE WHEN m.action = 'apply' THEN list_append(w.stack, w.version)[-3:]
          WHEN w.undone < 3 AND len(w.stack) > 0 THEN w.stack[:-2] ELSE w.stack END,
        CASE WHEN m.action = 'rollback' AND w.undone < 3 AND len(w.stack) > 0 THEN w.undone + 1
          ELSE w.undone END,
        CASE WHEN m.action = 'rollback' AND NOT (w.undone < 3 AND len(w.stack) > 0) THEN w.refused + 1
          ELSE w.refused END,
        CASE WHEN m.action = 'apply' THEN w.applies + 1 ELSE w.applies END
      FROM walk w JOIN moves m ON m.session_id = w.session_id AND m.i = w.i + 1)
    SELECT session_id, applies AS n_applies, undone AS n_restored, refused AS n_refused,
      version AS current_version, CAST(3 - undone AS INTEGER) AS rollbacks_left
    FROM walk w WHERE i = (SELECT count(*) FROM moves m WHERE m.session_id = w.session_id)""",
)
def rollback_state(spark, sf):
    return L.rollback_state(stored_log(spark, sf))


_EPISODES_SQL = f"""episodes AS (SELECT session_id,
      count(*) FILTER (outcome IN ('executed', 'blocked', 'undone')) AS n_steps,
      count(*) FILTER (in_history) AS n_rewards,
      coalesce(round_even(sum(round_even(reward * 10000, 0)) FILTER (in_history)
        / count(*) FILTER (in_history), 0) / 10000, 0) AS mean_reward,
      coalesce(sum(round_even(reward * 10000, 0)) FILTER (in_history) / 10000, 0) AS total_reward,
      round_even(greatest(max(accuracy_after) FILTER (WHERE {_CHANGED}), arg_min(accuracy_before, step)), 4) AS best_accuracy,
      round_even(coalesce(arg_max(accuracy_after, step) FILTER (WHERE {_CHANGED}), arg_min(accuracy_before, step)), 4)
        AS last_accuracy,
      count(*) FILTER (outcome = 'undone') AS n_rollbacks,
      bool_or(action = 'apply' AND outcome = 'executed' AND accuracy_after >= target_accuracy) AS success
      FROM scored GROUP BY session_id)"""


@query("episode_summary", f"WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL}, {_EPISODES_SQL} SELECT * FROM episodes")
def episode_summary(spark, sf):
    return L.episode_summary(scored_steps(spark, sf))


@query(
    "overall_summary",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL}, {_EPISODES_SQL} SELECT count(*) AS n_episodes,
      round_even(avg(mean_reward), 6) AS mean_reward, round_even(avg(total_reward), 6) AS mean_total_reward,
      round_even(avg(success::INTEGER), 6) AS success_rate FROM episodes""",
)
def overall_summary(spark, sf):
    return L.overall_summary(L.episode_summary(scored_steps(spark, sf)))


@query(
    "trajectories",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} SELECT session_id, CAST(floor(step / 1000) AS BIGINT) AS part,
      CAST(count(*) AS INTEGER) AS n_steps, string_agg(CAST(action AS VARCHAR), '>' ORDER BY step) AS actions,
      round_even(sum(reward), 4) AS reward_sum, round_even(sum(accuracy_after), 4) AS accuracy_sum
    FROM scored WHERE outcome IN ('executed', 'blocked', 'undone') GROUP BY session_id, part""",
)
def trajectories(spark, sf):
    total = lambda c: S.round_even(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return L.trajectories(scored_steps(spark, sf)).select(
        "session_id", "part", "n_steps", F.array_join("actions", ">").alias("actions"),
        total("reward_history").alias("reward_sum"), total("accuracy_history").alias("accuracy_sum"),
    )


@query(
    "session_metrics",
    f"""WITH {LOG_SQL}, s AS (SELECT session_id, min(ts) AS created, count(*) AS n FROM log GROUP BY ALL),
    t AS (SELECT max(ts) AS now FROM log)
    SELECT count(*) FILTER (now <= created + INTERVAL 25 DAY) AS active_sessions,
      count(*) AS total_sessions,
      round_even(coalesce(avg(n) FILTER (now <= created + INTERVAL 25 DAY), 0), 2) AS avg_steps_active
    FROM s, t""",
)
def session_metrics(spark, sf):
    steps = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    now = steps.agg(F.max("ts").alias("now")).first()["now"]
    return L.session_metrics(steps, F.lit(now), ttl_seconds=25 * DAY)


@query(
    "reward_moving_avg",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL}, {_EPISODES_SQL}
    SELECT session_id, moving_avg FROM (SELECT session_id, round_even(avg(mean_reward) OVER w, 6) AS moving_avg,
      count(*) OVER w AS n FROM episodes
      WINDOW w AS (ORDER BY session_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""",
)
def reward_moving_avg(spark, sf):
    episodes = L.episode_summary(scored_steps(spark, sf))
    return moving_average(episodes, "session_id", "mean_reward", 5).select(
        "session_id", S.round_even("moving_avg", 6).alias("moving_avg")
    )


@query(
    "reward_histogram",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL}, b AS (SELECT min(reward) AS lo, max(reward) AS hi FROM scored WHERE reward IS NOT NULL)
    SELECT CAST(least(floor((reward - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
    FROM scored, b WHERE reward IS NOT NULL GROUP BY bin""",
)
def reward_histogram(spark, sf):
    return L.reward_histogram(_stored(scored_steps(spark, sf)))


@query(
    "reward_markers",
    f"""WITH RECURSIVE {LOG_SQL}, {_SCORED_SQL} SELECT round_even(avg(reward), 6) AS mean_reward,
      round_even(quantile_cont(reward, 0.5), 6) AS median_reward FROM scored""",
)
def reward_markers(spark, sf):
    from mendframe.operators.quantiles import fit_medians

    scored = _stored(scored_steps(spark, sf))
    middle = fit_medians(scored, ["reward"])["reward"]
    return scored.agg(
        S.round_even(F.avg("reward"), 6).alias("mean_reward"),
        S.round_even(F.lit(middle), 6).alias("median_reward"),
    )


def _stored(scored):
    """The reward column alone, written once for statistics that read it twice."""
    return materialise(scored.select("reward"), "rewards")


@query(
    "valid_actions",
    """WITH r AS (SELECT event_id, event_type, CASE WHEN event_type = 'signup' THEN 'query_cleaner'
      WHEN event_type = 'click' THEN 'apply' ELSE event_type END AS action,
      CAST(event_id % 3 AS INTEGER) AS target_class FROM events)
    SELECT event_id, action, CASE WHEN action NOT IN ('query_cleaner', 'apply') THEN 'unknown action'
      WHEN target_class NOT IN (0, 1) THEN 'target_class must be 0 or 1' END AS reject_reason FROM r""",
)
def valid_actions(spark, sf):
    requests = table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE event_type WHEN 'signup' THEN 'query_cleaner' WHEN 'click' THEN 'apply'"
               " ELSE event_type END").alias("action"),
        F.expr("CAST(event_id % 3 AS INT)").alias("target_class"),
    )
    valid, rejected = L.split_valid(requests)
    return valid.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected).drop(
        "target_class"
    )


@query(
    "known_sessions",
    """SELECT conv_id AS session_id, turn, conv_id IN (SELECT user_id FROM events) AS known
    FROM conversations""",
)
def known_sessions(spark, sf):
    steps = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    sessions = table(spark, sf, "events").select(F.col("user_id").alias("session_id"))
    known, unknown = L.split_known_sessions(steps, sessions)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


# Responses: JSON inside free text, some of it broken.
_RESPONSE = """CASE WHEN event_id % 11 = 0 THEN '{"action": "apply", "agent": "cleaner"}'
    WHEN event_id % 9 = 0 THEN concat('no json here ', event_type)
    WHEN event_id % 7 = 0 THEN concat('{"agent": "', event_type, '", "target": "all"}')
    WHEN event_id % 5 = 0 THEN concat('I choose {"agent": "balancer",', chr(10), ' "strategy": "x"} now')
    WHEN event_id % 3 = 0 THEN concat('{"agent": {"name": "cleaner"}, "k": ', props, '}')
    ELSE concat('text ', props, ' tail') END"""
_RESPONSES_SQL = f"resp AS (SELECT event_id, ts, value, {_RESPONSE} AS response FROM events)"
_SPAN = r"regexp_extract(response, '\{[^}]+\}', 0)"
_AGENT_SQL = f"""coalesce(CASE WHEN json_valid({_SPAN}) THEN json_extract_string({_SPAN}, '$.agent') END,
      '{P.INVALID_AGENT}')"""


def responses(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "value", F.expr(_RESPONSE).alias("response")
    )


@query(
    "parse_action_strict",
    f"""WITH {_RESPONSES_SQL} SELECT event_id, coalesce(CASE WHEN json_valid(response) AND
      json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT'
      THEN json_extract_string(response, '$.action') END, '{P.FALLBACK_ACTION}') AS action FROM resp""",
)
def parse_action_strict(spark, sf):
    return responses(spark, sf).select("event_id", P.strict_action(F.col("response")).alias("action"))


@query(
    "parse_action_lenient", f"WITH {_RESPONSES_SQL} SELECT event_id, {_AGENT_SQL} AS agent FROM resp"
)
def parse_action_lenient(spark, sf):
    return responses(spark, sf).select("event_id", P.lenient_agent(F.col("response")).alias("agent"))


@query(
    "json_number_sum",
    "SELECT sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events",
)
def json_number_sum(spark, sf):
    k = P.lenient_field(F.col("props"), "k").cast("bigint")
    return table(spark, sf, "events").agg(F.sum(k).alias("total"))


@query(
    "tool_distribution",
    f"WITH {_RESPONSES_SQL}, a AS (SELECT {_AGENT_SQL} AS agent FROM resp)"
    " SELECT agent, count(*) AS n FROM a GROUP BY agent",
)
def tool_distribution(spark, sf):
    agents = responses(spark, sf).select(P.lenient_agent(F.col("response")).alias("agent"))
    return L.tool_distribution(agents)


_REPORT_SQL = f"""{_RESPONSES_SQL}, g AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before'
      ELSE 'after' END AS period, {_AGENT_SQL} AS agent, value AS reward FROM resp),
    rep AS (SELECT period, count(*) AS n_responses, round_even(avg((agent IN ('cleaner', 'augmenter',
      'balancer', 'relabeler', 'validator'))::INTEGER), 6) AS valid_rate,
      round_even(sum(round_even(reward * 10000, 0)) / count(reward) / 10000, 6) AS mean_reward,
      count(DISTINCT agent) AS n_tools,
      count(DISTINCT agent) = 1 AS single_tool FROM g GROUP BY period)"""


def _generations(spark, sf):
    late = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    return L.generation_report(
        responses(spark, sf).select(
            F.when(late, "after").otherwise("before").alias("period"),
            P.lenient_agent(F.col("response")).alias("agent"),
            F.col("value").alias("reward"),
        )
    )


@query("generation_report", f"WITH {_REPORT_SQL} SELECT * FROM rep")
def generation_report(spark, sf):
    return _generations(spark, sf)


@query(
    "before_after",
    f"""WITH {_REPORT_SQL} SELECT b.valid_rate AS valid_rate_before, b.mean_reward AS mean_reward_before,
      b.n_tools AS n_tools_before, a.valid_rate AS valid_rate_after, a.mean_reward AS mean_reward_after,
      a.n_tools AS n_tools_after, a.mean_reward > b.mean_reward AS reward_improved
    FROM rep b, rep a WHERE b.period = 'before' AND a.period = 'after'""",
)
def before_after(spark, sf):
    return L.before_after(_generations(spark, sf), "before", "after")
