"""Analytics over a step log: budgets, rule violations, rewards, undo, next actions.

A step log has one row per step of a session: ``session_id``, ``step`` (1, 2, ... within the
session), ``action``, ``rec_id``, ``cost``, ``n_recs`` and the accuracy, missing share and
class balance before and after the step. Recommendations issued by query steps are a second
table: ``session_id``, ``rec_id``, ``step``, ``agent``, ``priority``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators.replay import EFFECTIVE, replay
from mendframe.operators.scan import Running, as_of_each, count, scan, step_chunk, top_rows

SESSION = ["session_id"]
ORDER = ["step"]
REC = ["session_id", "rec_id"]


def is_query(action: Column | str = "action") -> Column:
    return S._col(action).isin(K.QUERY_ACTIONS)


# Validation of incoming rows.


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known action and class, and the rejected rest with the reason."""
    problem = F.when(
        ~F.coalesce(F.col("action").isin(K.VALID_ACTIONS), F.lit(False)), "unknown action"
    )
    if "target_class" in requests.columns:
        bad = F.col("target_class").isNotNull() & ~F.col("target_class").isin(0, 1)
        problem = problem.when(bad, "target_class must be 0 or 1")
    if "difficulty" in requests.columns:
        bad = F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(K.DIFFICULTIES)
        problem = problem.when(bad, "unknown difficulty")
    checked = requests.withColumn("reject_reason", problem)
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, checked.filter(F.col("reject_reason").isNotNull())


def split_known_sessions(steps: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of a known session, and the steps of no session at all."""
    known = sessions.select(*SESSION).distinct()
    return steps.join(known, SESSION, "left_semi"), steps.join(known, SESSION, "left_anti")


# Running state.


def action_streaks(steps: DataFrame, length: int = K.STREAK) -> DataFrame:
    """Steps that repeat the same action for the ``length``-th time or more; apply is exempt.

    Rollbacks are no part of a run.
    """
    runs = scan(
        steps, SESSION, ORDER, step_chunk(),
        streak=Running("run", F.when(F.col("action") != "rollback", F.col("action"))),
    )
    return runs.filter((F.col("streak") >= length) & (F.col("action") != "apply"))


def rule_audit(
    steps: DataFrame, recs: DataFrame, budget: int = K.BUDGET, streak: int = K.STREAK
) -> DataFrame:
    """Steps with outcome, charged cost, budget, streak and the rule they break (null if none)."""
    return replay(steps, recs, budget, streak)


def budget_ledger(steps: DataFrame, recs: DataFrame, budget: int = K.BUDGET) -> DataFrame:
    """What each step is charged, and the budget before and after it."""
    return replay(steps, recs, budget)


def invalid_applies(audited: DataFrame) -> DataFrame:
    """Applies of a recommendation that no executed query of the session had issued before."""
    return audited.filter(F.col("rule") == "invalid_rec_id")


def duplicate_applies(audited: DataFrame) -> DataFrame:
    """Applies of a recommendation that was applied before."""
    return audited.filter(F.col("rule") == "duplicate_apply")


def effective(audited: DataFrame) -> DataFrame:
    """Steps that took place: neither refused nor after the end of their session."""
    return audited.filter(F.col("outcome").isin(*EFFECTIVE))


def executed(action: Column) -> Column:
    """Whether an action was carried out, neither blocked, refused nor too late."""
    return action & (F.col("outcome") == "executed")


def changed() -> Column:
    """Whether a step changed the table: an executed apply or a rollback that worked."""
    return executed(F.col("action") == "apply") | (F.col("outcome") == "undone")


def done_flags(audited: DataFrame) -> DataFrame:
    """Whether a step ends its session, and whether it comes after the end.

    A session ends with an executed apply that reaches the target or when the budget is used up.
    """
    return audited.withColumn("after_end", F.col("outcome") == "after_end")


def accuracy_deltas(steps: DataFrame, band: float = K.EFFECT_BAND) -> DataFrame:
    """Change of accuracy by each apply, with its effect and the gain since the session start."""
    started = scan(
        steps, SESSION, ORDER, step_chunk(), start_accuracy=Running("first", F.col("accuracy_before"))
    )
    delta = S.round_even(F.col("accuracy_after") - F.col("accuracy_before"), 4)
    return (
        started.filter(F.col("action") == "apply")
        .withColumn("accuracy_delta", delta)
        .withColumn(
            "effect",
            F.when(F.col("accuracy_delta") > band, "improved")
            .when(F.col("accuracy_delta") < -band, "hurt")
            .otherwise("neutral"),
        )
        .withColumn(
            "improvement_over_start", S.round_even(F.col("accuracy_after") - F.col("start_accuracy"), 4)
        )
    )


def recent_trace(steps: DataFrame, n: int = K.RECENT_STEPS) -> DataFrame:
    """The last ``n`` steps of every session."""
    return top_rows(steps, SESSION, [F.col("step").desc()], n, step_chunk())


# Rewards.


def reward_components(steps: DataFrame, budget: int = K.BUDGET) -> DataFrame:
    """Score of each grader for query and apply steps (0.001 to 0.999)."""
    query = is_query()
    is_apply = F.col("action") == "apply"
    before, after, target = F.col("accuracy_before"), F.col("accuracy_after"), F.col("target_accuracy")
    gain = after - before
    less_missing = F.col("missing_before") - F.col("missing_after")
    more_balance = F.col("balance_after") - F.col("balance_before")
    left = F.col("budget_remaining") / F.lit(float(budget))
    has_rec = F.coalesce(F.col("rec_id"), F.lit("")) != ""
    room = F.greatest(F.lit(0.001), target - before)
    unchanged = (gain <= 0) & (less_missing <= 0) & (more_balance <= 0)
    scores = {
        "format": F.when(query | (is_apply & has_rec), K.REWARD_CEILING)
        .when(is_apply, 0.2)
        .otherwise(K.REWARD_FLOOR),
        "accuracy": S.clamp_reward(
            F.when(query, K.QUERY_BASE + K.QUERY_PER_REC * F.least(F.col("n_recs"), F.lit(K.RECS_REWARDED)))
            .otherwise(K.NEUTRAL_SCORE + K.GAIN_SLOPE * (gain / room))
        ),
        "quality": S.clamp_reward(
            F.when(query, K.QUERY_BASE).otherwise(K.NEUTRAL_SCORE + (less_missing + more_balance))
        ),
        "efficiency": F.when(query & (F.col("budget_remaining") <= K.LOW_BUDGET), 0.15)
        .when(is_apply & unchanged, 0.1)
        .when(query, S.clamp_reward(K.NEUTRAL_SCORE + K.QUERY_LEFT_SLOPE * left))
        .otherwise(S.clamp_reward(K.NEUTRAL_SCORE + K.GAIN_SLOPE * left)),
        "completion": F.when(after >= target, S.clamp_reward(K.DONE_BASE + K.DONE_LEFT_SLOPE * left))
        .when(after > before, S.clamp_reward(K.NEUTRAL_SCORE + K.PROGRESS_SLOPE * (after / target)))
        .when(query & (F.col("n_recs") > 0), 0.35)
        .otherwise(0.1),
    }
    return steps.withColumns({f"{name}_score": score for name, score in scores.items()})


def reward_total() -> Column:
    """Weighted sum of the grader scores, rounded to four places."""
    total = sum(
        (F.col(f"{name}_score") * F.lit(weight) for name, weight in K.REWARD_WEIGHTS.items()),
        F.lit(0.0),
    )
    return S.round_even(S.clamp_reward(total), 4)


def score_steps(audited: DataFrame, budget: int = K.BUDGET) -> DataFrame:
    """Reward of every step of an audited log.

    Working rollbacks and blocked steps have constant rewards that stay out of the reward history;
    refused steps and steps after the end have none.
    """
    scored = reward_components(audited, budget)
    outcome = F.col("outcome")
    reward = (
        F.when(outcome == "undone", K.ROLLBACK_REWARD)
        .when(outcome == "blocked", K.BLOCKED_REWARD)
        .when(outcome == "executed", reward_total())
    )
    return scored.withColumns({"reward": reward, "in_history": outcome == "executed"})


def reward_decomposition(audited: DataFrame, budget: int = K.BUDGET) -> DataFrame:
    """One row per step and grader: score, weight and contribution."""
    scored = score_steps(audited, budget).filter("in_history")
    graders = F.array(
        *[
            F.struct(
                F.lit(name).alias("grader"),
                S.round_even(F.col(f"{name}_score"), 4).alias("score"),
                F.lit(weight).alias("weight"),
                S.round_even(F.col(f"{name}_score") * weight, 4).alias("contribution"),
            )
            for name, weight in K.REWARD_WEIGHTS.items()
        ]
    )
    return scored.select("session_id", "step", "reward", F.inline(graders))


def reward_range_violations(scored: DataFrame) -> DataFrame:
    """Number of rewards, and of rewards that are not strictly between 0 and 1."""
    inside = (F.col("reward") > 0) & (F.col("reward") < 1)
    return scored.agg(
        F.count("reward").alias("n_rewards"),
        F.count_if(~inside).alias("n_violations"),
    )


# Pending recommendations and the next action.


def pending_recs(audited: DataFrame, recs: DataFrame) -> DataFrame:
    """Recommendations of executed queries that no executed apply has used up."""
    asked = audited.filter(executed(is_query())).select("session_id", "step")
    applied = audited.filter(executed(F.col("action") == "apply")).select(*REC)
    return recs.join(asked, ["session_id", "step"], "left_semi").join(applied, REC, "left_anti")


def best_pending(audited: DataFrame, recs: DataFrame) -> DataFrame:
    """Per session the pending recommendation of the lowest priority number."""
    return (
        pending_recs(audited, recs)
        .groupBy(*SESSION)
        .agg(
            F.min(F.struct("priority", "rec_id")).alias("_best"),
            F.count(F.lit(1)).alias("n_pending"),
        )
        .select(
            "session_id",
            F.col("_best.rec_id").alias("rec_id"),
            F.col("_best.priority").alias("priority"),
            "n_pending",
        )
    )


def session_state(audited: DataFrame) -> DataFrame:
    """Latest state of every session and the agents it has asked; map-side combined.

    The table is as the last step that changed it left it, or as the session found it.
    """
    at = F.col("step")
    latest = {
        f"{c}_after": F.coalesce(
            F.max_by(f"{c}_after", F.when(changed(), at)), F.min_by(f"{c}_before", at)
        ).alias(f"{c}_after")
        for c in ("accuracy", "missing", "balance")
    }
    asked = {
        name: F.max(executed(F.col("action") == action)).alias(f"asked_{name}")
        for action in K.QUERY_ACTIONS
        for name in [action.removeprefix("query_")]
    }
    return audited.groupBy(*SESSION).agg(
        F.max("step").alias("last_step"),
        *latest.values(),
        F.max("target_accuracy").alias("target_accuracy"),
        F.min("budget_remaining").alias("budget_remaining"),
        *asked.values(),
    )


def next_action(ledger: DataFrame, recs: DataFrame) -> DataFrame:
    """The next step of the plan: analyst first, then the best pending recommendation, then
    the agent the table needs most, else stop."""
    state = session_state(ledger).join(best_pending(ledger, recs), SESSION, "left")
    asked_any = F.greatest(*[F.col(f"asked_{a.removeprefix('query_')}") for a in K.QUERY_ACTIONS])
    action = (
        F.when(F.col("budget_remaining") <= 0, "stop")
        .when(~asked_any, "query_analyst")
        .when(F.col("rec_id").isNotNull(), "apply")
        .when((F.col("missing_after") > K.PLAN_MISSING_SHARE) & ~F.col("asked_cleaner"), "query_cleaner")
        .when((F.col("balance_after") < K.BALANCED_RATIO) & ~F.col("asked_balancer"), "query_balancer")
        .when(~F.col("asked_augmenter"), "query_augmenter")
        .otherwise("stop")
    )
    return state.select(
        "session_id",
        action.alias("next_action"),
        F.when(action == "apply", F.col("rec_id")).alias("rec_id"),
        F.when(action == "query_augmenter", 1).alias("target_class"),
    )


#: What an evaluation tells an observation.
EVALUATED = ["majority_class_baseline", "n_train_rows", "n_holdout_rows", "n_cols", "top_positive", "top_negative"]
_FEATURES = "array<struct<feature:string,coef:double>>"
_EVALUATED_TYPES = dict(zip(EVALUATED, ["double", "bigint", "bigint", "bigint", _FEATURES, _FEATURES], strict=True))
#: What is told of a pending recommendation besides its id.
DESCRIBED = {"agent": "string", "type": "string", "priority": "int", "reason": "string", "domain_informed": "boolean"}


def pending_lists(audited: DataFrame, recs: DataFrame) -> DataFrame:
    """Per session a map from the id of each pending recommendation to what is told of it, best first.

    A session hands out within its budget, so the map is short. Columns that ``recs`` lacks are null.
    """
    told = F.struct(*[(F.col(c) if c in recs.columns else F.lit(None)).cast(t).alias(c) for c, t in DESCRIBED.items()])
    once = pending_recs(audited, recs).groupBy(*REC).agg(F.min(F.struct("priority", told.alias("told"))).alias("_p"))
    entry = F.struct(F.col("_p.priority").alias("priority"), "rec_id", F.col("_p.told").alias("told"))
    listed = once.groupBy(*SESSION).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    pairs = F.transform("_l", lambda x: F.struct(x["rec_id"], x["told"]))
    return listed.select(*SESSION, F.map_from_entries(pairs).alias("pending_recommendations"))


def query_results(audited: DataFrame, recs: DataFrame) -> DataFrame:
    """``session_id, step, last_query_result`` of every executed query: its agent and what it recommended."""
    listed = recs.groupBy("session_id", "step").agg(F.array_sort(F.collect_list(F.struct("priority", "rec_id"))).alias("_l"))
    asked = audited.filter(executed(is_query())).select("session_id", "step", "action")
    ids = F.coalesce(F.transform("_l", lambda x: x["rec_id"]), F.array().cast("array<string>"))
    result = F.struct(F.substring("action", 7, 20).alias("agent"), F.size(ids).alias("n_recs"), ids.alias("rec_ids"))
    return asked.join(listed, ["session_id", "step"], "left").select("session_id", "step", result.alias("last_query_result"))


def observations(
    ledger: DataFrame,
    recs: DataFrame,
    meta: DataFrame | None = None,
    evaluations: DataFrame | None = None,
    trace_steps: int = K.RECENT_STEPS,
) -> DataFrame:
    """One nested row per session: all that an agent sees of it after its last step.

    ``meta`` has one row per session from the dataset catalogue (``with_metadata``); ``evaluations`` has
    ``session_id, step`` and the columns ``EVALUATED``. The last evaluation and the last query result
    up to the session's last step are found by as-of joins; what has none is null.
    """
    trace = (
        recent_trace(effective(ledger), trace_steps)
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("step", "action", "rec_id", "outcome", "rule", "accuracy_after"))).alias("episode_trace"))
    )
    start = ledger.groupBy(*SESSION).agg(F.min_by("accuracy_before", "step").alias("starting_accuracy"))
    seen = session_state(ledger).withColumnRenamed("last_step", "step")
    rights = [(query_results(ledger, recs), ["last_query_result"])]
    if evaluations is not None:
        rights.append((evaluations, EVALUATED))
    seen = as_of_each(seen, rights, SESSION, "step")
    if evaluations is None:
        seen = seen.withColumns({c: F.lit(None).cast(t) for c, t in _EVALUATED_TYPES.items()})
    joined = seen.join(start, SESSION).join(trace, SESSION, "left").join(pending_lists(ledger, recs), SESSION, "left")
    about = ["name", "domain", "description", "known_issues", "published_baseline", "difficulty"]
    if meta is not None:
        joined = joined.join(meta.select("session_id", F.col("display_name").alias("name"), *about[1:]), SESSION, "left")
    else:
        types = ["string", "string", "string", "array<string>", "double", "string"]
        joined = joined.withColumns({c: F.lit(None).cast(t) for c, t in zip(about, types, strict=True)})
    current, target = F.col("accuracy_after"), F.col("target_accuracy")
    return joined.select(
        "session_id",
        F.struct(*about[:5]).alias("dataset"),
        S.round_even(current, 4).alias("current_accuracy"),
        target.alias("target_accuracy"),
        S.round_even(S.accuracy_gap(current, target), 4).alias("accuracy_gap"),
        "budget_remaining",
        "difficulty",
        F.struct(
            "majority_class_baseline",
            S.round_even("starting_accuracy", 4).alias("starting_accuracy"),
            S.round_even(current - F.col("starting_accuracy"), 4).alias("improvement_over_start"),
            S.round_even(current - F.col("majority_class_baseline"), 4).alias("improvement_over_baseline"),
            "published_baseline",
        ).alias("benchmarks"),
        F.struct(
            "n_train_rows",
            "n_holdout_rows",
            "n_cols",
            S.round_even("missing_after", 4).alias("missing_pct"),
            S.round_even("balance_after", 4).alias("balance_ratio"),
        ).alias("dataset_stats"),
        F.struct("top_positive", "top_negative").alias("feature_importance"),
        "episode_trace",
        "pending_recommendations",
        "last_query_result",
        F.lit(K.AVAILABLE_ACTIONS).alias("available_actions"),
    )


# Undo.


def rollback_state(
    steps: DataFrame, quota: int = K.MAX_ROLLBACKS, depth: int = K.UNDO_DEPTH
) -> DataFrame:
    """Per session: number of applies, rollbacks that worked, and the current version.

    Version 0 is the input and version n the table after the n-th apply. A rollback returns
    to the version before the newest apply still on the undo stack (``depth`` entries); only
    ``quota`` rollbacks per session work. The first rollback after an apply always finds that
    apply on the stack, so within ``quota`` such groups, and within the first ``quota``
    rollbacks of each, lie all rollbacks that work: a bounded list per session.
    """
    undo = F.col("action") == "rollback"
    numbered = scan(
        steps,
        SESSION,
        ORDER,
        step_chunk(),
        _applied=count(F.col("action") == "apply"),
    )
    rollbacks = numbered.filter(undo & (F.col("_applied") > 0)).select("session_id", "step", "_applied")
    # First rollbacks after each apply, then the first such groups of each session.
    group = ["session_id", "_applied"]
    few = top_rows(rollbacks, group, [F.col("step")], quota, step_chunk())
    heads = few.groupBy(*group).agg(F.min("step").alias("_first"))
    groups = top_rows(heads, SESSION, [F.col("_first")], quota, step_chunk("_first")).drop("_first")
    lists = (
        few.join(groups, group)
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("step", "_applied"))).alias("_undo"))
    )
    totals = steps.groupBy(*SESSION).agg(
        F.count_if(F.col("action") == "apply").alias("n_applies"),
        F.count_if(undo).alias("n_rollbacks"),
    )
    folded = totals.join(lists, SESSION, "left").withColumn(
        "_end", _fold_rollbacks("_undo", quota, depth)
    )
    done = F.col("_end.done")
    last = F.element_at(done, -1)
    current = F.when(
        (F.size(done) > 0) & (last["applied"] == F.col("n_applies")), last["restored"]
    ).otherwise(F.col("n_applies"))
    return folded.select(
        "session_id",
        "n_applies",
        F.size(done).cast("bigint").alias("n_restored"),
        (F.col("n_rollbacks") - F.size(done)).alias("n_refused"),
        current.alias("current_version"),
        F.greatest(F.lit(0), F.lit(quota) - F.size(done)).alias("rollbacks_left"),
    )


def _fold_rollbacks(column: str, quota: int, depth: int) -> Column:
    """Replay a short list of rollbacks: stack of applies, and what each rollback restored."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array().cast("array<bigint>").alias("stack"),
        zero.alias("seen"),
        F.array().cast("array<struct<applied:bigint,restored:bigint>>").alias("done"),
    )

    def step(state: Column, undo: Column) -> Column:
        applied = undo["_applied"]
        low = F.greatest(state["seen"] + 1, applied - (depth - 1))
        fresh = F.when(low <= applied, F.sequence(low, applied)).otherwise(
            F.array().cast("array<bigint>")
        )
        pushed = F.concat(state["stack"], fresh)
        stack = F.slice(pushed, F.greatest(F.lit(1), F.size(pushed) - depth + 1), F.lit(depth))
        works = (F.size(state["done"]) < quota) & (F.size(stack) > 0)
        popped = F.element_at(stack, -1)
        # The version before an apply: what an earlier rollback left there, else the one below.
        earlier = F.filter(state["done"], lambda d: d["applied"] == popped - 1)
        restored = F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["restored"]).otherwise(
            popped - 1
        )
        entry = F.struct(applied.alias("applied"), restored.alias("restored"))
        return F.when(
            works,
            F.struct(
                F.slice(stack, F.lit(1), F.size(stack) - 1).alias("stack"),
                applied.alias("seen"),
                F.concat(state["done"], F.array(entry)).alias("done"),
            ),
        ).otherwise(F.struct(stack.alias("stack"), applied.alias("seen"), state["done"].alias("done")))

    empty = F.array().cast("array<struct<step:bigint,_applied:bigint>>")
    return F.aggregate(F.coalesce(F.col(column), empty), start, step)


# Session summaries.


def episode_summary(scored: DataFrame) -> DataFrame:
    """Per session: steps, history length, mean and total reward, best and last accuracy, success.

    Only steps that took place count; a session starts with the accuracy its first step found.

    Rewards have four places, so they are summed as whole ten-thousandths: the result does
    not depend on the order of the rows.
    """
    kept, there = F.col("in_history"), F.col("outcome").isin(*EFFECTIVE)
    units = F.sum(F.when(kept, F.rint(F.col("reward") * 10_000).cast("bigint")))
    reached = executed(F.col("action") == "apply") & (F.col("accuracy_after") >= F.col("target_accuracy"))
    start = F.min_by("accuracy_before", "step")
    accuracy = F.when(changed(), F.col("accuracy_after"))
    return scored.groupBy(*SESSION).agg(
        F.count_if(there).alias("n_steps"),
        F.count_if(kept).alias("n_rewards"),
        F.coalesce(F.rint(F.try_divide(units, F.count_if(kept))) / 10_000, F.lit(0.0)).alias(
            "mean_reward"
        ),
        F.coalesce(units / 10_000, F.lit(0.0)).alias("total_reward"),
        S.round_even(F.greatest(F.max(accuracy), start), 4).alias("best_accuracy"),
        S.round_even(F.coalesce(F.max_by("accuracy_after", F.when(changed(), F.col("step"))), start), 4).alias(
            "last_accuracy"
        ),
        F.count_if(F.col("outcome") == "undone").alias("n_rollbacks"),
        F.max(reached).alias("success"),
    )


def overall_summary(episodes: DataFrame) -> DataFrame:
    """Mean episode reward and success rate over all sessions."""
    return episodes.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        S.round_even(F.avg("mean_reward"), 6).alias("mean_reward"),
        S.round_even(F.avg("total_reward"), 6).alias("mean_total_reward"),
        S.round_even(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
    )


def trajectories(scored: DataFrame, part_rows: int = 1_000) -> DataFrame:
    """Step lists per session in parts of at most ``part_rows`` steps, ready to export."""
    steps = F.struct("step", "action", "rec_id", "accuracy_after", "reward")
    return (
        effective(scored).withColumn("part", step_chunk(rows=part_rows))
        .groupBy("session_id", "part")
        .agg(F.array_sort(F.collect_list(steps)).alias("steps"))
        .select(
            "session_id",
            "part",
            F.size("steps").alias("n_steps"),
            F.transform("steps", lambda s: S.round_even(s["accuracy_after"], 4)).alias("accuracy_history"),
            F.transform("steps", lambda s: s["reward"]).alias("reward_history"),
            F.transform("steps", lambda s: s["action"]).alias("actions"),
        )
    )


def session_spans(steps: DataFrame) -> DataFrame:
    """First and last time and number of steps of every session."""
    return steps.groupBy(*SESSION).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_steps")
    )


def session_metrics(steps: DataFrame, now: Column, ttl_seconds: int = K.SESSION_TTL_SECONDS) -> DataFrame:
    """Active and total sessions and the mean steps of active ones; age counts from creation."""
    active = ~S.is_expired(F.col("created_at"), now, ttl_seconds)
    return session_spans(steps).agg(
        F.count_if(active).alias("active_sessions"),
        F.count(F.lit(1)).alias("total_sessions"),
        S.round_even(F.coalesce(F.avg(F.when(active, F.col("n_steps"))), F.lit(0.0)), 2).alias(
            "avg_steps_active"
        ),
    )


def reward_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the smallest to the largest reward."""
    scored = scored.filter(F.col("reward").isNotNull())
    span = scored.agg(F.min("reward").alias("lo"), F.max("reward").alias("hi")).first()
    if span["lo"] is None:
        return scored.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (span["hi"] - span["lo"]) or 1.0
    at = F.floor((F.col("reward") - F.lit(span["lo"])) / F.lit(width) * bins)
    return scored.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def tool_distribution(responses: DataFrame) -> DataFrame:
    """Share of each agent named by the responses (column ``agent``)."""
    return responses.groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


def generation_report(responses: DataFrame) -> DataFrame:
    """Per period: responses, valid share, mean reward, number of agents, single-tool warning.

    ``responses`` has ``period``, ``agent`` and ``reward``; rewards have at most four places
    and are summed as whole ten-thousandths.
    """
    units = F.sum(F.rint(F.col("reward") * 10_000).cast("bigint"))
    valid = F.col("agent").isin(K.AGENTS).cast("double")
    return responses.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_responses"),
        S.round_even(F.avg(valid), 6).alias("valid_rate"),
        S.round_even(units / F.count("reward") / 10_000, 6).alias("mean_reward"),
        F.count_distinct("agent").alias("n_tools"),
        (F.count_distinct("agent") == 1).alias("single_tool"),
    )


def before_after(report: DataFrame, before: str, after: str) -> DataFrame:
    """Two periods of a generation report side by side."""
    fields = ["valid_rate", "mean_reward", "n_tools"]

    def side(period: str, suffix: str) -> DataFrame:
        return report.filter(F.col("period") == period).select(
            F.lit(1).alias("_one"), *[F.col(c).alias(f"{c}_{suffix}") for c in fields]
        )

    joined = side(before, "before").join(side(after, "after"), "_one").drop("_one")
    return joined.withColumn("reward_improved", F.col("mean_reward_after") > F.col("mean_reward_before"))
