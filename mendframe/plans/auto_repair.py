"""Diagnose, repair, re-evaluate, undo what hurts: a bounded sequence of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.operators import diagnose, steps
from mendframe.operators.evaluate import evaluate
from mendframe.operators.profile import label_summary
from mendframe.operators.profile_state import missing_share
from mendframe.operators.registry import Context, Registry, standard
from mendframe.sources.versions import Versions

TRACE_SCHEMA = """session_id string, step int, action string, rec_id string, rec_type string,
    cost int, n_recs int, accuracy_before double, accuracy_after double,
    missing_before double, missing_after double, balance_before double, balance_after double,
    rows_before bigint, rows_after bigint, target_accuracy double, budget_remaining bigint,
    outcome string"""


def auto_repair(
    train: DataFrame,
    holdout: DataFrame,
    meta: dict,
    target: float,
    budget: int = K.BUDGET,
    session_id: str = "session",
    cap: int | None = None,
    label: str = K.LABEL,
    registry: Registry | None = None,
    score: Callable[[DataFrame, DataFrame], float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ask the analyst, follow its plan, then ask what the table still needs, until the target is met
    or the budget is spent.

    ``registry`` holds the diagnoses and repairs at hand (the standard ones by default); ``score`` rates a
    training table on the holdout (the accuracy of the fixed model by default).
    Returns the repaired table and the scored trace. The number of steps is bounded by the
    budget and by the recommendations of each query; every accepted repair is written as a version.
    """
    spark = train.sparkSession
    store = Versions.start(train, label=label)
    current = store.read()
    pending: dict[str, dict] = {}
    asked: set[str] = set()
    planned: list[str] = []
    log: list[tuple] = []

    def quality(balance: float | None = None) -> tuple[dict, int]:
        """Missing share and balance of the current version, from its profile; classes are counted only if rows changed."""
        told = missing_share(store.profile()).first()
        if balance is None:
            balance = label_summary(current, label).first()["balance_ratio"] if told["n_rows"] else 0.0
        return {"missing_pct": told["missing_pct"], "balance_ratio": balance}, told["n_rows"]

    score = score or (lambda train, holdout: evaluate(train, holdout, label).accuracy)
    accuracy = score(current, holdout)
    facts, rows = quality()

    def note(action, rec, cost, n_recs, before, now, outcome):
        log.append(
            (
                session_id, len(log) + 1, action, rec.get("rec_id"), rec.get("type"), cost, n_recs,
                before[0], now[0], before[1], now[1], before[2], now[2], before[3], now[3],
                target, budget, outcome,
            )
        )

    def state():
        return (accuracy, facts["missing_pct"], facts["balance_ratio"], rows)

    registry = registry or standard()
    context = Context(meta, session_id, label, 1, cap)
    while budget > 0 and accuracy < target:
        before = state()
        if not asked:
            action = "query_analyst"
        elif pending:
            action = "apply"
        elif open_ := [a for a in planned if a not in asked]:
            action = open_[0]
        elif facts["missing_pct"] > K.PLAN_MISSING_SHARE and "query_cleaner" not in asked:
            action = "query_cleaner"
        elif facts["balance_ratio"] < K.BALANCED_RATIO and "query_balancer" not in asked:
            action = "query_balancer"
        elif "query_augmenter" not in asked:
            action = "query_augmenter"
        else:
            break
        if action != "apply":
            cost = K.QUERY_COSTS[action] if action == "query_analyst" else registry.cost(action)
            # One recommendation per column or class at most.
            if action == "query_analyst":
                plan = diagnose.analyst_report(current, meta, label).first()["action_plan"]
                planned, found = [step["action"] for step in plan], []
            else:
                found = [r.asDict() for r in registry.diagnose(current, action, context).collect()]
            pending.update({r["rec_id"]: r for r in found})
            asked.add(action)
            budget = max(0, budget - cost)
            note(action, {}, cost, len(found), before, before, "asked")
            continue
        rec = pending.pop(min(pending, key=lambda r: (pending[r]["priority"], r)))
        repaired, accepted = registry.guarded(current, rec, context)
        if not accepted:
            note("apply", rec, 0, 0, before, before, "rejected: deletes too many rows")
            continue
        changed = registry.changed(rec)
        current = store.commit(repaired, changed)
        accuracy = score(current, holdout)
        facts, rows = quality(facts["balance_ratio"] if changed is not None else None)
        note("apply", rec, 0, 0, before, state(), "applied")
        if accuracy < before[0] - K.EFFECT_BAND and budget > 0 and store.rollback():
            hurt = state()
            current = store.read()
            accuracy, rows = before[0], before[3]
            facts = {"missing_pct": before[1], "balance_ratio": before[2]}
            budget = max(0, budget - 1)
            note("rollback", {}, 1, 0, hurt, before, "undone")
    trace = spark.createDataFrame(log, TRACE_SCHEMA)
    told = F.when(F.col("action") == "rollback", "undone").when(
        F.col("note").startswith("rejected"), "refused"
    )
    # The scores read what a step did; the trace keeps its own words for it.
    named = trace.withColumnRenamed("outcome", "note").withColumn("outcome", F.coalesce(told, F.lit("executed")))
    scored = steps.score_steps(named)
    return current, scored.drop("outcome").withColumnRenamed("note", "outcome")
