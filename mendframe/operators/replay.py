"""What every step of a session did: executed, blocked, refused or after the end.

Cost, rule and budget depend on each other in order. Only a bounded head of a session can matter,
however long its log is: a step that is not refused takes budget, except an apply that uses up a
recommendation of its own, and of a row of rollbacks at most ``MAX_ROLLBACKS`` can work. So the head
of every session is folded as one short list by column expressions; its results are rows again, and every
step of the log finds the one that tells of it by an equi-join: its own, or for the steps behind the head
and the rollbacks left out of it, the last one before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.operators.scan import Running, count, scan, step_chunk

#: What the fold tells of a step.
FIELDS = {
    "outcome": "string",
    "rule": "string",
    "charged": "bigint",
    "budget_before": "bigint",
    "budget_remaining": "bigint",
    "streak": "bigint",
    "ends_session": "boolean",
}
_TOLD = "struct<place:bigint,kind:bigint," + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"
#: Outcomes of steps that took place.
EFFECTIVE = ("executed", "blocked", "undone")


def _with(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of values that are computed once."""
    named = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.element_at(F.transform(named, body), 1)


def _broken_rule(s: Column, x: Column, run: Column, streak: int) -> Column:
    """The rule that a step breaks in state ``s``, null if none."""
    action, apply = x["action"], x["action"] == "apply"
    rec_id = F.coalesce(x["rec_id"], F.lit(""))
    return (
        F.when(s["budget"] <= 0, "budget_exhausted")
        .when((run >= streak) & ~apply, "action_spam")
        .when(action.isin(*K.EXPENSIVE_ACTIONS) & (s["budget"] < K.EXPENSIVE_MIN_BUDGET), "low_budget_expensive_query")
        .when(apply & (rec_id == ""), "missing_rec_id")
        .when(apply & F.array_contains(s["applied"], rec_id), "duplicate_apply")
        .when(apply & ~F.array_contains(s["issued"], rec_id), "invalid_rec_id")
    )


def _cost(action: Column) -> Column:
    """What an executed step takes: queries by agent, anything else nothing."""
    price = F.lit(0)
    for name, cost in K.QUERY_COSTS.items():
        price = F.when(action == name, cost).otherwise(price)
    return price


def _step(s: Column, x: Column, streak: int) -> Column:
    """The state of a session after the step ``x`` in state ``s``; what it tells is appended to ``told``."""
    undo, apply = x["action"] == "rollback", x["action"] == "apply"
    run = F.when(x["action"].eqNullSafe(s["last"]), s["run"] + 1).otherwise(1)
    rule = F.when(~undo & ~s["done"], _broken_rule(s, x, run, streak))
    def judged(t: Column) -> Column:
        known = F.when(s["done"], "after_end").when(
            undo, F.when((s["undone"] < K.MAX_ROLLBACKS) & (s["stack"] > 0), "undone").otherwise("refused")
        )
        return _with(
            {"run": t["run"], "rule": t["rule"], "outcome": known.when(t["rule"].isNotNull(), "blocked").otherwise("executed")},
            lambda t: charged(t),
        )

    def charged(t: Column) -> Column:
        cost = F.when(t["outcome"].isin("undone", "blocked"), 1).when(t["outcome"] == "executed", _cost(x["action"])).otherwise(0)
        return _with(
            {"run": t["run"], "rule": t["rule"], "outcome": t["outcome"], "cost": cost, "left": F.greatest(F.lit(0).cast("bigint"), s["budget"] - cost)},
            lambda t: moved(t),
        )

    def moved(t: Column) -> Column:
        counts = ~undo & ~s["done"] & ~t["rule"].eqNullSafe("budget_exhausted")
        works = (t["outcome"] == "executed") & apply
        asks = (t["outcome"] == "executed") & ~apply
        ends = t["outcome"].isin(*EFFECTIVE) & ((t["left"] <= 0) | (works & x["reached"]))
        run = F.when(counts, t["run"]).otherwise(s["run"])
        told = F.struct(
            x["place"], x["kind"], t["outcome"], t["rule"], t["cost"].cast("bigint"), s["budget"], t["left"],
            F.when(undo | s["done"], 0).otherwise(run), ends,
        )
        return F.struct(
            t["left"].alias("budget"),
            (s["done"] | ends).alias("done"),
            F.when(counts, x["action"]).otherwise(s["last"]).alias("last"),
            run.alias("run"),
            F.when(works, F.least(F.lit(K.UNDO_DEPTH), s["stack"] + 1)).when(t["outcome"] == "undone", s["stack"] - 1).otherwise(s["stack"]).alias("stack"),
            F.when(t["outcome"] == "undone", s["undone"] + 1).otherwise(s["undone"]).alias("undone"),
            F.when(asks, F.array_union(s["issued"], x["ids"])).otherwise(s["issued"]).alias("issued"),
            F.when(works, F.array_append(s["applied"], x["rec_id"])).otherwise(s["applied"]).alias("applied"),
            F.concat(s["told"], F.array(told.cast(_TOLD))).alias("told"),
        )

    return _with({"run": run.cast("bigint"), "rule": rule}, judged)


def _folded(steps: Column, budget: int, streak: int) -> Column:
    """What the steps of a session did. Those after its end change nothing and are told of at once."""
    start = F.struct(
        F.lit(budget).cast("bigint").alias("budget"),
        F.lit(False).alias("done"),
        F.lit(None).cast("string").alias("last"),
        F.lit(0).cast("bigint").alias("run"),
        F.lit(0).alias("stack"),
        F.lit(0).alias("undone"),
        F.array().cast("array<string>").alias("issued"),
        F.array().cast("array<string>").alias("applied"),
        F.array().cast(f"array<{_TOLD}>").alias("told"),
    )
    zero = F.lit(0).cast("bigint")

    def late(s: Column, x: Column) -> Column:
        no_rule = F.lit(None).cast("string")
        return F.struct(x["place"], x["kind"], F.lit("after_end"), no_rule, zero, s["budget"], s["budget"], zero, F.lit(False)).cast(_TOLD)

    def finished(s: Column) -> Column:
        n = F.size(s["told"])
        return F.concat(s["told"], F.transform(F.slice(steps, n + 1, F.size(steps) - n), lambda x: late(s, x)))

    return F.aggregate(steps, start, lambda s, x: F.when(s["done"], s).otherwise(_step(s, x, streak)), finished)


def replay(steps: DataFrame, recs: DataFrame, budget: int = K.BUDGET, streak: int = K.STREAK) -> DataFrame:
    """Adds ``outcome, rule, charged, budget_before, budget_remaining, streak, ends_session`` to every step.

    A step is ``executed``, ``blocked`` by a rule (which costs 1 and hands nothing out), ``undone`` (a
    rollback that works), ``refused`` (one that does not; it costs nothing) or ``after_end``. A
    recommendation counts as issued only by an executed query and as applied only by an executed apply.
    """
    undo = F.col("action") == "rollback"
    most = recs.groupBy("session_id", "step").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    head = (most.scalar() + 1) * budget
    numbered = scan(
        steps, ["session_id"], ["step"], step_chunk(), _place=count(~undo), _kind=Running("run", undo)
    )
    # Place n is the n-th step that is no rollback, kind 0, and the rollbacks behind it are of kinds 1, 2, ...
    inside = F.col("_place") <= head
    kind = F.when(undo & inside, F.least("_kind", F.lit(K.MAX_ROLLBACKS))).otherwise(0).cast("bigint")
    kept = numbered.where(inside & (~undo | (F.col("_kind") <= K.MAX_ROLLBACKS)))
    handed = recs.groupBy("session_id", "step").agg(F.collect_set("rec_id").alias("ids"))
    reached = F.coalesce(F.col("accuracy_after") >= F.col("target_accuracy"), F.lit(False))
    ids = F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    number = F.when(undo, F.col("_kind")).otherwise(0).cast("bigint")
    row = F.struct("step", "action", "rec_id", ids, reached.alias("reached"), F.col("_place").alias("place"), number.alias("kind"))
    heads = kept.join(handed, ["session_id", "step"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    told = heads.select("session_id", F.inline(_folded(F.col("steps"), budget, streak)))
    told = told.select("session_id", F.col("place").alias("_place"), F.col("kind").alias("_kind"), F.struct(*FIELDS).alias("_told"))
    known = F.col("_told")
    over = known["ends_session"] | (known["outcome"] == "after_end")
    rest = {
        "outcome": F.when(over, "after_end").otherwise("refused"),
        "rule": F.lit(None).cast("string"),
        "charged": F.lit(0).cast("bigint"),
        "budget_before": known["budget_remaining"],
        "budget_remaining": known["budget_remaining"],
        "streak": F.lit(0).cast("bigint"),
        "ends_session": F.lit(False),
    }
    placed = numbered.withColumns({"_own": F.col("_kind"), "_kind": kind, "_inside": inside, "_place": F.least("_place", head).cast("bigint")})
    # A step of the head is told of itself; one behind it or left out of it, of the last step before.
    itself = F.col("_inside") & (~undo | (F.col("_own") <= K.MAX_ROLLBACKS))
    return placed.join(told, ["session_id", "_place", "_kind"], "left").select(
        *[F.col(c) for c in steps.columns], *[F.when(itself, known[n]).otherwise(rest[n]).cast(t).alias(n) for n, t in FIELDS.items()]
    )
