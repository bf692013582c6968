"""Exports of step logs: prompts, training samples, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.constants import REWARD_FLOOR

SYSTEM_TEXT = "You improve a labelled table step by step. Answer with one JSON object."
REASON_LENGTH = 120
ISSUES_SHOWN = 2
TRACE_SHOWN = 3
FEATURES_SHOWN = 2


def compact_reason(reason: Column | str) -> Column:
    return F.substring(reason, 1, REASON_LENGTH)


def first_issues(issues: Column | str) -> Column:
    return F.slice(issues, 1, ISSUES_SHOWN)


def prompt_state(seen: DataFrame) -> DataFrame:
    """Of every observation what a prompt shows: short lists, and no more of a reason than fits."""
    pending = F.transform_values(
        F.coalesce("pending_recommendations", F.from_json(F.lit("{}"), seen.schema["pending_recommendations"].dataType)),
        lambda _, told: F.struct(told["agent"].alias("agent"), told["type"].alias("type"), compact_reason(told["reason"]).alias("reason"), told["domain_informed"].alias("domain_informed")),
    )
    latest = F.slice("episode_trace", -F.least(F.size("episode_trace"), F.lit(TRACE_SHOWN)), TRACE_SHOWN)
    return seen.select(
        "session_id",
        "difficulty",
        F.col("dataset.name").alias("dataset"),
        "dataset.domain",
        first_issues("dataset.known_issues").alias("known_issues"),
        *["current_accuracy", "target_accuracy", "accuracy_gap", "benchmarks", "budget_remaining", "dataset_stats"],
        pending.alias("pending_recommendations"),
        latest.alias("episode_trace"),
        F.slice("feature_importance.top_positive", 1, FEATURES_SHOWN).alias("feature_importance"),
        "available_actions",
    )


def prompt_text(state: Column) -> Column:
    """System text and state as one prompt."""
    return F.concat(
        F.lit(f"<|system|>\n{SYSTEM_TEXT}\n<|user|>\nCurrent environment state:\n"),
        F.to_json(state, {"ignoreNullFields": "false"}),
        F.lit("\n<|assistant|>\n"),
    )


def action_json(action: Column | str = "action", rec_id: Column | str = "rec_id") -> Column:
    """The answer a step stands for; ``rec_id`` is left out where there is none."""
    return F.to_json(
        F.struct(
            (F.col(action) if isinstance(action, str) else action).alias("action"),
            (F.col(rec_id) if isinstance(rec_id, str) else rec_id).alias("rec_id"),
        )
    )


def training_samples(rows: DataFrame, floor: float = REWARD_FLOOR) -> DataFrame:
    """Prompt, completion and reward of the samples above the floor."""
    return rows.filter(F.col("reward") > floor).select("prompt", "completion", "reward")


def prompt_dataset(rows: DataFrame, state_columns: list[str]) -> DataFrame:
    """Prompt, difficulty and the state as JSON."""
    state = F.struct(*state_columns)
    return rows.select(
        prompt_text(state).alias("prompt"), "difficulty", F.to_json(state, {"ignoreNullFields": "false"}).alias("initial_obs")
    )
