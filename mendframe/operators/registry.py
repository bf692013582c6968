"""Diagnoses and repairs by name: what a repair sequence may ask and do.

A diagnosis is ``diagnose(df, context) -> recommendations`` and a repair ``repair(df, recommendation,
context) -> df``. Both are registered under a name, a repair under the type of recommendation that it
carries out. Recommendations are checked against the fields of ``diagnose.RECOMMENDATION``, so own
diagnoses run through the same dispatch, guard and report as the standard ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.operators import diagnose, repair

#: Fields that every recommendation has.
NEEDED = ("rec_id", "type", "priority")


@dataclass(frozen=True)
class Context:
    """What diagnoses and repairs know besides the table."""

    meta: dict | None = None
    session_id: str = "dataset"
    label: str = K.LABEL
    target_class: int | None = None
    cap: int | None = None


Diagnose = Callable[[DataFrame, Context], DataFrame]
Repair = Callable[[DataFrame, dict, Context], DataFrame]


@dataclass
class Registry:
    diagnoses: dict[str, tuple[Diagnose, int]] = field(default_factory=dict)
    repairs: dict[str, Repair] = field(default_factory=dict)
    changes: dict[str, Callable[[dict], list[str] | None]] = field(default_factory=dict)

    def diagnosis(self, name: str, cost: int = 1) -> Callable[[Diagnose], Diagnose]:
        """Registers a diagnosis and what asking it takes from the budget."""
        return lambda fn: self.diagnoses.__setitem__(name, (fn, cost)) or fn

    def repair(self, kind: str, changes: Callable[[dict], list[str] | None] | None = None) -> Callable[[Repair], Repair]:
        """Registers the repair of a type of recommendation.

        ``changes`` tells the columns that it changes where all rows stay; without it, or where it
        says None, any column may change.
        """
        if changes:
            self.changes[kind] = changes
        return lambda fn: self.repairs.__setitem__(kind, fn) or fn

    def changed(self, rec: dict) -> list[str] | None:
        told = self.changes.get(rec["type"])
        return told(rec) if told else None

    def cost(self, name: str) -> int:
        return self.diagnoses[name][1]

    def diagnose(self, df: DataFrame, name: str, context: Context) -> DataFrame:
        """The recommendations of a diagnosis with all fields; those it does not use are null."""
        if name not in self.diagnoses:
            raise ValueError(f"no diagnosis is called {name}")
        found = self.diagnoses[name][0](df, context)
        kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
        missing = [n for n in NEEDED if n not in kinds]
        wrong = [n for n, t in diagnose.RECOMMENDATION.items() if n in kinds and kinds[n] != t]
        if missing or wrong:
            raise ValueError(f"{name} returns recommendations without {missing}, or of other types in {wrong}")
        return found.select(
            *[(F.col(n) if n in kinds else F.lit(None)).cast(t).alias(n) for n, t in diagnose.RECOMMENDATION.items()],
            *[n for n in kinds if n not in diagnose.RECOMMENDATION],
        )

    def apply(self, df: DataFrame, rec: dict, context: Context = Context()) -> DataFrame:
        """Carries a recommendation out; unknown types leave the table as it is."""
        fn = self.repairs.get(rec["type"])
        return fn(df, rec, context) if fn else df

    def guarded(self, df: DataFrame, rec: dict, context: Context = Context(), limit: float = K.DELETION_LIMIT) -> tuple[DataFrame, bool]:
        """The repaired table, or the old one where too many rows would go."""
        return repair.guarded(df, rec, limit, lambda d, r: self.apply(d, r, context))

    def report(self, df: DataFrame, rec: dict, context: Context = Context()) -> DataFrame:
        """What a repair does: message, rows and missing cells before and after."""
        return repair.repair_report(df, rec, context.label, lambda d, r: self.apply(d, r, context))


def standard() -> Registry:
    """The diagnoses and repairs of the library."""
    known = Registry()
    costs = K.QUERY_COSTS
    known.diagnoses = {
        "query_cleaner": (lambda df, c: diagnose.cleaner_recommendations(df, c.meta, c.session_id), costs["query_cleaner"]),
        "query_balancer": (lambda df, c: diagnose.balancer_recommendations(df, c.session_id, c.label), costs["query_balancer"]),
        "query_augmenter": (
            lambda df, c: diagnose.augmenter_recommendation(df, c.target_class, c.session_id, c.cap, c.label),
            costs["query_augmenter"],
        ),
        "query_validator": (lambda df, c: diagnose.validator_recommendations(df, c.meta, c.session_id), costs["query_validator"]),
    }
    own = lambda rec: [rec["column"]] if rec.get("column") not in (None, repair.ALL) else None
    known.changes = {kind: own for kind in ("zero_to_nan_impute", "log_transform", "drop_redundant", "clip_outliers")}
    known.changes["impute"] = lambda rec: None if rec["strategy"] == "drop_rows" else own(rec)
    known.repairs = {kind: lambda df, rec, _, fn=fn: fn(df, rec) for kind, fn in repair.REPAIRS.items()}
    return known
