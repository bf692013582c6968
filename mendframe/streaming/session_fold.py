"""One session, step by step: what the stream keeps of it between steps."""

from __future__ import annotations

from collections.abc import Iterable

from mendframe import constants as K


class Session:
    """Budget, history, recommendations and undo stack of one session."""

    def __init__(self, budget: int, streak: int):
        self.budget, self.limit, self.done = budget, streak, False
        self.last: str | None = None
        self.run = self.stack = self.undone = 0
        self.issued: set[str] = set()
        self.applied: set[str] = set()

    def step(self, action: str, rec_id: str | None, issues: Iterable[str], reached: bool) -> tuple:
        """Outcome, rule, charge, budget before and after, length of the run, and whether it ends the session."""
        before = self.budget
        if self.done:
            return "after_end", None, 0, before, before, 0, False
        if action == "rollback":
            if self.undone >= K.MAX_ROLLBACKS or not self.stack:
                return "refused", None, 0, before, before, 0, False
            self.undone += 1
            self.stack -= 1
            return "undone", None, *self._pay(1, before), 0, self.done
        rule = self._rule(action, rec_id)
        if rule:
            return "blocked", rule, *self._pay(1, before), self.run, self.done
        if action != "apply":
            self.issued.update(issues)
            return "executed", None, *self._pay(K.QUERY_COSTS[action], before), self.run, self.done
        self.applied.add(rec_id)
        self.stack = min(K.UNDO_DEPTH, self.stack + 1)
        self.done = bool(reached) or self.budget <= 0
        return "executed", None, 0, before, before, self.run, self.done

    def _pay(self, cost: int, before: int) -> tuple[int, int, int]:
        self.budget = max(0, before - cost)
        self.done = self.budget <= 0
        return cost, before, self.budget

    def _rule(self, action: str, rec_id: str | None) -> str | None:
        if self.budget <= 0:
            return "budget_exhausted"
        self.run = self.run + 1 if action == self.last else 1
        self.last = action
        if self.run >= self.limit and action != "apply":
            return "action_spam"
        if action in K.EXPENSIVE_ACTIONS and self.budget < K.EXPENSIVE_MIN_BUDGET:
            return "low_budget_expensive_query"
        if action == "apply":
            if not rec_id:
                return "missing_rec_id"
            if rec_id in self.applied:
                return "duplicate_apply"
            if rec_id not in self.issued:
                return "invalid_rec_id"
        return None
