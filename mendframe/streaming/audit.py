"""Live rule audit: the fold of a session, fed step by step, with bounded state per session.

Steps are numbered 1, 2, ... per session, so their order does not depend on micro-batches. A step that
comes before its number waits, and no longer than the event-time watermark needs to reach it: by then no
earlier step can come any more, so a gap in the numbers delays steps but holds none back. A session
that has ended keeps no ids and lets nothing wait, and it ends within its budget; so the state of a
session is bounded by its budget and by what can arrive within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mendframe import constants as K
from mendframe.streaming.session_fold import Session

OUTPUT = (
    "session_id bigint, step bigint, action string, rec_id string, outcome string,"
    " budget_before bigint, streak bigint, rule string"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
WAITING = "array<struct<step bigint, action string, rec_id string, issued array<string>, reached boolean, due bigint>>"
NOW = (
    "budget bigint, done boolean, last string, run bigint, stack bigint, undone bigint, following bigint,"
    f" issued array<string>, applied array<string>, waiting {WAITING}"
)


class Audit(StatefulProcessor):
    """State: where the session stands, the ids it has handed out and used, and the steps that wait.

    All of it is one value: every call to the store is a message from Python to the executor.
    """

    def __init__(self, budget: int, streak: int):
        self.budget, self.streak = budget, streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for piece in rows:
            columns = (piece[c].tolist() for c in ("step", "action", "rec_id", "issued", "reached", "due"))
            for step, action, rec, issued, reached, due in zip(*columns, strict=True):
                fresh.append((step, action, rec if isinstance(rec, str) else None, [] if issued is None else list(issued), reached, due))
        yield from self._fold(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, [], timerValues)

    def _fold(self, key, fresh: list[tuple], timers) -> Iterator[pd.DataFrame]:
        session, following, held = self._loaded()
        waiting = sorted([*held, *fresh], key=lambda w: w[0])
        watermark = timers.getCurrentWatermarkInMs()
        # Every step up to the last one that the watermark has reached: nothing before it can come now.
        sure = max((w[0] for w in waiting if w[5] <= watermark), default=0)
        out, rest = [], []
        for w in waiting:
            at, action, rec, ids, reached, _ = w
            if at <= following or at <= sure or session.done:
                outcome, rule, _, before, _, run, _ = session.step(action, rec, ids, reached)
                out.append((key[0], at, action, rec, outcome, before, run, rule))
                following = max(following, at + 1)
            else:
                rest.append(w)
        if out or fresh:
            self._store(session, following, rest)
        if rest:
            self.handle.registerTimer(min(w[5] for w in rest))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _loaded(self) -> tuple[Session, int, list[tuple]]:
        session, known = Session(self.budget, self.streak), self.now.get()
        if known is None:
            return session, 1, []
        session.budget, session.done, session.last, session.run, session.stack, session.undone, following, issued, applied, held = known
        session.issued, session.applied = set(issued), set(applied)
        return session, following, [tuple(w) for w in held]

    def _store(self, session: Session, following: int, waiting: list[tuple]) -> None:
        ids = ([], []) if session.done else (sorted(session.issued), sorted(session.applied))
        self.now.update((session.budget, session.done, session.last, session.run, session.stack, session.undone, following, *ids, waiting))

    def close(self) -> None:
        pass


def stream_audit(steps: DataFrame, budget: int = K.BUDGET, streak: int = K.STREAK, delay: str = "1 hour") -> DataFrame:
    """Outcome and broken rule of every step as it arrives.

    ``steps`` has ``session_id, step, ts, action, rec_id, accuracy_after, target_accuracy`` and the list
    ``issued`` of recommendation ids a query step hands out. A step without ``ts`` waits for nothing.
    Steps more than ``delay`` behind the latest are dropped by the watermark. A number that has been
    passed over and comes within the delay is judged when it comes. Steps still waiting when the input
    ends appear with the next one that moves the watermark.
    """
    reached = F.coalesce(F.col("accuracy_after") >= F.col("target_accuracy"), F.lit(False))
    timed = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    due = F.coalesce(F.unix_millis("ts"), F.lit(0))
    return (
        timed.select("session_id", "step", "ts", "action", "rec_id", "issued", reached.alias("reached"), due.alias("due"))
        .groupBy("session_id")
        .transformWithStateInPandas(Audit(budget, streak), OUTPUT, "append", "eventTime")
    )
