"""Live session metrics: sessions expire a fixed time after they start, and leave the state then.

The state holds open sessions only: when the watermark passes a session's end, its last snapshot goes
out and nothing of it stays. The snapshots are the table of expired sessions; a step that comes
later opens a state of its own under the same id, and ``session_totals`` joins it to the first
one, so that it counts as rejected and starts nothing anew.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mendframe.constants import SESSION_TTL_SECONDS

OUTPUT = "session_id bigint, created_at double, last_seen double, n_steps bigint, n_rejected bigint, status string, opened bigint"
SNAPSHOT = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


class Sessions(StatefulProcessor):
    """Four numbers of an open session, and the times of steps seen while an earlier one may still come.

    All of it is one value, and one timer is set at a time: every call to the store is a message from
    Python to the executor, and with many short sessions these messages are the work.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "created double, seen double, n bigint, rejected bigint, opened bigint, early array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = [r.at for r in rows]
        known = self.now.get()
        created, seen, n, rejected, opened, early = known or (min(times), min(times), 0, 0, int(min(times) * 1e6), [])
        times += early
        if n + rejected == 0:
            created = min([created, *times])
        seen = max([seen, *times])
        end = created + self.ttl
        in_time = sum(t <= end for t in times)
        total = n + in_time, rejected + len(times) - in_time
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        if watermark >= end:  # all of it late, yet within the delay
            if known:
                self.now.clear()
            yield SNAPSHOT(key[0], created, seen, *total, "expired", opened)
            return
        if watermark >= created:
            self.now.update((created, seen, *total, opened, []))
            self._wake(end)
        else:
            # An earlier step may move the start: these are judged when the watermark has passed it.
            self.now.update((created, seen, n, rejected, opened, times))
            self._wake(created)
        yield SNAPSHOT(key[0], created, seen, *total, "active", opened)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.now.get()
        if not known:
            return
        created, seen, n, rejected, opened, early = known
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        end = created + self.ttl
        if watermark >= created:
            in_time = sum(t <= end for t in early)
            n, rejected = n + in_time, rejected + len(early) - in_time
        if watermark >= end:
            self.now.clear()
            yield SNAPSHOT(key[0], created, seen, n, rejected, "expired", opened)
        elif watermark >= created and early:
            self.now.update((created, seen, n, rejected, opened, []))
            self._wake(end)

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(int(at * 1000) + 1)

    def close(self) -> None:
        pass


def stream_sessions(steps: DataFrame, ttl_seconds: int = SESSION_TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Snapshots of sessions: start, last step, steps in time and steps after the end.

    Age counts from the first step, not from the last one, so this is no session window. Rows without
    a time are left out. ``opened`` tells the states of one id apart; read the snapshots through
    ``session_totals``.
    """
    timed = steps.select("session_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    timed = timed.withColumn("at", F.unix_micros("ts") / 1_000_000.0)
    return (
        timed.withWatermark("ts", delay)
        .groupBy("session_id")
        .transformWithState(Sessions(ttl_seconds), OUTPUT, "append", "eventTime")
    )


def session_totals(snapshots: DataFrame) -> DataFrame:
    """One row per session from its snapshots: the first start counts, all steps of later states are rejected."""
    seen = F.col("n_steps") + F.col("n_rejected")
    latest = snapshots.groupBy("session_id", "opened").agg(
        F.max_by(F.struct("created_at", "last_seen", "n_steps", "n_rejected", "status"), F.struct(seen, F.col("status") == "expired")).alias("s")
    )
    first = F.min_by(F.struct("s.*", "opened"), "opened").alias("f")
    total = F.sum(F.col("s.n_steps") + F.col("s.n_rejected")).alias("total")
    found = latest.groupBy("session_id").agg(first, total, F.max("s.last_seen").alias("last_seen"))
    return found.select(
        "session_id",
        F.col("f.created_at").alias("created_at"),
        "last_seen",
        F.col("f.n_steps").alias("n_steps"),
        (F.col("total") - F.col("f.n_steps")).alias("n_rejected"),
        F.col("f.status").alias("status"),
    )
