"""Versions of a table on shared storage: one folder per version, undo by pointing back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mendframe.constants import LABEL, MAX_ROLLBACKS, UNDO_DEPTH
from mendframe.operators.profile_state import renewed, state_of
from mendframe.session import scratch_path


@dataclass
class Versions:
    """Written versions of one table, each with the profile of its columns, and an undo stack of bounded depth."""

    spark: SparkSession
    base: str
    current: int = 0
    latest: int = 0
    rollbacks: int = 0
    stack: list[int] = field(default_factory=list)
    label: str = LABEL

    @classmethod
    def start(cls, df: DataFrame, base: str | None = None, label: str = LABEL) -> Versions:
        store = cls(df.sparkSession, base or scratch_path(df.sparkSession, "versions"), label=label)
        df.write.parquet(store.path(0))
        state_of(store.read(0), label=label).write.parquet(store.profile_path(0))
        return store

    def path(self, version: int) -> str:
        return f"{self.base}/v={version}"

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(self.current if version is None else version))

    def profile_path(self, version: int) -> str:
        return f"{self.base}/profile={version}"

    def profile(self, version: int | None = None) -> DataFrame:
        """The state of the columns of a version (``profile_state``)."""
        return self.spark.read.parquet(self.profile_path(self.current if version is None else version))

    def commit(self, df: DataFrame, changed: list[str] | None = None) -> DataFrame:
        """Write the next version and make it current; returns it as read from storage.

        ``changed`` names the columns that differ from the current version, if its rows are the same:
        then only their profiles are taken anew.
        """
        df.write.parquet(self.path(self.latest + 1))
        state = renewed(self.profile(), self.read(self.latest + 1), changed, self.label)
        state.write.parquet(self.profile_path(self.latest + 1))
        self.stack = [*self.stack, self.current][-UNDO_DEPTH:]
        self.latest += 1
        self.current = self.latest
        return self.read()

    def rollback(self) -> bool:
        """Point back to the version before the last commit, if quota and stack allow."""
        if self.rollbacks >= MAX_ROLLBACKS or not self.stack:
            return False
        self.current = self.stack.pop()
        self.rollbacks += 1
        return True
