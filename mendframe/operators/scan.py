"""Ordered per-key computations that do not sort a whole key in one task.

``Window.partitionBy(key)`` sends every row of a key to one task, and one key may hold a
third of the data. Here each key is cut into chunks along its order. Rows are scanned inside
their chunk; one summary row per chunk is carried forward over the chunks of the key and
joined back. Only the chunk summaries of a key meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.operators.ranking import ordered_index
from mendframe.session import materialise

CHUNK_ROWS = 100_000
#: A range is not cut further to occupy idle cores below twice this size.
SMALL_RANGE = 4_096


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``max``, ``first`` or ``last`` (non-null) up to each row, or
    ``run``, the length so far of the current run of equal values (rows with null are skipped).

    ``through`` says whether the current row counts.
    """

    kind: str
    value: Column
    through: bool = True

    def local(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.through else -1)
        if self.kind == "sum":
            return F.sum(self.value).over(frame)
        if self.kind == "max":
            return F.max(self.value).over(frame)
        pick = F.last if self.kind == "last" else F.first
        return pick(self.value, ignorenulls=True).over(frame)

    def summary(self, order: list[str]) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        at = F.when(self.value.isNotNull(), _place(order))
        return F.max_by(self.value, at) if self.kind == "last" else F.min_by(self.value, at)

    def carry(self, name: str, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        if self.kind == "sum":
            return F.sum(name).over(frame)
        if self.kind == "max":
            return F.max(name).over(frame)
        pick = F.last if self.kind == "last" else F.first
        return pick(name, ignorenulls=True).over(frame)

    def merge(self, local: Column, carried: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.kind == "max":
            return F.greatest(local, carried)
        return F.coalesce(local, carried) if self.kind == "last" else F.coalesce(carried, local)


def _place(order: list[str]) -> Column:
    """Order as one value; a plain column keeps hash aggregation possible."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def count(condition: Column | None = None, through: bool = True) -> Running:
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Running("sum", one.cast("bigint"), through)


def step_chunk(step: str = "step", rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense step counter: every chunk has at most ``rows`` rows."""
    return F.floor(F.col(step) / rows)


def range_chunks(
    df: DataFrame, order: list[str], rows: int = CHUNK_ROWS, name: str = "_part"
) -> DataFrame:
    """Rows in ranges of about ``rows`` at most along ``order``, numbered and stored; one per core at least.

    A range never falls along the order and knows no keys, so a key with most of the rows, all of
    them in one day, is cut like any other. The column serves ``scan`` as its chunk.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // rows), min(cores, n // SMALL_RANGE))
    ranged = df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id())
    return materialise(ranged, "ranges")


def scan(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, **running: Running
) -> DataFrame:
    """Add one running column per keyword.

    ``order`` must be unique within a key and ``chunk`` must never fall along it. Rows move
    once, by (key, chunk); the carried summaries join on the same partitioning.
    """
    place = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*place).orderBy(*order)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    runs = {name: r for name, r in running.items() if r.kind == "run"}
    plain = {name: r for name, r in running.items() if r.kind != "run"}
    for name, r in runs.items():
        rows = _local_runs(rows, name, r.value, local)
    aggregates = [r.summary(order).alias(f"_s_{name}") for name, r in plain.items()]
    for name, r in runs.items():
        aggregates += _run_summary(name, r.value, order)
    summary = rows.groupBy(*place).agg(*aggregates)
    for name in runs:
        summary = _carry_run(summary, name, keys, over_chunks)
    carried = summary.select(
        *place,
        *[r.carry(f"_s_{name}", over_chunks).alias(f"_c_{name}") for name, r in plain.items()],
        *[c for name in runs for c in (f"_ca_{name}", f"_cn_{name}")],
    )
    scanned = rows.select("*", *[r.local(local).alias(f"_l_{name}") for name, r in plain.items()])
    merged = {n: r.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, r in plain.items()}
    for name, r in runs.items():
        goes_on = (F.col(f"_b_{name}") == 1) & r.value.eqNullSafe(F.col(f"_ca_{name}"))
        before = F.when(goes_on, F.col(f"_cn_{name}")).otherwise(0)
        length = F.col(f"_i_{name}") - F.col(f"_b_{name}") + 1 + before
        merged[name] = F.when(r.value.isNotNull(), length).otherwise(0).cast("bigint")
    return scanned.join(carried, place).select(
        *[F.col(c) for c in df.columns], *[merged[n].alias(n) for n in running]
    )


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], rows: int = CHUNK_ROWS
) -> DataFrame:
    """Every left row with ``values`` of the last right row of its key that does not come after it.

    Nulls where there is none. Both tables are cut together into ranges along the order, and the last
    value is carried over the ranges, so neither a hot key nor a long gap gathers rows in one task.
    Keys are not null; the right table has one row per key and place.
    """
    return as_of_each(left, [(right, values)], keys, order, rows)


def as_of_each(
    left: DataFrame, rights: list[tuple[DataFrame, list[str]]], keys: list[str], order: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """``as_of`` with several right tables in one pass; each comes with its values.

    The rows of all tables are stored once, as they are counted, sampled and dealt into ranges.
    """
    types = [right.select(F.struct(*values).alias("_right")).schema["_right"].dataType for right, values in rights]
    mine = left.select(F.struct(*left.columns).alias("_left")).schema["_left"].dataType

    def side(df: DataFrame, number: int) -> DataFrame:
        row = F.struct(*left.columns) if number == len(rights) else F.lit(None).cast(mine)
        told = [
            (F.struct(*values) if i == number else F.lit(None).cast(types[i])).alias(f"_right{i}")
            for i, (_, values) in enumerate(rights)
        ]
        return df.select(row.alias("_left"), *keys, order, *told, F.lit(number).alias("_side"))

    both = side(left, len(rights))
    for number, (right, _) in enumerate(rights):
        both = both.unionByName(side(right, number))
    along = [order, "_side"]
    ranged = range_chunks(materialise(both, "as-of"), [*keys, *along], rows, "_range")
    seen = {f"_seen{i}": Running("last", F.col(f"_right{i}")) for i in range(len(rights))}
    found = scan(ranged, keys, along, F.col("_range"), **seen)
    told = [F.col(f"_seen{i}")[v].alias(v) for i, (_, values) in enumerate(rights) for v in values]
    return found.where(F.col("_side") == len(rights)).select("_left.*", *told)


def _local_runs(rows: DataFrame, name: str, value: Column, local) -> DataFrame:
    """Index of each non-null value within its chunk, and the index where its run begins."""
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            f"_p_{name}": F.last(value, ignorenulls=True).over(earlier),
            f"_i_{name}": F.count(value).over(so_far),
        }
    )
    begins = F.when(
        value.isNotNull() & ~value.eqNullSafe(F.col(f"_p_{name}")), F.col(f"_i_{name}")
    )
    return rows.withColumn(f"_b_{name}", F.last(begins, ignorenulls=True).over(so_far))


def _run_summary(name: str, value: Column, order: list[str]) -> list[Column]:
    """Values, first and last value, and length of the last run of a chunk."""
    at = F.when(value.isNotNull(), _place(order))
    length = F.col(f"_i_{name}") - F.col(f"_b_{name}") + 1
    return [
        F.count(value).alias(f"_n_{name}"),
        F.min_by(value, at).alias(f"_first_{name}"),
        F.max_by(value, at).alias(f"_last_{name}"),
        F.max_by(length, at).alias(f"_tail_{name}"),
    ]


def _carry_run(summary: DataFrame, name: str, keys: list[str], over_chunks) -> DataFrame:
    """Value and length of the run that is open when a chunk begins.

    A run goes on through a chunk only if the chunk is one run of the same value.
    """
    n, tail = F.col(f"_n_{name}"), F.col(f"_tail_{name}")
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    so_far = over_chunks.rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn(
        f"_ca_{name}", F.last(f"_last_{name}", ignorenulls=True).over(earlier)
    )
    goes_on = (tail == n) & F.col(f"_first_{name}").eqNullSafe(F.col(f"_ca_{name}"))
    summary = summary.withColumn(f"_new_{name}", (n > 0) & ~goes_on)
    summary = summary.withColumn(
        f"_g_{name}", F.sum(F.col(f"_new_{name}").cast("int")).over(so_far)
    )
    inside = Window.partitionBy(*keys, f"_g_{name}").orderBy("_chunk")
    open_run = F.sum(F.when(F.col(f"_new_{name}"), tail).otherwise(n)).over(inside)
    summary = summary.withColumn(f"_open_{name}", open_run)
    return summary.withColumn(f"_cn_{name}", F.lag(f"_open_{name}", 1, 0).over(over_chunks))


def top_rows(
    df: DataFrame, keys: list[str], order: list[Column], k: int, chunk: Column
) -> DataFrame:
    """The first ``k`` rows of each key: first per (key, chunk), then per key.

    ``chunk`` may be any split of a key; at most k rows per chunk reach the second step.
    """
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_chunk", chunk)
        .withColumn("_r", F.row_number().over(inner))
        .filter(F.col("_r") <= k)
        .withColumn("_r", F.row_number().over(outer))
        .filter(F.col("_r") <= k)
        .drop("_chunk", "_r")
    )


def moving_average(
    df: DataFrame, position: str, value: str, width: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Mean of ``value`` over ``width`` rows that follow each other by ``position``, full windows only.

    Positions are unique but may have gaps: rows are numbered first. Each chunk also receives the
    last ``width - 1`` rows before it, so no task sees the whole sequence.
    """
    numbered = ordered_index(df, [position], "_at")
    here = F.floor(F.col("_at") / chunk_rows)
    ahead = F.floor((F.col("_at") + width - 1) / chunk_rows)
    spread = numbered.withColumn("_home", here).withColumn("_chunk", F.explode(F.sequence(here, ahead)))
    frame = Window.partitionBy("_chunk").orderBy("_at").rowsBetween(1 - width, 0)
    return (
        spread.withColumn("moving_avg", F.avg(value).over(frame))
        .filter((F.col("_home") == F.col("_chunk")) & (F.col("_at") >= width - 1))
        .drop("_home", "_chunk", "_at")
    )
