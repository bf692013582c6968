"""Exact quantiles with linear interpolation, at any size and by one path.

The first scan summarises every column by a mergeable quantile sketch (Spark's ``percentile_approx``, whose
ranks are off by ``n / ACCURACY`` at most) and so brackets every wanted rank of all columns. The second
counts the values below each bracket and collects those inside by value: a few in ten thousand. Only
if a bracket still holds too many, of some hundred million rows, it is narrowed by the same sketch
before. All of it combines in each task, so neither a hot value nor the number of rows matters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's ranks are off by one in so many at most; columns of fewer rows need none.
ACCURACY = 10_000
#: How far a bracket reaches to either side of its ranks, in units of that error.
REACH = 4
#: Different values of a bracket that may be collected.
FINAL_ROWS = 200_000
RANK_BUCKETS = 4_096


@dataclass(frozen=True)
class Bracket:
    """Bounds of the values at the ranks ``first`` and ``last`` of a column, and how many rows may lie between."""

    column: int
    first: int
    last: int
    low: float
    high: float
    rows: int


def fit_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], final_rows: int = FINAL_ROWS
) -> dict[str, list[float | None]]:
    """Exact quantiles per column, nulls ignored; None for a column without values."""
    if not columns:
        return {}
    values = [F.col(c).cast("double") + F.lit(0.0) for c in columns]
    reach = REACH / ACCURACY
    asked = [min(1.0, max(0.0, p + side * reach)) for p in probs for side in (-1, 1)]
    facts = [
        f.alias(f"{name}_{i}")
        for i, v in enumerate(values)
        for name, f in (("n", F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)), ("q", F.percentile_approx(v, asked, ACCURACY)))
    ]
    seen = df.agg(*facts).first()
    brackets: dict[tuple[int, int], Bracket] = {}
    for i in range(len(columns)):
        n, least, most = (seen[f"{f}_{i}"] for f in ("n", "lo", "hi"))
        for j, p in enumerate(probs if n else []):
            low, high = seen[f"q_{i}"][2 * j : 2 * j + 2]
            # Near the ends, and for few rows, the bracket is open on that side.
            low = least if n < ACCURACY or p <= reach else low
            high = most if n < ACCURACY or p >= 1 - reach else high
            rows = n if n < ACCURACY else math.ceil(2 * (REACH + 1) / ACCURACY * n)
            brackets[i, j] = Bracket(i, math.floor(p * (n - 1)), math.ceil(p * (n - 1)), low, high, rows)
    while wide := {b for b in brackets.values() if b.rows > final_rows and b.low < b.high}:
        narrowed = _narrow(df, values, sorted(wide, key=repr))
        brackets = {k: narrowed.get(b, b) for k, b in brackets.items()}
    ends = _settle(df, values, sorted(set(brackets.values()), key=repr))
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        result[c] = []
        for j, p in enumerate(probs):
            if (i, j) not in brackets:
                result[c].append(None)
                continue
            part = p * (seen[f"n_{i}"] - 1)
            part -= math.floor(part)
            low, high = ends[brackets[i, j]]
            result[c].append(low if part == 0 else (1.0 - part) * low + part * high)
    return result


def _narrow(df: DataFrame, values: list[Column], brackets: list[Bracket]) -> dict[Bracket, Bracket]:
    """Each bracket cut down around its ranks, by a sketch of the values strictly inside it."""
    facts = []
    for k, b in enumerate(brackets):
        v = values[b.column]
        inside = F.when((v > b.low) & (v < b.high), v)
        # Ranks are asked for by eighths of a reach, so that two of them enclose any rank closely.
        grid = [t / ACCURACY for t in range(0, ACCURACY + 1, REACH)]
        facts += [F.count_if(v <= b.low).alias(f"below_{k}"), F.count(inside).alias(f"n_{k}")]
        facts.append(F.percentile_approx(inside, grid, ACCURACY).alias(f"q_{k}"))
    seen = df.agg(*facts).first()
    out = {}
    for k, b in enumerate(brackets):
        below, n, grid = seen[f"below_{k}"], seen[f"n_{k}"], seen[f"q_{k}"]
        first, last = b.first - below, b.last - below
        if last < 0 or first >= n:
            bound = b.low if last < 0 else b.high
            out[b] = replace(b, low=bound, high=bound, rows=1)
            continue
        # Two steps of the grid are more than the sketch is off; a rank outside keeps the bound it lies on.
        lower = math.floor(first / n * ACCURACY / REACH) - 2 if first >= 0 else -1
        upper = math.ceil((last + 1) / n * ACCURACY / REACH) + 2 if last < n else len(grid)
        low = grid[lower] if lower >= 0 else b.low
        high = grid[upper] if upper < len(grid) else b.high
        rows = min(n, math.ceil((upper - max(lower, 0) + 2) * REACH / ACCURACY * n))
        # A bracket that does not shrink holds few different values.
        out[b] = replace(b, low=low, high=high, rows=rows if (low, high) != (b.low, b.high) else 0)
    return out


def _settle(df: DataFrame, values: list[Column], brackets: list[Bracket]) -> dict[Bracket, tuple[float, float]]:
    """The values at both ranks of each bracket, from the number below it and the values inside."""
    if not brackets:
        return {}
    rows = [
        F.struct(F.lit(k).alias("bid"), F.when(values[b.column] >= b.low, values[b.column]).alias("v"), (values[b.column] <= b.high).alias("held"))
        for k, b in enumerate(brackets)
    ]
    counts = df.select(F.inline(F.array(*rows))).where("held").groupBy("bid", "v").agg(F.count(F.lit(1)).alias("n"))
    found: dict[int, list] = {k: [] for k in range(len(brackets))}
    for r in counts.collect():
        found[r["bid"]].append((r["v"], r["n"]))
    ends = {}
    for k, b in enumerate(brackets):
        passed, at = sum(n for v, n in found[k] if v is None), {}
        for v, n in sorted((v, n) for v, n in found[k] if v is not None):
            at |= {rank: v for rank in (b.first, b.last) if passed <= rank < passed + n}
            passed += n
        ends[b] = at[b.first], at[b.last]
    return ends


def fit_medians(df: DataFrame, columns: list[str], **options) -> dict[str, float | None]:
    return {c: q[0] for c, q in fit_quantiles(df, columns, [0.5], **options).items()}


def fit_order_statistic(df: DataFrame, column: str, rank: int) -> int | None:
    """Exact value at a 0-based rank of a whole-number column.

    Every step counts 4,096 ranges and goes on inside one of them. Whole numbers of any
    size stay exact, which they would not as doubles.
    """
    bounds = df.agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")
    ).first()
    if bounds["lo"] is None or not 0 <= rank < bounds["n"]:
        return None
    low, high, passed = bounds["lo"], bounds["hi"], 0
    while low < high:
        width = -(-(high - low + 1) // RANK_BUCKETS)
        offset = F.col(column) - F.lit(low)
        counts = (
            df.filter(F.col(column).between(low, high))
            .groupBy((offset - F.pmod(offset, F.lit(width))).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
            .orderBy("b")
            .collect()
        )
        for row in counts:
            if passed + row["n"] > rank:
                low, high = row["lo"], row["hi"]
                break
            passed += row["n"]
    return low
