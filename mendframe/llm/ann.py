"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fit, on a bounded sample: an exact nearest-neighbour graph of the sample, a balanced partitioning of
that graph (recursive bisection along its slowest mode, split at the median, then swaps that cut
fewer edges), and a small softmax classifier that learns from a vector to name its partition.
Index: every distinct vector goes to its most probable partition; a partition is stored in
blocks of bounded size, however many vectors it gets. Search: a query is routed to the partitions
of largest probability until they hold ``mass`` of it (and at least ``probes``), and is compared
exactly, in double precision, with all vectors in them.

The largest inner product favours long vectors, so rows get one more coordinate that lifts them all to
the length of the longest, and queries get 0 there: then the nearest by direction are those of
largest inner product, whatever the lengths. The classifier learns from the rows, and from the sample
as queries, each with the partitions of its best rows.

Equal vectors are collapsed to one with its smallest ids, so a vector with a third of all rows is
searched and found once. Rows without an id, and vectors that are null, zero or hold a null or
non-finite component, take no part, nor do those of another number of components than most (of equally
many: than the longest); rows repeated with the same id count once; an id with several
vectors counts with its best score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.llm.common import hash_sample
from mendframe.session import materialise

#: Distinct vectors the graph and the classifier are fitted on (about).
SAMPLE_ROWS = 8192
#: Neighbours in the graph; vectors a partition should get at least in the sample.
GRAPH_NEIGHBOURS = 12
PARTITION_SAMPLE = 128
#: Blocks a partition is stored in and queries are gathered to.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
PROBES, MASS = 8, 0.999
#: What names a distinct vector.
NAME = ("first", "tag")


def usable(embedding: Column) -> Column:
    """Neither null nor zero, all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def lifted(vectors: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more coordinate that makes all of them ``reach`` long."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0, reach**2 - (vectors**2).sum(axis=1)))])


def asking(vectors: np.ndarray) -> np.ndarray:
    """Queries have nothing in that coordinate."""
    return np.column_stack([vectors, np.zeros(len(vectors))])


def neighbours_of(queries: np.ndarray, rows: np.ndarray, numbers: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with some of the queries, but that of its own number, a few queries at a time."""
    found = [np.zeros((0, k), np.int64)]
    for start in range(0, len(numbers), 128):
        part = numbers[start : start + 128]
        near = queries[part] @ rows.T
        near[np.arange(len(part)), part] = -np.inf
        found.append(np.argpartition(near, -k, axis=1)[:, -k:] if k else np.zeros((len(part), 0), np.int64))
    return np.concatenate(found)


def neighbour_graph(spark: SparkSession, queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Each query's ``k`` best other rows; tasks share the sample, each does some queries."""
    k, shared = min(k, len(rows) - 1), spark.sparkContext.broadcast((queries, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = neighbours_of(*shared.value, batch.column("id").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near.tolist(), pa.list_(pa.int64()))], ["id", "near"])

    found = spark.range(len(rows)).mapInArrow(run, "id long, near array<long>").toArrow().sort_by("id")
    shared.unpersist()
    return found.column("near").combine_chunks().flatten().to_numpy().reshape(len(rows), k)


def bisect(graph: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of a subgraph of equal size that cut few edges; True for the second half."""
    place = np.full(len(graph), -1)
    place[rows] = np.arange(len(rows))
    to = place[graph[rows]]
    a = np.repeat(np.arange(len(rows)), graph.shape[1])[(to >= 0).ravel()]
    b = to.ravel()[(to >= 0).ravel()]
    a, b = np.append(a, b), np.append(b, a)
    degree = np.bincount(a, minlength=len(rows)) + 1e-9
    x = rng.standard_normal(len(rows))
    for _ in range(60):  # power steps of the lazy random walk, without its constant mode
        x = x - (x @ degree) / degree.sum()
        x = 0.5 * (x + np.bincount(a, x[b], minlength=len(rows)) / degree)
        x /= np.linalg.norm(x) + 1e-30
    side = np.zeros(len(rows), bool)
    side[np.argsort(x, kind="stable")[len(rows) // 2 :]] = True
    for _ in range(10):  # exchange equally many that would rather be on the other side
        there = np.bincount(a, side[b], minlength=len(rows))
        gain = np.where(side, degree - 2 * there, 2 * there - degree)
        left, right = (np.flatnonzero((gain > 0) & (side == s)) for s in (False, True))
        n = min(len(left), len(right))
        if not n:
            break
        moved = np.concatenate([left[np.argsort(-gain[left], kind="stable")[:n]], right[np.argsort(-gain[right], kind="stable")[:n]]])
        side[rng.permutation(moved)[: max(1, n)]] ^= True
        extra = int(side.sum()) - (len(rows) - len(rows) // 2)
        if extra:
            over = np.flatnonzero(side == (extra > 0))
            there = np.bincount(a, side[b], minlength=len(rows))
            gain = np.where(side, degree - 2 * there, 2 * there - degree)
            side[over[np.argsort(-gain[over], kind="stable")[: abs(extra)]]] ^= True
    return side


def balanced_partitions(graph: np.ndarray, levels: int, seed: int = 0) -> np.ndarray:
    """A partition number per row; sizes differ by one per level at most."""
    rng, label = np.random.default_rng(seed), np.zeros(len(graph), int)
    for _ in range(levels):
        halves = np.zeros(len(graph), int)
        for part in range(label.max() + 1):
            rows = np.flatnonzero(label == part)
            halves[rows] = bisect(graph, rows, rng) if len(rows) > 1 else 0
        label = 2 * label + halves
    return label


@dataclass
class Router:
    """A softmax classifier over unit vectors."""

    weights: np.ndarray
    intercept: np.ndarray

    @classmethod
    def fit(cls, vectors: np.ndarray, share: np.ndarray, steps: int = 150, rate: float = 0.05, seed: int = 0) -> Router:
        """Adam on mini-batches; ``share`` tells how much of each vector belongs to each partition."""
        rng = np.random.default_rng(seed)
        x = np.append(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.ones((len(vectors), 1)), axis=1)
        w = np.zeros((x.shape[1], share.shape[1]))
        mean, square, t = np.zeros_like(w), np.zeros_like(w), 0
        for _ in range(steps):
            order = rng.permutation(len(x))
            for start in range(0, len(x), 1024):
                rows = order[start : start + 1024]
                slope = x[rows].T @ (softmax(x[rows] @ w) - share[rows]) / len(rows) + 1e-5 * w
                t += 1
                mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
                w -= rate * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        return cls(w[:-1], w[-1])

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return softmax(unit @ self.weights + self.intercept)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(distinct: DataFrame, reach: float, sample_rows: int = SAMPLE_ROWS) -> Router:
    """Fits on about ``sample_rows`` distinct vectors chosen by hash; only they reach the driver."""
    sample = hash_sample(distinct.select(*NAME, "vec"), sample_rows, *NAME, seed=3).toArrow()
    sample = sample.sort_by([(name, "ascending") for name in NAME])
    if len(sample) < 2:
        dims = len(sample.column("vec")[0]) if len(sample) else 1
        return Router(np.zeros((dims + 1, 1)), np.zeros(1))
    vectors, spark = matrix(sample.column("vec").combine_chunks()), distinct.sparkSession
    rows, queries = lifted(vectors, reach), asking(vectors)
    levels = max(0, (len(vectors) // PARTITION_SAMPLE).bit_length() - 1)
    label = balanced_partitions(neighbour_graph(spark, rows, rows, GRAPH_NEIGHBOURS), levels)
    own = np.eye(label.max() + 1)[label]
    best = neighbour_graph(spark, queries, rows, GRAPH_NEIGHBOURS)
    return Router.fit(np.concatenate([rows, queries]), np.concatenate([own, own[best].mean(axis=1)]))


def routed(rows: DataFrame, router: Router, probes: int, mass: float, reach: float | None = None) -> DataFrame:
    """``first, tag, vec, part``: each vector with the partitions that hold ``mass`` of it, ``probes`` at least.

    With ``reach`` the vectors are rows, else queries.
    """
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vec"))
                p = shared.value.probabilities(asking(vectors) if reach is None else lifted(vectors, reach))
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
                wanted = np.maximum(probes, (before < mass).sum(axis=1) + 1) if mass else np.full(len(p), probes)
                parts = [o[:n].tolist() for o, n in zip(order, wanted, strict=True)]
                columns = [*map(batch.column, [*NAME, "vec"]), pa.array(parts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*NAME, "vec", "parts"])

    found = rows.select(*NAME, "vec").mapInArrow(run, "first long, tag long, vec array<double>, parts array<int>")
    return found.select(*NAME, "vec", F.explode("parts").alias("part"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_top(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its ``k`` best rows (ties to the earlier row): query number, row number, inner product."""
    k, rough = min(k, len(rows)), queries @ rows.T
    if k < len(rows):
        # All that may be among the k best survive the fast product; sums of fixed order rank them.
        last = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
        off = 8 * queries.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
        mine, near = np.nonzero(rough >= (last - off)[:, None])
    else:
        mine, near = np.nonzero(np.ones(rough.shape, bool))
    exact = np.concatenate([np.zeros(0), *((queries[mine[i : i + 65536]] * rows[near[i : i + 65536]]).sum(axis=1) for i in range(0, len(mine), 65536))])
    order = np.lexsort((near, -exact, mine))
    mine, near, exact = mine[order], near[order], exact[order]
    kept = np.arange(len(mine)) - np.searchsorted(mine, mine) < k
    return mine[kept], near[kept], exact[kept]


def collapse(rows: DataFrame, k: int) -> DataFrame:
    """``first, tag, vec, ids``: distinct vectors with their ``k + 1`` smallest ids; ranks are cut before the shuffle."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    grouped = least.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    # An id may stand for several vectors, so a vector is named by its smallest id and its hash.
    return grouped.select(F.col("ids")[0].alias("first"), F.xxhash64("vec").alias("tag"), "vec", "ids")


def search(
    vectors: DataFrame, is_query: Column, k: int, probes: int = PROBES, mass: float = MASS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows with ``is_query`` against all others (``vec_id, embedding``)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), is_query.alias("asks")
    )
    usual = rows.groupBy(F.size("vec").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    rows = rows.where(F.size("vec") == F.lit(usual))
    distinct = materialise(collapse(rows, k), "ann-distinct")
    reach = distinct.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    reach = (reach or 0.0) ** 0.5
    router = fit(distinct, reach, sample_rows)
    index = materialise(routed(distinct, router, 1, 0.0, reach), "ann-index")
    asked_rows = rows.where("asks").select("vec_id", "vec").distinct()
    asked = materialise(asked_rows.join(distinct, "vec").select("vec_id", *NAME), "ann-queries")
    wanted = asked.select(*NAME).distinct()
    routes = materialise(routed(distinct.join(wanted, [*NAME]), router, probes, mass), "ann-routes")

    # Both sides of a partition are cut into blocks; each pair of blocks is one group of bounded size.
    sizes = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    asks = routes.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("query_blocks"))
    blocks = materialise(sizes.join(asks, "part"), "ann-blocks")
    row_side = index.join(F.broadcast(blocks), "part").select(
        "part", F.pmod(F.xxhash64(*NAME, F.lit(1)), F.col("row_blocks")).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), *NAME, "vec",
    )
    query_side = routes.join(F.broadcast(blocks), "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        F.pmod(F.xxhash64(*NAME, F.lit(2)), F.col("query_blocks")).cast("int").alias("query_block"), *NAME, "vec",
    )

    names = ["query_first", "query_tag", *NAME, "score"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.zeros(0, float if n == "score" else "int64") for n in names})
        right = right.sort_values([*NAME])
        asks, best, score = exact_top(np.stack(left["vec"]), np.stack(right["vec"]), k + 1)
        sides = [x[n].to_numpy()[at] for x, at in ((left, asks), (right, best)) for n in NAME]
        return pd.DataFrame(dict(zip(names, [*sides, score], strict=True)))

    key = ["part", "row_block", "query_block"]
    kinds = "query_first long, query_tag long, first long, tag long, score double"
    near = query_side.groupBy(*key).cogroup(row_side.groupBy(*key)).applyInPandas(compare, kinds)
    query = ["query_first", "query_tag"]
    by_query = Window.partitionBy(*query).orderBy(F.desc("score"), "first")
    near = near.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1)
    kept = near.join(distinct.select(*NAME, "ids"), [*NAME])
    found = kept.select(*query, "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    # The k + 1 best of a distinct vector hold the k best of each of its rows, whichever one asks.
    lists = (
        found.withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= 2 * k + 2)
        .groupBy(F.col("query_first").alias("first"), F.col("query_tag").alias("tag"))
        .agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    )
    answers = asked.join(lists, [*NAME]).select(F.col("vec_id").alias("query_id"), F.explode("found").alias("hit"))
    answers = answers.select("query_id", "hit.vec_id", "hit.score").where("vec_id <> query_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
