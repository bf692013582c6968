"""Exact k nearest neighbours with a metric tree, bounds per row and an orthogonal projection.

Rows are put into the balls of a tree, split by distance to pivots as long as balls are large; leaves
that follow each other in the tree make up blocks of bounded size. Every row first finds the k nearest of
its own block, which bounds how far the others can be. A leaf is out of reach of a row if its ball is, or
if the row's leading coordinates in an orthogonal basis are too far from the leaf's box of them
already: partial distances never exceed whole ones. Only then a row's vector is sent to the block of a
leaf, once per block, and compared there; no pair of blocks is compared as a whole.

The work follows the data: where neighbours are near, most rows stay in a few blocks; for vectors that are
spread evenly in many dimensions nothing can be ruled out, and it is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.constants import SEED
from mendframe.operators.sizing import null_safe_join, small_side
from mendframe.session import materialise

BLOCK_BYTES = 16_000_000
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 64, 65_536
#: Blocks per core that a small table is cut into, and leaves of the tree in a block.
BLOCKS_PER_CORE, LEAVES_PER_BLOCK = 2, 4
#: Balls that a ball is split into at most, rounds of it, rows of a ball that tell where, and centres in all.
FAN, LEVELS, SAMPLE, MAX_CENTRES = 64, 3, 2_048, 1 << 16
#: Leading coordinates that are compared before vectors are sent.
AXES = 16
#: Cells of a matrix of distances that is held at a time.
TILE_CELLS = 1 << 22
ROUNDING = 6
SLACK = 1e-5
COPY_SALTS = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by one product; off by rounding, so good for bounds and shortlists only."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the error of ``distances`` and of rounding together."""
    largest = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    return SLACK + 1e-6 * largest * max(1, a.shape[1]) ** 0.5


def closest(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int) -> tuple:
    """The k nearest rows of ``b`` for each row of ``a``: row numbers of both and rounded distances."""
    rough = distances(a, b)
    rough[a_ids[:, None] == b_ids[None, :]] = np.inf
    if len(b) > k:
        last = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
        mine, other = np.nonzero((rough <= last + 2 * slack(a, b)) & np.isfinite(rough))
    else:
        mine, other = np.nonzero(np.isfinite(rough))
    # Only the shortlist is measured exactly, then ranked with ties to the smaller id.
    exact = np.concatenate(
        [np.zeros(0), *(np.sqrt(((a[mine[s]] - b[other[s]]) ** 2).sum(axis=1)) for s in _slices(len(mine)))]
    )
    exact = np.round(exact, ROUNDING)
    order = np.lexsort((b_ids[other], exact, mine))
    mine, other, exact = mine[order], other[order], exact[order]
    rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
    kept = rank < k
    return mine[kept], other[kept], exact[kept]


def _slices(n: int, size: int = 65_536):
    return [slice(i, i + size) for i in range(0, n, size)]


def _tiles(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int) -> tuple:
    """``closest`` with a bounded number of distances at a time."""
    step = max(1, TILE_CELLS // max(1, len(b)))
    found = [closest(a[i : i + step], b, a_ids[i : i + step], b_ids, k) for i in range(0, len(a), step)]
    mine = np.concatenate([m + i * step for i, (m, _, _) in enumerate(found)])
    return mine, *(np.concatenate([f[c] for f in found]) for c in (1, 2))


def _rows(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def nearest_neighbours(
    points: DataFrame,
    k: int,
    seed: int = SEED,
    block_rows: int | None = None,
    by: str | None = None,
) -> DataFrame:
    """The k nearest other rows of each row: (id, rank, neighbour, distance).

    ``points`` has ``id`` (unique) and ``vec`` (array<double>); with ``by`` only rows of one value
    of that column are neighbours. Distances are rounded to six places and ties go to the smaller
    id. Copies of one vector are collapsed first: only their k + 1 smallest ids can be anyone's
    neighbours, so a large group of copies costs no more than one row. The rows are read several
    times: pass a stored table.
    """
    points = points.select("id", "vec", (F.col(by) if by else F.lit(0)).alias("by"))
    salted = Window.partitionBy("by", "vec", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS))).orderBy("id")
    firsts = points.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k + 1)
    merged = Window.partitionBy("by", "vec").orderBy("id")
    copies = (
        firsts.withColumn("_r", F.row_number().over(merged))
        .filter(F.col("_r") <= k + 1)
        .groupBy("by", "vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "by", "vec", "ids")
    )
    copies = materialise(copies, "copies")
    near = _nearest_distinct(copies.select("id", "by", "vec"), k, seed, block_rows)
    members = copies.select(F.col("id").alias("neighbour"), F.col("ids").alias("_ids"))
    others = near.join(members, "neighbour").select("id", "distance", F.explode("_ids").alias("near"))
    own = copies.select("id", F.lit(0.0).alias("distance"), F.explode("ids").alias("near"))
    # At most (k + 1) squared entries per distinct vector; k + 1 of them cover every copy.
    lists = (
        others.unionByName(own)
        .groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "near"))), 1, k + 1).alias("l"))
    )
    per_vector = copies.select("id", "by", "vec").join(lists, "id").select("by", "vec", "l")
    return (
        points.join(per_vector, ["by", "vec"])
        .select(
            "id",
            F.posexplode(F.slice(F.filter("l", lambda x: x["near"] != F.col("id")), 1, k)).alias(
                "at", "n"
            ),
        )
        .select(
            "id",
            (F.col("at") + 1).alias("rank"),
            F.col("n.near").alias("neighbour"),
            F.col("n.distance").alias("distance"),
        )
    )


class Tree:
    """Pivots of the balls that are split, by group and node; a child is ``FAN * node + number``."""

    def __init__(self) -> None:
        self.split: dict[tuple, np.ndarray] = {}

    def child(self, by: list, node: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child node of every row and its distance to the centre of it (-1 if the ball is not split)."""
        out, away = node * FAN, np.full(len(node), -1.0)
        keys = pd.Series(list(zip(by, node.tolist(), strict=True)), dtype=object)
        for key, rows in keys.groupby(keys).groups.items():
            pivots = self.split.get(key)
            if pivots is not None:
                at = np.asarray(rows)
                d = distances(vecs[at], pivots)
                nearest = d.argmin(axis=1)
                out[at] += nearest
                away[at] = d[np.arange(len(at)), nearest]
        return out, away


def pivots_of(vecs: np.ndarray, count: int) -> np.ndarray:
    """Centres of that many balls of a sample: far apart at first, then moved to the middle of their rows."""
    chosen = [0]
    gap = distances(vecs, vecs[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(vecs, vecs[chosen[-1:]])[:, 0])
    pivots = vecs[chosen]
    for _ in range(2):
        owner = distances(vecs, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, owner, vecs)
        n = np.bincount(owner, minlength=len(pivots))[:, None]
        pivots = np.where(n > 0, sums / np.maximum(n, 1), pivots)
    return pivots


def _basis(points: DataFrame, n: int, seed: int) -> np.ndarray:
    """Orthogonal directions of most variance of a sample of about ``SAMPLE`` rows, at most ``AXES``."""
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / n) * (1 << 30))
    rows = points.where(share).select("vec").limit(2 * SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    vecs = np.array([r["vec"] for r in rows], dtype="float64")
    _, directions = np.linalg.eigh(np.cov(vecs.T).reshape(vecs.shape[1], -1) if len(vecs) > 1 else np.eye(vecs.shape[1]))
    return np.ascontiguousarray(directions[:, ::-1][:, :AXES])


def _split(points: DataFrame, rows: int, seed: int) -> tuple[DataFrame, dict[tuple, np.ndarray]]:
    """``id, by, vec, leaf, away``: rows in the leaves of the tree, stored, and the centres of the leaves.

    Every round splits the balls of more than ``2 * rows`` rows, each by a sample of about ``SAMPLE``
    of its own rows, until ``MAX_CENTRES`` centres are known.
    """
    by_type, id_type = (points.schema[c].dataType.simpleString() for c in ("by", "id"))
    placed = points.select("id", "by", "vec", F.lit(0).cast("bigint").alias("leaf"), F.lit(-1.0).alias("away"))
    room, centres = MAX_CENTRES, {}
    for level in range(LEVELS):
        sizes = placed.groupBy("by", "leaf").count().where(F.col("count") > 2 * rows)
        sizes = small_side(sizes)
        parts = F.least(F.lit(FAN), F.ceil(F.col("count") / rows)).cast("int").alias("parts")
        wanted = sizes.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0]
        if not wanted or wanted > room:
            break
        share = F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("count")) * F.lit(1 << 30)

        def fit(sample: pd.DataFrame) -> pd.DataFrame:
            found = pivots_of(_matrix(sample["vec"]), int(sample["parts"].iloc[0]))
            return pd.DataFrame({"by": [sample["by"].iloc[0]] * len(found), "leaf": sample["leaf"].iloc[0], "number": range(len(found)), "vec": list(found)})

        sample = null_safe_join(placed, sizes, ["by", "leaf"]).where(share).select("by", "leaf", "vec", parts)
        found = sample.groupBy("by", "leaf").applyInPandas(fit, f"by {by_type}, leaf bigint, number int, vec array<double>")
        tree = Tree()
        pieces: dict[tuple, list] = {}
        for r in found.orderBy("leaf", "number").collect():  # at most MAX_CENTRES rows
            pieces.setdefault((r["by"], r["leaf"]), []).append(r["vec"])
        tree.split = {key: np.array(vecs) for key, vecs in pieces.items()}
        room -= sum(map(len, tree.split.values()))
        centres = {(by, leaf * FAN): c for (by, leaf), c in centres.items() if (by, leaf) not in tree.split}
        centres |= {(by, leaf * FAN + n): c for (by, leaf), cs in tree.split.items() for n, c in enumerate(cs)}
        names = ["id", "by", "vec", "leaf", "away"]

        def assign(batches: Iterator[pa.RecordBatch], tree: Tree = tree) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vecs = _rows(batch.column("vec"))
                leaf, away = tree.child(batch.column("by").to_pylist(), batch.column("leaf").to_numpy(), vecs)
                before = batch.column("away").to_numpy()
                columns = [batch.column(c) for c in ("id", "by", "vec")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(leaf), pa.array(np.where(away >= 0, away, before))], names)

        schema = f"id {id_type}, by {by_type}, vec array<double>, leaf bigint, away double"
        placed = materialise(placed.select(*names).mapInArrow(assign, schema), "tree-level")
    return placed, centres


class Leaves:
    """Where the leaves of one group lie: balls, and boxes of the leading coordinates."""

    def __init__(self, rows: list, centres: dict[tuple, np.ndarray], width: int):
        self.block = np.array([r["block"] for r in rows])
        self.far = np.array([r["far"] for r in rows])
        known = [centres.get((r["by"], r["leaf"])) for r in rows]
        self.far[[c is None for c in known]] = np.inf
        self.centre = np.array([np.zeros(width) if c is None else c for c in known])
        self.low, self.high = (np.array([r[side] for r in rows]) for side in ("low", "high"))

    def reached(self, vecs: np.ndarray, coords: np.ndarray, bound: np.ndarray, own: np.ndarray) -> list[list[int]]:
        """The blocks, other than its own, that may hold a row within each row's bound."""
        out = []
        step = max(1, TILE_CELLS // len(self.block))
        for s in (slice(i, i + step) for i in range(0, len(vecs), step)):
            room = bound[s] + slack(vecs[s], self.centre)
            near = distances(vecs[s], self.centre) - self.far <= room[:, None]
            apart = np.zeros(near.shape)
            for axis in range(coords.shape[1]):
                x = coords[s, axis : axis + 1]
                apart += np.maximum(0, np.maximum(self.low[:, axis] - x, x - self.high[:, axis])) ** 2
            near &= np.sqrt(apart) <= room[:, None]
            out += [sorted(set(self.block[n].tolist()) - {mine}) for n, mine in zip(near, own[s].tolist(), strict=True)]
        return out


def coordinates(vecs: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading coordinates, and the length of what they leave; differences of these never exceed distances."""
    lead = vecs @ basis
    rest = np.sqrt(np.maximum(0, (vecs**2).sum(axis=1) - (lead**2).sum(axis=1)))
    return np.column_stack([lead, rest])


def _placed(points: DataFrame, k: int, seed: int, block_rows: int | None) -> tuple[DataFrame, DataFrame, int] | None:
    """Rows with the nearest of their own block and the other blocks they have to visit; sizes of blocks.

    ``id, by, block, vec, near, apart, bound, targets`` and ``by, block, n``. None for fewer than two rows.
    """
    spark = points.sparkSession
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if size["n"] < 2:
        return None
    id_type, by_type = (points.schema[c].dataType.simpleString() for c in ("id", "by"))
    most = min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, BLOCK_BYTES // (8 * size["d"])))
    even = -(-size["n"] // (BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism))
    rows = block_rows or min(most, max(MIN_BLOCK_ROWS, even))
    basis = _basis(points, size["n"], seed)
    leafed, centres = _split(points, max(1, rows // LEAVES_PER_BLOCK), seed)
    # Leaves that follow each other make up a block; one that is larger than a block is cut.
    leaf = ["by", "leaf"]
    parts = leafed.groupBy(*leaf).count().withColumn("parts", F.ceil(F.col("count") / rows).cast("int"))
    units = parts.select(*leaf, "parts", (F.col("count") / F.col("parts")).alias("n"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    before = Window.partitionBy("by").orderBy("leaf", "part").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("block", F.floor((F.sum("n").over(before) - F.col("n")) / rows + 1e-9).cast("int"))
    units = small_side(units.select(*leaf, "part", "parts", "block"))
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts"))
    blocked = null_safe_join(leafed, units, leaf).where(F.col("part") == part).select("id", "by", "block", "leaf", "away", "vec")

    def own(block: pd.DataFrame) -> pd.DataFrame:
        vecs, ids = _matrix(block["vec"]), block["id"].to_numpy()
        mine, other, d = _tiles(vecs, vecs, ids, ids, k)
        cuts = np.searchsorted(mine, np.arange(1, len(vecs)))
        near, apart = np.split(ids[other], cuts), np.split(d, cuts)
        bound = [x[-1] if len(x) >= k else np.inf for x in apart]
        return block.assign(near=near, apart=apart, bound=bound, coords=list(coordinates(vecs, basis)))

    schema = f"id {id_type}, by {by_type}, block int, leaf bigint, away double, vec array<double>, near array<{id_type}>, apart array<double>, bound double, coords array<double>"
    owned = materialise(blocked.groupBy("by", "block").applyInPandas(own, schema), "own-blocks")
    width = basis.shape[1] + 1
    box = [F.array(*[f(F.col("coords")[i]) for i in range(width)]).alias(side) for f, side in ((F.min, "low"), (F.max, "high"))]
    stats = owned.groupBy("by", "block", "leaf").agg(F.max("away").alias("far"), *box, F.count("*").alias("n"))
    stats = materialise(stats, "leaves")
    sizes = stats.groupBy("by", "block").agg(F.sum("n").alias("n"))
    # One row per leaf and block: at most MAX_CENTRES and the number of blocks.
    of_group: dict[object, list] = {}
    for r in stats.join(sizes.groupBy("by").count().where("count > 1").select("by"), "by", "left_semi").collect():
        of_group.setdefault(r["by"], []).append(r)
    leaves = {by: Leaves(found, centres, size["d"]) for by, found in of_group.items()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets: list[list[int]] = [[]] * batch.num_rows
            groups = pd.Series(batch.column("by").to_pylist())
            vecs, coords = _rows(batch.column("vec")), _rows(batch.column("coords"))
            bound, block = batch.column("bound").to_numpy(), batch.column("block").to_numpy()
            for by, at in groups.groupby(groups).groups.items():
                if by in leaves:
                    at = np.asarray(at)
                    for i, t in zip(at, leaves[by].reached(vecs[at], coords[at], bound[at], block[at]), strict=True):
                        targets[i] = t
            kept = [batch.column(c) for c in ("id", "by", "block", "vec", "near", "apart", "bound")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(targets, pa.list_(pa.int32()))], ["id", "by", "block", "vec", "near", "apart", "bound", "targets"])

    schema = f"id {id_type}, by {by_type}, block int, vec array<double>, near array<{id_type}>, apart array<double>, bound double, targets array<int>"
    return materialise(owned.mapInArrow(visit, schema), "visits"), sizes, rows


def _nearest_distinct(points: DataFrame, k: int, seed: int, block_rows: int | None) -> DataFrame:
    """Nearest neighbours among distinct vectors: (id, neighbour, distance)."""
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, neighbour {id_type}, distance double"
    placed = _placed(points, k, seed, block_rows)
    if placed is None:
        return points.sparkSession.createDataFrame([], schema)
    rows, _, most = placed
    visits = rows.select("id", "by", "vec", "bound", F.explode("targets").alias("block"))
    # The visitors of a block are cut into groups no larger than a block; each meets a copy of it.
    slices = visits.groupBy("by", "block").count().select("by", "block", F.ceil(F.col("count") / most).cast("int").alias("slices"))
    slices = small_side(slices)
    key = ["by", "block", "slot"]
    visitors = visits.join(slices, ["by", "block"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    hosts = rows.join(slices, ["by", "block"]).select("id", "by", "block", "vec", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slot"))
    hosts = hosts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("id").alias("host"), F.col("vec").alias("host_vec"))

    def compare(visitor: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if visitor.empty or host.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        ids, others = visitor["id"].to_numpy(), host["host"].to_numpy()
        mine, theirs, d = _tiles(_matrix(visitor["vec"]), _matrix(host["host_vec"]), ids, others, k)
        inside = d <= visitor["bound"].to_numpy()[mine]
        return pd.DataFrame({"id": ids[mine[inside]], "neighbour": others[theirs[inside]], "distance": d[inside]})

    found = visitors.select(*key, "id", "vec", "bound").groupBy(*key).cogroup(hosts.groupBy(*[f"_{c}" for c in key])).applyInPandas(compare, schema)
    own = rows.select("id", F.explode(F.arrays_zip("near", "apart")).alias("n")).select("id", F.col("n.near").alias("neighbour"), F.col("n.apart").alias("distance"))
    # At most k rows per row and block that it visits reach this window.
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return own.unionByName(found).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def search_work(points: DataFrame, k: int, seed: int = SEED, block_rows: int | None = None) -> DataFrame:
    """What a search of distinct vectors costs: rows, share of all pairs of rows that are compared, and
    how often a vector is sent to a block other than its own."""
    placed = _placed(points.select("id", "vec", F.lit(0).alias("by")), k, seed, block_rows)
    if placed is None:
        return points.sparkSession.createDataFrame([], "n bigint, compared double, copies double")
    rows, sizes, most = placed
    met = rows.select("by", F.explode(F.concat(F.array("block"), "targets")).alias("block")).groupBy("by", "block").count()
    hosted = F.col("n") * (F.ceil(F.greatest(F.lit(0), F.col("count") - F.col("n")) / most))
    n = F.sum("n")
    return met.join(sizes, ["by", "block"]).agg(
        n.alias("n"),
        (F.sum(F.col("count") * F.col("n")) / (n * n)).alias("compared"),
        ((F.sum(F.col("count") - F.col("n")) + F.sum(hosted)) / n).alias("copies"),
    )


def vector_of(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])
