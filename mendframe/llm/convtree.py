"""The prefix trie of conversations, with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a 128-bit digest of its depth and of four
sums of 32-bit hashes over (position, turn), so all keys of a conversation come from running sums,
which are chunked: no conversation, however long, has to fit into one task.

Totals over subtrees: a component of the forest of parent edges is split at its centroid, the
deepest node that holds more than half of the component's weight (the weight of a node is the number
of its members, so subtree weights are known at the start). The total of the component below its
centroid is added to every node from the centroid up to the component's top; then the components
below the centroid and the one above it are split in the same way, in rounds for all components at
once. A component of at most ``local_nodes`` nodes is settled in one task. No round walks along
edges: the node above another one at a given depth is looked up in the conversation that leads to it.

Defined results: rows without conversation id belong to none; a null turn comes first, equal turns
are ordered by a digest of role and text; null roles and texts are empty; repeated rows are turns
of their own; an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.operators.scan import Running, count, range_chunks, scan, step_chunk
from mendframe.operators.sizing import small_side
from mendframe.session import materialise

#: Nodes of a component that one task settles.
LOCAL_NODES = 4096
#: Turns of a conversation whose running sums are taken in one task.
CHUNK_TURNS = 65_536
#: Ids that are joined into one piece of the text that is hashed.
PIECE_IDS = 512
LANES = 4


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, size``: turns numbered from 0, with a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(content).alias("digest"),
        F.char_length(text).cast("long").alias("size"),
        # Repeated rows are cut into ranges like all others.
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = ["turn", "digest", "salt"]
    ranged = range_chunks(turns, ["conv_id", *order])
    return scan(ranged, ["conv_id"], order, F.col("_part"), pos=count(through=False)).select("conv_id", "pos", "digest", "size")


def with_shared_heads(turns: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from a shared head: the first h turns of the first conversation of a block
    of ids, then their own turns after the first h; h is the crc32 of the id as text modulo ``heads``.

    Returns ``conv_id, depth, length, digest, size`` of all turns (depths from 1) and
    ``conv_id, length`` of all conversations, those without turns included.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % block
    turns = materialise(turns, "tree-turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    bases = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    shared = F.least(F.col("h"), F.coalesce("base_own", F.lit(0)))
    known = own.withColumn("h", head).withColumn("base", base).join(bases, "base", "left")
    known = known.select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))
    known = materialise(known, "tree-conversations")
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    taken = known.join(first, "base").where(F.col("pos") < F.col("h"))
    kept = turns.where(F.col("pos") >= head).join(known, "conv_id")
    columns = ["conv_id", "length", "digest", "size"]
    rebuilt = taken.select(*columns, (F.col("pos") + 1).alias("depth")).unionByName(
        kept.select(*columns, (F.col("shared") + F.col("pos") - F.col("h") + 1).alias("depth"))
    )
    return rebuilt, known.select("conv_id", "length")


def key_of(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def root_key() -> Column:
    return key_of(F.lit(0), [F.lit(0)] * LANES)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, length, node, parent, size`` of every turn: the nodes each conversation passes."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "digest") for seed in range(LANES // 2)]
    low = F.lit((1 << 32) - 1)
    lanes = {}
    for i, h in enumerate(hashes):
        lanes |= {f"lane{2 * i}": F.shiftrightunsigned(h, 32), f"lane{2 * i + 1}": h.bitwiseAND(low)}
    rows = turns.withColumns(lanes)
    sums = {f"sum{i}": Running("sum", F.col(f"lane{i}")) for i in range(LANES)}
    summed = scan(rows, ["conv_id"], ["depth"], step_chunk("depth", CHUNK_TURNS), **sums)
    upto = [F.col(f"sum{i}") for i in range(LANES)]
    before = [F.col(f"sum{i}") - F.col(f"lane{i}") for i in range(LANES)]
    node, parent = key_of(F.col("depth"), upto), key_of(F.col("depth") - 1, before)
    return materialise(summed.select("conv_id", "depth", "length", node.alias("node"), parent.alias("parent"), "size"), "tree-paths")


def nodes_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node, parent, depth, size, n_convs, first_conv, weight``: the trie with its root.

    ``weight`` is the sum of the members of all nodes of the subtree.
    """
    below = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("first_conv"), below]
    rows = paths.groupBy("node", "parent", "depth", "size").agg(*members)
    top = lengths.withColumn("depth", F.lit(0).cast("long")).agg(*members).where("n_convs > 0")
    root = top.select(root_key().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), *top.columns)
    return rows.unionByName(root)


def split_components(state: DataFrame, paths: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: every component of ``state`` is split at its centroid.

    Returns the centroids, whose totals are complete, and the other nodes with their new components.
    """
    tops = small_side(state.groupBy("comp").agg(F.max("weight").alias("total"), F.min("depth").alias("top_depth")))
    heavy = state.join(tops, "comp").where(2 * F.col("weight") > F.col("total"))
    deepest = F.max_by(F.struct("node", "first_conv", "depth", "weight", "top_depth"), "depth").alias("c")
    centre = small_side(
        heavy.groupBy("comp").agg(deepest).select("comp", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "first_conv", "depth", "weight", "top_depth")])
    )
    # The step below the centroid on the way to each node, and the nodes from the centroid up to the top.
    steps = paths.select(F.col("conv_id").alias("first_conv"), F.col("depth").alias("step_at"), F.col("node").alias("step"), F.col("parent").alias("step_parent"))
    up = centre.join(paths.select(F.col("conv_id").alias("c_first_conv"), "depth", "node"), "c_first_conv")
    up = up.where(F.col("depth").between(F.col("c_top_depth"), F.col("c_depth"))).select("comp", "node", F.lit(True).alias("up"))
    placed = state.join(centre, "comp").withColumn("step_at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
    placed = placed.join(steps, ["first_conv", "step_at"], "left").join(up, ["comp", "node"], "left")
    is_centre = F.col("node") == F.col("c_node")
    below = F.coalesce(F.col("step_parent") == F.col("c_node"), F.lit(False))
    # The root is the top of its component and on no recorded path.
    on_way = F.coalesce("up", F.lit(False)) | (F.col("depth") == 0)
    placed = materialise(
        placed.select(*state.columns, "c_weight", "step", is_centre.alias("centre"), below.alias("below"), on_way.alias("on_way")), "tree-placed"
    )
    totals = small_side(placed.where("centre OR below").groupBy("comp").agg(*[F.sum(v).alias(f"t_{v}") for v in values]))
    lighter = F.when(F.col("on_way") & ~F.col("centre"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight"))
    changed = {f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("on_way"), F.col(f"t_{v}")).otherwise(0) for v in values}
    changed |= {"weight": lighter, "comp": F.when(F.col("below"), F.col("step")).otherwise(F.col("comp"))}
    moved = materialise(placed.join(totals, "comp").withColumns(changed).select(*state.columns, "centre"), "tree-state")
    return moved.where("centre").drop("centre"), moved.where("NOT centre").drop("centre")


def settle(parents: list[int], weights: list[int], values: list[list[int]], sums: list[list[int]]) -> None:
    """Adds subtree totals of ``values`` to ``sums`` by the same decomposition; tops have parent -1."""
    children: list[list[int]] = [[] for _ in parents]
    work = []
    for i, p in enumerate(parents):
        (children[p] if p >= 0 else work).append(i)
    gone = bytearray(len(parents))
    while work:
        top = centre = work.pop()
        whole = weights[top]
        while (heavy := next((c for c in children[centre] if 2 * weights[c] > whole and not gone[c]), None)) is not None:
            centre = heavy
        below = [centre]
        for node in below:
            below.extend([c for c in children[node] if not gone[c]])
        totals, weight = [sum([v[i] for i in below]) for v in values], weights[centre]
        node = centre
        while True:
            for s, total in zip(sums, totals, strict=True):
                s[node] += total
            if node == top:
                break
            node = parents[node]
            weights[node] -= weight
        gone[centre] = 1
        work.extend([c for c in children[centre] if not gone[c]])
        if centre != top:
            work.append(top)


def settled(components: DataFrame, values: list[str], batch_nodes: int = 1 << 15) -> DataFrame:
    """``node, sum_...`` of all nodes of components that are small enough for a task."""
    names = [f"sum_{v}" for v in values]

    def finish(rows: pa.Table) -> pa.RecordBatch:
        nodes, comps = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        place = {node: i for i, node in enumerate(nodes)}
        found = [place.get(p, -1) for p in rows.column("parent").to_pylist()]
        parents = [p if p >= 0 and comps[p] == comps[i] else -1 for i, p in enumerate(found)]
        sums = [rows.column(n).to_pylist() for n in names]
        settle(parents, rows.column("weight").to_pylist(), [rows.column(v).to_pylist() for v in values], sums)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), *[pa.array(s, pa.int64()) for s in sums]], ["node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= batch_nodes:
                rows = pa.Table.from_batches(held)
                last = rows.column("comp")[-1]
                comps = rows.column("comp").to_pylist()
                whole = size
                while whole and comps[whole - 1] == last.as_py():
                    whole -= 1
                if whole:
                    yield finish(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size -= whole
        if held and size:
            yield finish(pa.Table.from_batches(held))

    columns = ["comp", "node", "parent", "weight", *values, *names]
    rows = components.select(*columns).repartition("comp").sortWithinPartitions("comp")
    return rows.mapInArrow(run, "node binary, " + ", ".join(f"{n} long" for n in names))


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``node, sum_...``: the totals of the columns ``values`` (longs) over the subtree of every node."""
    state = nodes.select("node", "parent", "depth", "first_conv", "weight", *values, root_key().alias("comp"))
    state = materialise(state.withColumns({f"sum_{v}": F.lit(0).cast("long") for v in values}), "tree-state")
    done, small = [], []
    while True:
        large = small_side(state.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > local_nodes).select("comp"))
        small.append(state.join(large, "comp", "left_anti"))
        if large.isEmpty():
            break
        centres, state = split_components(state.join(large, "comp", "left_semi"), paths, values)
        done.append(centres)
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    result = settled(rest, values)
    for part in done:
        result = result.unionByName(part.select(*result.columns))
    return result


def id_hashes(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` from ``node, conv_id``: the hash of the ids, ascending, joined by commas.

    Ids are joined in tasks of sorted ranges; a hash has to follow its text in order, so the pieces of
    a node, ``PIECE_IDS`` ids each, then stream through the hash one after the other, none held for long.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        rows: list[tuple[bytes, int, bytes]] = []

        def close() -> None:
            if ids:
                rows.append((node, ids[0], ",".join(map(str, ids)).encode()))

        for batch in batches:
            for here, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if here != node or len(ids) >= PIECE_IDS:
                    close()
                    node, ids = here, []
                ids.append(conv)
            if rows:
                yield out(rows)
                rows.clear()
        close()
        if rows:
            yield out(rows)

    def out(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["node", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, hashlib.sha256()
        for batch in batches:
            found = []
            for here, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if here == node:
                    running.update(b",")
                else:
                    if node is not None:
                        found.append((node, running.hexdigest()))
                    node, running = here, hashlib.sha256()
                running.update(ids)
            if found:
                yield hexes(found)
        if node is not None:
            yield hexes([(node, running.hexdigest())])

    def hexes(rows: list) -> pa.RecordBatch:
        nodes, found = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], ["node", "ends_sha256"])

    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ranged.mapInArrow(pieces, "node binary, first long, ids binary")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends_sha256 string")


def prefix_tree(conversations: DataFrame, block: int = 100, heads: int = 6, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (``with_shared_heads``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (code points of repeated turns in the subtree), ``ends_sha256``.
    """
    turns, lengths = with_shared_heads(ordered_turns(conversations), block, heads)
    paths = prefixes(turns)
    nodes = materialise(nodes_of(paths, lengths), "tree-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("first_conv").alias("parent_conv_id"))
    known = nodes.join(parents, "parent", "left").join(children.withColumnRenamed("parent", "node"), "node", "left")
    known = materialise(
        known.withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
                "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
                "saved": (F.col("n_convs") - 1) * F.col("size"),
            }
        ),
        "tree-known",
    )
    totals = rollup(known, paths, ["leaf", "saved"], local_nodes)
    ends = paths.where("depth = length").select("node", "conv_id").unionByName(lengths.where("length = 0").select(root_key().alias("node"), "conv_id"))
    rows = known.join(totals, "node").join(id_hashes(ends), "node", "left")
    return rows.select(
        F.col("first_conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("sum_leaf").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
