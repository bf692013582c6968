"""The conversation trie and its centroid rollup against plain trees."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from mendframe.llm import convtree

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=100, heads=6):
    """Nodes as tuples of turns, totals by walking every subtree."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, content, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + mine[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    found = []
    for node, convs in members.items():
        below = [node]
        for n in below:
            below.extend(children[n])
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        found.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
             sum(not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(found, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA) if not hasattr(rows, "columns") else rows
    return sorted((tuple(r[c] for c in COLUMNS) for r in convtree.prefix_tree(df, **options).collect()), key=str)


def talks(seed, convs=120, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), convs):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            role, text = rng.choice(["user", "bot", None]), rng.choice([None, "", "é", "hello", "x" * 50][: words + 2])
            rows.append((c, rng.choice([turn, turn, 0, None]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("local_nodes", [1, 7, 4096])
def test_tree_equals_plain_walk(spark, local_nodes):
    rows = talks(local_nodes)
    assert found(spark, rows, local_nodes=local_nodes) == brute(rows)


def test_ties_nulls_and_turnless(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (100, 1, "a", "b"), (101, 1, "a", "c"), (250, 0, "a", "b"), (7, 1, "u", "t" * 30_000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_has_no_nodes(spark):
    assert found(spark, []) == []


def test_other_columns_do_no_harm(spark):
    rows = talks(5, 20)
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", depth int, node string, parent binary")
    assert found(spark, df) == brute(rows)


def test_long_conversation_is_cut_everywhere(spark, monkeypatch):
    """A conversation with most of the rows, many chunks and a chain of components."""
    monkeypatch.setattr(convtree, "CHUNK_TURNS", 50)
    rows = [(1000, t, "user", str(t % 7)) for t in range(400)] + [(1001, t, "user", str(t % 7)) for t in range(380)] + talks(6, 10)
    assert found(spark, rows, local_nodes=60) == brute(rows)


def test_hot_node_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(convtree, "PIECE_IDS", 4)
    rows = [(c, 0, "user", "same") for c in range(0, 3000, 100)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_settle_equals_sums_of_subtrees(seed):
    rng = random.Random(seed)
    parents = [-1 if i == 0 or rng.random() < 0.02 else rng.randrange(max(0, i - rng.choice([1, 1, 3, 50])), i) for i in range(300)]
    values = [[rng.randrange(10) for _ in parents], [1] * len(parents)]
    members = [rng.randrange(1, 5) for _ in parents]

    def totals(v):
        t = list(v)
        for i in reversed(range(len(parents))):
            if parents[i] >= 0:
                t[parents[i]] += t[i]
        return t

    sums = [[0] * len(parents), [5] * len(parents)]
    convtree.settle(list(parents), totals(members), values, sums)
    assert sums == [totals(values[0]), [5 + t for t in totals(values[1])]]
