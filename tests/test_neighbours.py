"""How much of a neighbour search is left as tables grow, and its parts against plain code."""

from __future__ import annotations

import numpy as np
import pytest

from mendframe.operators import neighbours as N


def points(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, vec array<double>").repartition(4)


def grouped(groups, rows, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, 1, 6)) * 20 + rng.normal(size=(groups, rows, 6))


def test_work_per_row_does_not_grow_with_the_table(spark):
    """Four times the groups: the share of pairs falls, and rows are not sent to more blocks."""
    small = N.search_work(points(spark, grouped(8, 60).reshape(-1, 6)), 4, block_rows=64).first()
    large = N.search_work(points(spark, grouped(32, 60).reshape(-1, 6)), 4, block_rows=64).first()
    assert (small["n"], large["n"]) == (480, 1920)
    assert large["compared"] < 0.5 * small["compared"] < 0.5
    assert large["copies"] <= small["copies"] + 1


def test_coordinates_never_exceed_distances():
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(80, 12)) * rng.random(12)
    basis = np.linalg.qr(rng.normal(size=(12, 12)))[0][:, :5]
    low = N.distances(*[N.coordinates(vecs, basis)] * 2)
    assert (low <= N.distances(vecs, vecs) + 1e-6).all()


@pytest.mark.parametrize("count", [1, 7, 64])
def test_pivots_lie_among_their_rows(count):
    vecs = np.random.default_rng(2).normal(size=(200, 4))
    pivots = N.pivots_of(vecs, count)
    assert pivots.shape == (count, 4) and np.abs(pivots).max() <= np.abs(vecs).max()
    assert len(N.pivots_of(np.ones((5, 3)), count)) == 1  # copies have one centre


def test_one_group_holds_most_rows_and_groups_are_apart(spark):
    """With ``by``: groups of 150, 5 and 1 rows, neighbours only within."""
    vectors = grouped(1, 156, seed=3)[0]
    by = ["a"] * 150 + ["b"] * 5 + ["c"]
    rows = [(i, [float(x) for x in v], g) for i, (v, g) in enumerate(zip(vectors, by, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, grp string")
    got = {}
    for r in N.nearest_neighbours(df, 3, block_rows=16, by="grp").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i, v in enumerate(vectors):
        same = [j for j in range(156) if by[j] == by[i] and j != i]
        want = sorted(same, key=lambda j: (round(float(np.sqrt(((vectors[j] - v) ** 2).sum())), 6), j))[:3]
        assert [n for _, n in sorted(got.get(i, []))] == want
