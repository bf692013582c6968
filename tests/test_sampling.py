"""Sampling: exact sizes, the same rows on any partitioning, skewed and tiny classes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.operators import sampling, synth
from mendframe.operators.neighbours import nearest_neighbours
from mendframe.operators.ranking import PICKED, dense_index, pick_smallest


@pytest.fixture(scope="module")
def skewed(spark):
    """A third class of one row, a rare class and a very large one."""
    label = F.when(F.col("id") == 7, 2).when(F.col("id") % 50 == 0, 1).otherwise(0)
    return spark.range(3000).select(
        F.col("id").alias("_row_id"), (F.col("id") * 0.5).alias("a"), label.alias("label")
    )


def keys(df):
    return sorted(r["_row_id"] for r in df.select("_row_id").collect())


@pytest.mark.parametrize("count", [0, 1, 17, 3000, 5000])
def test_exact_number_of_rows(skewed, count):
    assert pick_smallest(skewed, count, 1, "t").filter(PICKED).count() == min(count, 3000)


def test_split_is_disjoint_covering_and_stratified(skewed):
    train, holdout = sampling.stratified_split(skewed)
    a, b = keys(train), keys(holdout)
    assert sorted(a + b) == list(range(3000)) and len(b) == 600
    by_class = {r["label"]: r["count"] for r in holdout.groupBy("label").count().collect()}
    assert by_class[1] == 12 and by_class[0] in (587, 588)


def test_same_rows_on_any_partitioning(skewed):
    picks = [keys(sampling.mark_holdout(skewed.repartition(n)).filter(PICKED)) for n in (1, 7, 200)]
    assert picks[0] == picks[1] == picks[2]
    other = keys(sampling.mark_holdout(skewed, seed=43).filter(PICKED))
    assert other != picks[0]


def test_null_labels_are_never_picked(spark):
    df = spark.createDataFrame([(i, None if i % 3 else 1) for i in range(90)], "_row_id int, label int")
    marked = sampling.mark_holdout(df)
    assert marked.count() == 90
    assert marked.filter(F.col(PICKED) & F.col("label").isNull()).count() == 0


def test_undersample_and_oversample_sizes(skewed):
    two = skewed.filter("label < 2")
    under = {r["label"]: r["count"] for r in sampling.undersample(two).groupBy("label").count().collect()}
    assert under == {0: 60, 1: 60}
    for broadcast_rows in (0, 200_000):
        over = sampling.oversample(two, 1, broadcast_rows=broadcast_rows)
        sizes = {r["label"]: r["count"] for r in over.groupBy("label").count().collect()}
        assert sizes[0] == sizes[1]
        assert over.select("_row_id").distinct().count() == over.count()


def test_oversample_shuffle_and_broadcast_agree(skewed):
    two = skewed.filter("label < 2")
    a = sorted(map(tuple, sampling.oversample(two, 1, broadcast_rows=0).collect()))
    assert a == sorted(map(tuple, sampling.oversample(two, 1).collect()))


def test_oversample_from_one_row(skewed):
    """One row drawn thousands of times does not end up as one long list."""
    over = sampling.oversample(skewed, 2)
    assert over.filter("label = 2").count() == over.filter("label = 0").count()


def test_parity_and_one_class_are_left_alone(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(10)], "_row_id int, a double, label int")
    assert sampling.oversample(df, 1).count() == 10
    assert sampling.oversample(df.filter("label = 1"), 1).count() == 5


def test_dense_index_is_a_permutation(skewed):
    index = [r["_idx"] for r in dense_index(skewed, 1, "t").collect()]
    assert sorted(index) == list(range(3000))


def test_label_flips_are_exact_and_spare_golden_rows(skewed):
    two = skewed.filter("label < 2")
    marked = sampling.mark_golden(two, 10)
    assert marked.filter("_golden").count() == 10
    noisy = sampling.flip_labels(marked, 0.1)
    changed = noisy.alias("n").join(two.alias("o"), "_row_id").filter("n.label <> o.label")
    assert changed.count() == int((two.count() - 10) * 0.1)
    assert changed.filter("_golden").count() == 0


def test_golden_rows_skip_small_classes(skewed):
    sizes = sampling.mark_golden(skewed, 10).filter("_golden").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in sizes} == {0: 5, 1: 5}


def test_corruption_levels(skewed):
    two = skewed.filter("label < 2")
    dirty = sampling.corrupt(two, "hard")
    share = dirty.filter("not _golden").agg(F.avg(F.col("a").isNull().cast("double"))).first()[0]
    assert 0.22 < share < 0.34
    assert dirty.filter("_golden and a is null").count() == 0


def test_first_of_class_is_dropped_in_key_order(skewed):
    left = sampling.drop_first_of_class(skewed, 0.4, 1)
    assert left.filter("label = 1").agg(F.min("_row_id")).first()[0] == 24 * 50
    assert left.filter("label <> 1").count() == 2940


def test_golden_check_states(spark):
    golden = spark.createDataFrame([(1, None, 0), (2, 2.0, 0), (3, 3.0, 1)], "_row_id int, a double, label int")
    now = spark.createDataFrame([(1, None, 0), (2, 9.0, 0), (2, 2.5, 0)], "_row_id int, a double, label int")
    states = {r["_row_id"]: r["state"] for r in sampling.golden_check(golden, now).collect()}
    assert states == {1: "intact", 2: "changed", 3: "missing"}


def test_interpolated_rows_lie_between_two_rows(skewed):
    two = skewed.filter("label < 2")
    grown = synth.interpolate_rows(two, 1, 40)
    added = grown.filter("_row_id < 0")
    assert added.count() == 40 and added.filter("label <> 1").count() == 0
    low, high = two.filter("label = 1").agg(F.min("a"), F.max("a")).first()
    assert added.filter(~F.col("a").between(low, high)).count() == 0
    a = sorted(map(tuple, grown.collect()))
    assert a == sorted(map(tuple, synth.interpolate_rows(two, 1, 40, broadcast_rows=0).collect()))
    assert synth.interpolate_rows(skewed, 2, 5) is skewed  # one row has no partner


def brute_force(ids, vectors, k):
    out = []
    for i, v in enumerate(vectors):
        d = np.round(np.sqrt(((vectors - v) ** 2).sum(axis=1)), 6)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [None, 16, 1000])
@pytest.mark.parametrize("copies", [0, 150])
def test_neighbours_match_brute_force(spark, block_rows, copies):
    """With a group of copies larger than any block as well."""
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(120, 6)) + 4 * rng.integers(0, 3, size=(120, 1)), 3)
    if copies:
        vectors = np.vstack([vectors, np.repeat(vectors[:1], copies, axis=0)])
    ids = np.arange(len(vectors)) * 3
    df = spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "id bigint, vec array<double>"
    )
    got = sorted(map(tuple, nearest_neighbours(df, 4, block_rows=block_rows).collect()))
    assert got == brute_force(ids, vectors, 4)


def test_neighbours_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id bigint, vec array<double>")
    assert nearest_neighbours(df, 5).count() == 6
    assert nearest_neighbours(df.limit(1), 5).count() == 0


def test_smote_balances_and_guards(spark, skewed):
    two = skewed.filter("label < 2")
    grown = synth.smote(two)
    sizes = {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()}
    assert sizes[0] == sizes[1]
    # A class of one row has no neighbours: it stays as it is, and the others are grown all the same.
    plan = {r["label"]: (r["n_to_add"], r["skipped"]) for r in synth.smote_plan(skewed).collect()}
    some = {r["label"]: r["count"] for r in synth.smote(skewed).groupBy("label").count().collect()}
    lone = [c for c, (_, why) in plan.items() if why]
    assert lone and all(some[c] == 1 and "too few" in plan[c][1] for c in lone)
    assert len({n for c, n in some.items() if c not in lone}) == 1
    keys = synth.smote(skewed).select("_row_id")
    assert keys.count() == keys.distinct().count()
    assert synth.smote(two.limit(10)).count() == 10


def test_generated_tables(spark):
    ids = spark.range(500).withColumnRenamed("id", "_row_id")
    df = synth.archetype_table(ids, "churn", "medium")
    assert df.columns[:2] == ["_row_id", "feature_0"]
    means = synth.generate_table(ids).groupBy("label").agg(F.avg("feature_0").alias("m")).collect()
    by_class = {r["label"]: r["m"] for r in means}
    assert by_class[1] > 0.5 > -0.5 > by_class[0]
