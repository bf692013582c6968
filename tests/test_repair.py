"""Diagnosis and repair rules on small frames."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from mendframe.operators import diagnose, registry, repair
from mendframe.sources import tables
from mendframe.sources.catalogue import dataset_meta, datasets_for


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


META = {
    "domain": "medical_diagnosis",
    "display_name": "Small",
    "domain_rules": {
        "zeros_as_missing": ["z", "absent"],
        "log_transform_candidates": ["skewed"],
        "redundant_features": ["copy"],
    },
}


@pytest.fixture(scope="module")
def small(spark):
    data = [
        (i, 0.0 if i < 3 else float(i), 1.0 if i < 19 else 900.0, float(i), float(i) if i % 4 else None,
         1 if i < 4 else 0)
        for i in range(20)
    ]
    return spark.createDataFrame(
        data, "_row_id int, z double, skewed double, copy double, holes double, label int"
    )


def test_cleaner_order_and_numbering(small):
    recs = diagnose.cleaner_recommendations(small, META).collect()
    assert [(r["priority"], r["type"], r["column"]) for r in recs] == [
        (1, "zero_to_nan_impute", "z"),
        (2, "impute", "holes"),
        (3, "log_transform", "skewed"),
        (4, "drop_redundant", "copy"),
    ]
    assert recs[1]["strategy"] == "mean_impute" and recs[1]["pct"] == 0.25
    assert "medical_diagnosis" in recs[0]["reason"]
    assert diagnose.unmatched_rules(small, META) == [("zeros_as_missing", "absent")]


def test_recommendation_ids_are_stable(small):
    first = [r["rec_id"] for r in diagnose.cleaner_recommendations(small, META, "d").collect()]
    again = [r["rec_id"] for r in diagnose.cleaner_recommendations(small.repartition(7), META, "d").collect()]
    assert first == again and len(set(first)) == 4


def test_clean_frame_has_nothing_to_do(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(12)], "a double, label int")
    assert diagnose.cleaner_recommendations(df).count() == 0
    assert diagnose.balancer_recommendations(df).count() == 0
    report = diagnose.cleaner_report(df).first()
    assert report["diagnosis"].startswith("No missing values")
    plan = diagnose.analyst_report(df).first()["action_plan"]
    assert [p["action"] for p in plan] == ["query_validator"]


def test_few_values_lead_to_dropping_rows(spark):
    df = spark.createDataFrame([(1.0 if i < 4 else None, i % 2) for i in range(30)], "a double, label int")
    assert diagnose.cleaner_recommendations(df).first()["strategy"] == "drop_rows"


def test_augmenter_guards_and_cap(spark):
    def frame(zeros, ones):
        return spark.createDataFrame([(1.0, 0)] * zeros + [(2.0, 1)] * ones, "a double, label int")

    assert diagnose.augmenter_recommendation(frame(5, 4)).count() == 0  # fewer than ten rows
    assert diagnose.augmenter_recommendation(frame(20, 0)).count() == 0  # one class
    rec = diagnose.augmenter_recommendation(frame(400, 10)).first()
    assert (rec["target_class"], rec["target_count"], rec["n_to_add"]) == (1, 340, 330)
    assert "WARNING" in rec["reason"]
    assert "WARNING" not in diagnose.augmenter_recommendation(frame(400, 250)).first()["reason"]
    assert diagnose.augmenter_recommendation(frame(400, 10), cap=300).first()["n_to_add"] == 300
    other = diagnose.augmenter_recommendation(frame(400, 10), target_class=0)
    assert other.count() == 0


def test_balancer_offers_both_ways(spark):
    df = spark.createDataFrame([(1.0, 0)] * 30 + [(2.0, 1)] * 10, "a double, label int")
    recs = diagnose.balancer_recommendations(df).collect()
    assert [(r["strategy"], r["target_class"], r["current_count"], r["target_count"]) for r in recs] == [
        ("oversample_minority", 1, 10, 30),
        ("undersample_majority", 0, 30, 10),
    ]


def test_medical_domains_use_wider_fences(spark):
    values = [float(i) for i in range(20)] + [60.0]
    df = spark.createDataFrame([(v, 0) for v in values], "a double, label int")
    assert diagnose.validator_recommendations(df, {"domain": "finance"}).count() == 1
    assert diagnose.validator_recommendations(df, {"domain": "medical_x"}).count() == 0


def test_zero_to_median_leaves_nulls(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.0,), (4.0,), (0.0,)], "a double")
    assert rows(repair.zero_to_median(df, "a", label="none")) == [(2.0,), (3.0,), (3.0,), (4.0,), (None,)]


def test_impute_and_unknown_strategy(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (9.0,)], "a double")
    assert (2.0,) in rows(repair.impute(df, "a", "median_impute")) and repair.impute(
        df, "a", "median_impute"
    ).filter("a is null").count() == 0
    assert (4.0,) in rows(repair.impute(df, "a", "mean_impute"))
    assert rows(repair.impute(df, "a", "something")) == rows(df)


def test_log_and_clip_keep_nulls(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (math.e - 1,), (10.0,)], "a double")
    logged = [r[0] for r in repair.log_transform(df, "a").collect()]
    assert logged[:2] == [0.0, None] and logged[2] == pytest.approx(1.0)
    assert rows(repair.clip_column(df, "a", 0.0, 5.0)) == rows(
        spark.createDataFrame([(0.0,), (None,), (math.e - 1,), (5.0,)], "a double")
    )


def test_duplicates_keep_the_smallest_key(spark):
    df = spark.createDataFrame([(3, "x", None), (1, "x", None), (2, "y", 1.0)], "_row_id int, t string, a double")
    assert [r["_row_id"] for r in repair.remove_duplicates(df).orderBy("_row_id").collect()] == [1, 2]


def test_guard_accepts_up_to_ten_percent(spark):
    df = spark.range(100).withColumnRenamed("id", "_row_id")
    assert repair.integrity_guard(df, df.limit(90)).first()["accepted"]
    assert not repair.integrity_guard(df, df.limit(89)).first()["accepted"]
    grown = repair.integrity_guard(df, df.union(df)).first()
    assert grown["accepted"] and grown["deletion_pct"] == 0.0


def test_guarded_repair_is_dropped(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1.0, 0) for i in range(20)], "_row_id int, a double, label int")
    rec = {"type": "impute", "column": "a", "strategy": "drop_rows"}
    after, accepted = repair.guarded(df, rec)
    assert not accepted and after.count() == 20


def test_every_recommendation_type_has_a_repair(spark, small):
    recs = diagnose.cleaner_recommendations(small, META).collect()
    for rec in recs:
        assert repair.apply_recommendation(small, rec.asDict()).count() == 20
    assert repair.apply_recommendation(small, {"type": "no such type"}) is small


def test_landing_table(spark):
    df = spark.createDataFrame(
        [("yes", "b", float("nan")), ("no", "?", 2.0), (None, "a", 3.0), ("yes", "a", 4.0)],
        "class string, work string, x double",
    )
    want = [(0, None, 2.0), (1, 0, 4.0), (1, 1, None)]
    got = tables.normalise_landing(df, "class").select("label", "work", "x")
    assert rows(got) == sorted(want, key=str)
    as_category = tables.normalise_landing(df, "class", null_as_category=True).select("label", "work")
    assert rows(as_category) == [(0, 2), (1, 0), (1, 1)]


def test_catalogue(spark):
    meta = {r["name"]: r for r in dataset_meta(spark).collect()}
    assert len(meta) == 5
    assert meta["adult_census"]["target_accuracy"] == 0.8449
    assert meta["heart_disease"]["difficulty"] == "hard"
    assert {r["name"] for r in datasets_for(spark, "easy").collect()} == {"adult_census", "breast_cancer"}


def test_codes_of_many_values(spark):
    """Sorted by one task or by ranges: the same codes, null kept null."""
    from mendframe.operators.ranking import value_codes

    words = [f"user_{(i * 7919) % 500}" for i in range(900)] + [None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((w, i) for i, w in enumerate(sorted({w for w in words if w})))
    assert rows(value_codes(df, "w")) == rows(value_codes(df, "w"))
    assert sorted(map(tuple, value_codes(df, "w").collect())) == want
    coded = repair.encode_categories(df, ["w"])
    assert coded.count() == 901 and coded.filter("w is null").count() == 1


def test_scratch_is_removed_on_request(spark):
    from mendframe.session import clear_scratch, materialise, scratch_mark

    mark = scratch_mark(spark)
    kept = materialise(spark.range(3), "kept")
    after = scratch_mark(spark)
    gone = materialise(spark.range(4), "gone")
    path = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert clear_scratch(spark, after) == scratch_mark(spark) - after + 1
    assert not Path(path).exists() and kept.count() == 3 and scratch_mark(spark) == mark + 1


def test_registry_checks_and_dispatches(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "_row_id bigint, a double, label int")
    known = registry.standard()
    recs = lambda **more: spark.createDataFrame([("r", "thin", 1)], "rec_id string, type string, priority int").withColumns(more)
    known.diagnosis("query_own", cost=3)(lambda df, context: recs(column=F.lit("a")))
    known.repair("thin")(lambda df, rec, context: df.filter(F.col(rec["column"]) > 4))
    found = known.diagnose(df, "query_own", registry.Context()).first().asDict()
    assert set(diagnose.RECOMMENDATION) <= set(found) and found["column"] == "a" and known.cost("query_own") == 3
    after, accepted = known.guarded(df, found)
    assert not accepted and after is df  # a quarter of the rows would go
    assert known.guarded(df, found, limit=0.5)[0].count() == 15
    report = known.report(df, found).first()
    assert (report["rows_removed"], report["message"]) == (5, None)
    assert known.apply(df, {"type": "nothing of the kind"}) is df
    known.diagnosis("query_wrong")(lambda df, context: recs(pct=F.lit("much")))
    known.diagnosis("query_short")(lambda df, context: recs().drop("type"))
    for name in ("query_wrong", "query_short", "query_none"):
        with pytest.raises(ValueError):
            known.diagnose(df, name, registry.Context())
    assert "query_own" not in registry.standard().diagnoses
