"""Language identification and toxicity: exact parts against plain Python, held-out figures, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.llm import langid, queries, toxicity
from mendframe.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split(" ")).strip() + " "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_kernel_equals_plain(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    texts = ["Ab c!", "abc abc", "É 12 é", "日本 go", "the quick brown fox " * 3, "x"]
    held = langid.Landmarks.of(texts)
    got = np.concatenate(list(held.kernel([*texts, None, "", "123 !"])))
    sets = [plain_grams(t) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert got[: len(texts)] == pytest.approx(np.array(want), abs=1e-6)
    assert np.isnan(got[len(texts) :]).all()


def test_regression_is_kernel_ridge_on_nystrom_features():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(30)]
    marks = langid.Landmarks.of(" ".join(rng.choice(words, 6)) for _ in range(12))
    texts = [" ".join(rng.choice(words, 8)) for _ in range(40)]
    kernel = np.concatenate(list(marks.kernel(texts))).astype(float)
    labels = np.array(rng.choice(["x", "y"], 40), object)
    weights = langid.regression(marks, kernel, labels, ["x", "y"])
    own = marks.holds.T.astype(float) @ marks.holds
    targets = (labels[:, None] == np.array(["x", "y"], object)).astype(float)
    share = (targets / targets.sum(axis=0)).sum(axis=1) / 2
    # The same in terms of landmark weights: (K' S K + ridge * own) w = K' S y.
    want = np.linalg.lstsq(kernel.T @ (kernel * share[:, None]) + langid.RIDGE * own, kernel.T @ (targets * share[:, None]), rcond=1e-9)[0]
    assert kernel @ weights == pytest.approx(kernel @ want, abs=1e-3)


def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op2_language_kernel"](spark, SF)
    docs = table(spark, SF, "documents")
    row = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.97 and 0 <= row[1] <= row[2] <= 1
    assert got.count() == docs.count()
    assert got.where(F.col("held_out") != (fold("doc_id", 4) == 2)).count() == 0


def test_language_of_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, lang_pred string"
    rows = [(i, "the cat and the dog " * (i % 5 + 1), "en", "q") for i in range(20)]
    rows += [(i, "der hund und die katze " * (i % 5 + 1), "de", "q") for i in range(20, 40)]
    rows += [(50, None, "en", "q"), (51, "", "de", "q"), (52, "12 !!", "en", "q"), (53, "der und die", None, "q"), (None, "the dog", "en", "q"), (53, "the dog", None, "q"), (54, "the " * 400_000, None, "q")]
    docs = spark.createDataFrame(rows, kinds)
    model = langid.fit(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()]
    assert [p for i, p in got if i in (50, 51, 52)] == ["und"] * 3
    assert sorted(p for i, p in got if i == 53) == ["de", "en"]
    assert [p for i, p in got if i in (None, 54)] == ["en", "en"]
    kept = langid.keep_known(docs, model, 0.05)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert langid.fit(docs.limit(0)) is None
    blank = langid.predict(docs, None)
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_sample_does_not_depend_on_partitions(spark):
    docs = table(spark, SF, "documents")
    a, b = (langid.fit(d, per_language=20, landmarks=5) for d in (docs, docs.repartition(9)))
    assert a.languages == b.languages and (a.landmarks.keys == b.landmarks.keys).all()
    texts = [r["text"] for r in docs.select("text").limit(200).collect()]
    for (names, scores), (others, values) in zip(a.predict(texts), b.predict(texts), strict=True):
        assert names == others and scores == pytest.approx(values, abs=1e-3)


def made(n: int, seed: int):
    """Texts whose toxic ones hold words of a made-up list, with a beginning in common."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(400)]
    bad = ["zork" + "".join(rng.choices("xyz", k=3)) for _ in range(12)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = rng.choices(plain, k=rng.randint(5, 80)) + (rng.choices(bad, k=rng.randint(1, 4)) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize(), int(toxic)))
    return rows


def test_toxicity_learns_from_labels(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows[:900]], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()}
    held = [(scores[i] >= 0.7, bool(y)) for i, _, y in rows[900:]]
    assert np.mean([p == y for p, y in held]) >= 0.97
    assert sum(p and not y for p, y in held) <= 3
    kept = toxicity.keep_below(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}


def test_toxicity_without_labels_uses_its_list(spark):
    rows = [(i, "a quiet day in the garden", None) for i in range(60)] + [(100, "you idiot, you stupid fool", None)]
    rows += [(101, None, None), (102, "", None), (None, "what a moron and loser", None), (100, "a quiet day", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = [(r["doc_id"], r["score"]) for r in toxicity.predict(docs, model).collect()]
    assert max(s for i, s in scores if i == 100) > 0.7
    assert all(s < 0.3 for i, s in scores if i is not None and i != 100)
    assert toxicity.fit(docs.limit(0), labels.limit(0)).score("x") < 0.7
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_label_model_separates_and_discounts_copies():
    rng = np.random.default_rng(3)
    label = (rng.random(4000) < 0.2).astype(int)
    rate = np.array([[0.01, 0.6], [0.02, 0.5], [0.05, 0.4], [0.3, 0.3]])
    fires = rng.random((4000, 4)) < rate[:, label].T
    fires = np.concatenate([fires, fires[:, :1], fires[:, :1]], axis=1)  # two voters that copy the first
    row, event = np.nonzero(fires)
    known = np.where(np.arange(4000) < 1500, label, -1)
    start = toxicity.LabelModel(np.full(6, 0.2), np.full(6, 0.02), np.ones(6), 0.1)
    model = toxicity.fit_label_model(toxicity.Firings(4000, row, event), 6, known, start)
    assert model.share[[0, 4, 5]] == pytest.approx(1 / 3, abs=1e-6) and model.share[1:4] == pytest.approx(1.0)
    assert model.toxic[:4] == pytest.approx(rate[:, 1], abs=0.06) and model.clean[:4] == pytest.approx(rate[:, 0], abs=0.03)
    assert model.prior == pytest.approx(0.2, abs=0.04)


def test_linear_fit_finds_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4)) < 0.4
    target = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5, 0.0] - 0.5)))
    row, event = np.nonzero(x)
    w = toxicity.fit_linear(toxicity.Firings(500, row, event), 4, target)
    assert w == pytest.approx([2.0, -1.0, 0.5, 0.0, -0.5], abs=0.02)


def test_toxicity_query(spark):
    got = queries.QUERIES["op5_toxicity_scores"](spark, "/root/testdata/sf0.1")
    rows = got.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert np.mean(right) >= 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
