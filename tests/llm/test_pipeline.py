"""The pipeline's stages on planted cases, and what is registered."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from mendframe.llm import queries

SF = "/root/testdata/sf0.01"


def test_one_query_of_each_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_take_effect(spark):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = lambda: "".join(rng.choices("abcdeinorst", k=6))
    planted = [word() for _ in range(150)]
    near = list(planted)
    near[70] = "changed"
    rows = [
        (5000, " ".join(planted), "en", "src0", 1), (5001, " ".join(planted), "en", "src1", 1), (5002, " ".join(near), "en", "src2", 1),
        (5003, "the idiot and the moron are stupid, pathetic scum", "en", "src0", 1), (5004, "123 456 !!", "en", "src0", 1),
        (5005, None, None, None, None), (5006, "", "en", None, 0),
    ]
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    before, toxic = docs, None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-pipeline")
        assert docs.columns == before.columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert 5003 not in kept["toxicity"] and {5000, 5001, 5002, 5004, 5005, 5006} <= kept["toxicity"]
    assert len(clean - kept["toxicity"]) <= 0.01 * len(clean)
    assert len(toxic - kept["toxicity"]) >= 0.6 * len(toxic)
    assert not {5004, 5005, 5006} & kept["language"]
    assert len(kept["toxicity"] - kept["language"]) <= 10
    assert {5000, 5001, 5002} & kept["near_duplicates"] == {5000}

    mixed = corpus_pipeline.materialise(corpus_pipeline.mix_sources(spark, docs, SF), "test-pipeline")
    assert mixed.columns == before.columns and mixed.count() > 0
    tokens = corpus_pipeline.encode_tokens(spark, mixed, SF)
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted(want.encode(r["text"], add_special_tokens=False).ids for r in mixed.collect())
    assert sorted(r["ids"] for r in tokens.collect()) == texts


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-pipeline")
        assert docs.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids"]
    assert 0 < rows.count()
