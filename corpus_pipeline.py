"""The corpus pipeline: toxicity, language, near duplicates, mix, tokens.

Every stage works on all its predecessor kept. The first four return the columns of ``documents``;
the last returns token ids. ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm import bpe, langid, mixing, simhash, toxicity
from mendframe.llm.common import table
from mendframe.session import materialise

#: A document scored so toxic goes.
TOXIC_FROM = 0.7
#: A document whose language is unknown goes, and so does one no language claims at all.
LANGUAGE_SCORE = 0.05
#: Near duplicates: words per shingle, bits in which linked fingerprints differ, Jaccard similarity that links too.
SHINGLE_WORDS, RADIUS, SIMILAR = 5, 2, 0.8
MIX_WEIGHTS, MIX_SEED = [1, 2, 3], 20
#: SQL cannot fit the classifiers nor merge tokens; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents below the toxic threshold; learned from the labels of these documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; rejects texts without letters."""
    return langid.keep_known(docs, langid.fit(docs), LANGUAGE_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates by SimHash, the one with the smallest id.

    Similar texts whose fingerprints differ more are joined exactly behind it.
    """
    return simhash.keep_one(docs, SHINGLE_WORDS, SIMILAR, RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents of the mix, repeated as often as they are in it."""
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_SEED)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
