"""Fill-in-middle cuts and piece encoding against plain code and the library."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from mendframe.llm import fim, piece, queries
from test_tokens import docs_of, samples

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_library(spark, library):
    texts = [*samples(300, 4), "     x", "a" + " " * 37 + "b", "x².", "²", "-" * 4000, "▁▁ ▁", "ha" * 3000]
    names, types = ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"]
    rows = piece.round_trip(docs_of(spark, texts), PIECES, queries.spaced_digests, names, types).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_then_decode(spark, library):
    texts = samples(40, 5)
    encoded = piece.encode(docs_of(spark, texts), PIECES)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode(t or "", add_eos=True) for i, t in enumerate(texts)}
    decoded = {r["doc_id"]: r["text"] for r in piece.decode(encoded, PIECES).collect()}
    assert decoded == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert piece.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECES).first()["text"] is None


def test_no_pieces_of_empty_table(spark):
    empty = docs_of(spark, [])
    assert piece.encode(empty, PIECES).collect() == [] and fim.fill_in_middle(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdehistnor  .,\n-1▁é²日\x00"), max_size=60))
def test_any_text_equals_library(library, text):
    assert piece.codec(PIECES)[0].encode(text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 270)), max_size=8))
def test_any_ids_decode_as_library(library, ids):
    assert piece.codec(PIECES)[0].decode(ids) == library.decode(ids)


def test_backtracking_finds_merge_results():
    """A small vocabulary with equal scores and dead ends, against merging itself."""
    scores = {"ab": -3.0, "bc": -1.0, "abc": -4.0, "cd": -2.0, "bcd": -6.0, "aa": -9.0, "aaa": -9.0, "a": -20.0, "b": -21.0, "c": -22.0, "d": -23.0, "abcd": -0.5}
    ids = {t: i + 1 for i, t in enumerate(scores)}
    codec = piece.PieceCodec(scores, ids, [], 0, set())
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("abcdx", k=rng.randint(1, 12)))
        want = [ids.get(p, 0) for p in codec.merged(text)]
        assert list(codec.word(text)) == want, text


def test_models_that_change_texts_are_refused(monkeypatch, library):
    monkeypatch.setattr(SentencePieceProcessor, "normalize", lambda self, text: text)
    piece.codec.cache_clear()
    with pytest.raises(ValueError):
        piece.codec(PIECES)
    monkeypatch.undo()
    piece.codec.cache_clear()


def plain(text, doc_id, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_plain_code_and_restore(spark):
    texts = [*samples(200, 6), "a <P> b", "<M>", "<<S", "<P", "P>", "one", " \t ", "  lead and tail \n", "wörter " * 9000]
    df = docs_of(spark, texts).unionByName(spark.createDataFrame([(None, "no id at all", 1)], "doc_id long, text string, ids int"))
    found = fim.fill_in_middle(df)
    rows = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 1 and {r["form"] for r in rows} == {"plain", "spm", "psm"}
    for r in rows:
        text = "no id at all" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(text, r["doc_id"])
        assert r["back"] == text


def test_texts_that_end_in_parts_of_sentinels(spark):
    """Where parts meet no sentinel arises, so every output is restored."""
    rng = random.Random(2)
    texts = ["".join(rng.choices(["<", ">", "P", "S", "M", " ", "<P", "S>"], k=12)) for _ in range(400)]
    found = fim.fill_in_middle(docs_of(spark, texts), fim_percent=100, spm_percent=50)
    rows = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == texts[r["doc_id"]] for r in rows) and len({r["form"] for r in rows}) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 12), st.integers(1, 100_000)), max_size=700), st.sampled_from([1, 8, 64, 126]))
def test_rank_index_is_exact(gaps, error):
    offsets = np.concatenate([[0], np.cumsum(np.array(gaps, np.int64))]).astype(np.int64)
    index = fim.RankIndex(offsets, error)
    assert (index[np.arange(len(offsets))] == offsets).all()
    assert len(index) == len(offsets) and np.abs(index.residuals.astype(int)).max() <= error + 1


def test_even_boundaries_need_one_segment():
    index = fim.RankIndex(np.arange(0, 60_000, 6))
    assert len(index.starts) == 1 and not index.residuals.any()
