"""Codecs, counts and token files against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from mendframe.llm import bpe, queries, tokencount, wavelet

BYTE, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
BITS = [
    "", " ", "  ", "\n", " \n", "\t", "the ", " the", "there", "It's", "we'll", "DON'T", "a.", "x!", ",", ". ", ", ", "..", "é", "e\u0301",
    "\u0301", "%%%", "12", " 3.5", "<|endoftext|>", "<|startoftext|>", "<unk>", "<s>", "日本", "😀", "\x1c", "\x85", "\xa0", "\u3000",
    "ΑΣ", "İ", "ª", "²", "▁", "ற", "aaaa", "ing", "\x00", "ẞ", "Ÿ", "\u0958",
]


def samples(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    made = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)]
    long = ["a" * 20_000, " " * 5000, "ab" * 9000, "word " * 4000, "".join(rng.choices(BITS, k=4000)), "\n" * 3000 + "x"]
    return [None, "", *made, *long, *made[:5]]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def library(path: str):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("lexicon", [0, 40])
def test_codec_equals_library(spark, lexicon):
    texts, want = samples(250, 1), library(BYTE)
    got = bpe.round_trip(docs_of(spark, texts), BYTE, queries.id_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", lexicon)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = want.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = want.decode(ids, skip_special_tokens=False)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_returns_ids(spark):
    texts, want = samples(20, 2), library(BYTE)
    rows = bpe.encode(docs_of(spark, texts), BYTE).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {
        i: want.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)
    }
    assert bpe.encode(docs_of(spark, []), BYTE).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({w.encode() for w in "walking talking walked talked walks talks a an ant été".split()})
    outputs = {w: (len(w), *w[-3:], 7) if w.endswith(b"ing") else tuple(w[:2]) for w in words}
    path = tmp_path / "x.mat"
    path.write_bytes(bpe.compile_lexicon((w, outputs[w]) for w in words))
    lexicon = bpe.Lexicon(str(path))
    probes = [*words, b"", b"w", b"walk", b"walkings", b"zebra", b"an\x00"]
    for word in probes:
        found = lexicon.find(word)
        assert found == (list(outputs[word]) if word in outputs else None)
    together = lexicon.find_all(probes)
    assert {i: np.frombuffer(b, "<u4").tolist() for i, b in together.items()} == {
        i: list(outputs[w]) for i, w in enumerate(probes) if w in outputs
    }
    # Shared endings: fewer states than the trie of the words has.
    trie = {w[:n] for w in words for n in range(len(w) + 1)}
    assert len(lexicon.final) < len(trie)
    empty = tmp_path / "e.mat"
    empty.write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(empty)).find(b"a") is None
    assert bpe.Lexicon(str(empty)).find_all([b"a", b""]) == {}


def test_frequent_words_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 3) for i in range(60)], "word string, n long")
    found = bpe.frequent_words(counts, 10)
    assert 0 < len(found) <= 10
    assert set(found) <= {f"w{i}" for i in range(45, 60)}
    assert bpe.frequent_words(counts.limit(0), 10) == []


def test_word_encoder_equals_library():
    texts, want, encoder = samples(600, 3), library(WORDS), wavelet.WordEncoder(WORDS)
    for text, data in zip(texts, encoder.encode(t if t is None else t.encode() for t in texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == want.encode(text or "", add_special_tokens=False).ids, text


def test_word_encoder_looks_up_distinct_words_and_leaves_letters_to_the_merges(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    letters = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    texts = [" ".join(letters[i : i + 9] for i in range(len(letters))), "Été the, thing. " * 2000, "the!! thing!!. , . ÅNGSTRÖM ", "one <|x SPACED Été"]
    want, encoder = library(WORDS), wavelet.WordEncoder(WORDS)
    encoder.memo = Counted()
    found = list(encoder.encode(t.encode() for t in texts))
    assert [np.frombuffer(d, "<u4").tolist() for d in found] == [want.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counted.asked < 4 * len({w for t in texts for w in t.split()})
    # The whole tokenizer is asked for other words alone.
    monkeypatch.setattr(encoder, "tokenizer", None)
    want_ids = want.encode("Ünder Çaväl ÿß", add_special_tokens=False).ids
    assert np.frombuffer(b"".join(encoder.encode(["Ünder Çaväl ÿß".encode()])), "<u4").tolist() == want_ids


def test_wavelet_files(spark):
    texts, want = samples(120, 4), library(WORDS)
    docs = docs_of(spark, texts).repartition(5)
    manifest = wavelet.write_shards(docs, WORDS, wavelet.scratch_path(spark, "wavelet-test"), 1, shard_tokens=300)
    assert manifest.count() > 3
    rows = sorted(wavelet.read_shards(manifest).collect())
    start = 0
    for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
        ids = np.array([*want.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.read_shards(wavelet.store_tokens(docs.limit(0), WORDS)).count() == 0


def test_wavelet_ids_may_be_null_or_repeated(spark):
    docs = spark.createDataFrame([(None, "b"), (3, "a b"), (3, "a b"), (None, None), (1, "c")], "doc_id long, text string")
    rows = wavelet.read_shards(wavelet.store_tokens(docs, WORDS)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 3, 3]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()


@pytest.mark.parametrize("block", [64, 1 << 17])
@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 20])
def test_wavelet_questions(monkeypatch, block, top):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(top)
    ids = np.minimum(rng.zipf(1.3, 3000), top - 1 if top > 1 else 0).astype("<u4")
    shard = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, [5, None], [0, 10])))
    assert shard.doc_ids == [5, None]
    assert (shard.ids() == ids).all()
    for at in (0, 1, 63, 64, 65, 1500, 2999):
        assert shard.access(at) == ids[at]
    for token in {0, 1, 2, 7, int(ids[17]), int(ids[2999]), 49_999, 1 << 21}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 100, 2000) == ((places >= 100) & (places < 2000)).sum()
        for k in {0, len(places) // 2, len(places) - 1, len(places)}:
            assert shard.occurrence(token, k) == (places[k] if 0 <= k < len(places) else None)
    with pytest.raises(IndexError):
        shard.access(3000)


def test_counts_equal_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    want = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))], model.unk_id(), True))
    texts = [t for t in samples(400, 5) if t is None or len(t) < 6000]
    rows = {r["doc_id"]: r for r in tokencount.token_counts(docs_of(spark, texts), PIECES).collect()}
    for i, text in enumerate(texts):
        marked = tokencount.SPACE + text.replace(" ", tokencount.SPACE) if text else ""
        assert rows[i]["n_tokens"] == len(want.encode(marked, add_special_tokens=False).ids), text


def test_counts_break_ties_like_library():
    rng = random.Random(8)
    for _ in range(60):
        pieces = [("?", 0.0)] + [(p, float(-rng.randint(1, 3))) for p in {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(9)}]
        mine, want = tokencount.Unigram(pieces, 0), Tokenizer(models.Unigram(pieces, 0, False))
        for _ in range(20):
            text = "".join(rng.choices("ab ", k=rng.randint(1, 12)))
            if all(c in {p for p, _ in pieces} for c in "ab▁"):
                marked = "▁" + text.replace(" ", "▁")
                assert mine.count(text)[0] == len(want.encode(marked, add_special_tokens=False).ids)


def test_counts_of_long_texts_and_of_nothing(spark):
    """Whole texts of tens of thousands of characters; scores are sums of the vocabulary's."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(len(model))}
    want = Tokenizer(models.Unigram([(p, s) for p, s in score.items()], model.unk_id(), True))
    texts = ["word " * 8000, "zażółć gęślą jaźń, " * 900, None, ""]
    rows = {r["doc_id"]: r for r in tokencount.token_counts(docs_of(spark, texts), PIECES).collect()}
    for i, text in enumerate(texts):
        pieces = want.encode(tokencount.SPACE + text.replace(" ", tokencount.SPACE), add_special_tokens=False).tokens if text else []
        assert rows[i]["n_tokens"] == len(pieces)
        if all(p in score and not p.startswith("<0x") for p in pieces):
            assert rows[i]["score"] == pytest.approx(sum(score[p] for p in pieces))
    assert tokencount.token_counts(docs_of(spark, []), PIECES).count() == 0


def test_round_trip_of_no_texts(spark):
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    assert bpe.round_trip(docs_of(spark, []), BYTE, queries.id_digests, kinds).count() == 0
