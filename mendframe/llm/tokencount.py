"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

Vocabulary matches ending at each character come from an Aho-Corasick automaton, longest first.
Dynamic programming keeps, per position, the best score and the number of pieces on its path;
the path itself is never stored. Tie and fallback rules are those of the unigram tokenizer: of
equal scores the one that starts first wins, a character without a piece of its own may be
unknown at ten below the lowest score, and an unknown character counts one piece per UTF-8 byte.

A text is cut at its spaces where the vocabulary allows no piece to reach over one, so every
distinct chunk is scored once per worker; scores are whole numbers, so sums are exact.

Defined results: null and empty texts have no pieces and score 0; repeated rows keep a row each;
whole texts are counted, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

#: What stands for a space.
SPACE = "▁"
#: Score of an unknown character below the lowest of the vocabulary (fixed value).
UNKNOWN_PENALTY = 10.0
#: Chunks a worker keeps before it starts anew.
MEMO_CHUNKS = 600_000


class Unigram:
    """A vocabulary of pieces with scores; byte pieces spell unknown characters."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        self.unknown = pieces[unknown][0]
        self.score_unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known = {p for p, _ in pieces}
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self.memo: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        if self.unknown in text:
            return self.traced(text)
        score, pieces, at, single = [0.0] * (len(text) + 1), [0] * (len(text) + 1), 0, False
        found = None

        def close(end: int) -> None:
            """The character before ``end`` may be unknown if it is no piece; ends its position."""
            nonlocal found, single
            if not single:
                lone = score[end - 1] + self.score_unknown
                if found is None or lone > score[end]:
                    score[end] = lone
                    pieces[end] = pieces[end - 1] + len(text[end - 1].encode())
            found, single = None, False

        for last, (length, value) in self.matches.iter(text):
            while at <= last - 1:
                at += 1
                close(at)
            end = last + 1
            total = score[end - length] + value
            if found is None or total > score[end]:
                score[end], pieces[end], found = total, pieces[end - length] + 1, length
            single = single or length == 1
        while at < len(text):
            at += 1
            close(at)
        return pieces[-1], score[-1]

    def traced(self, text: str) -> tuple[int, float]:
        """The same with the path: unknown stretches are joined before they are spelled in bytes."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for last, match in self.matches.iter(text):
            ends[last + 1].append(match)
        score, back = [0.0], [(0, False)]
        for end in range(1, len(text) + 1):
            top = None
            for length, value in ends[end]:
                total = score[end - length] + value
                if top is None or total > top[0]:
                    top = total, length, text[end - length : end] == self.unknown
            if not any(length == 1 for length, _ in ends[end]):
                lone = score[end - 1] + self.score_unknown
                if top is None or lone > top[0]:
                    top = lone, 1, True
            score.append(top[0])
            back.append(top[1:])
        pieces, end, stretch = 0, len(text), ""

        def spelled(s: str) -> int:
            return 0 if not s else 1 if s in self.known else len(s.encode())

        while end:
            length, unknown = back[end]
            if unknown:
                stretch = text[end - length : end] + stretch
            else:
                pieces, stretch = pieces + 1 + spelled(stretch), ""
            end -= length
        return pieces + spelled(stretch), score[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text, spaces marked and one put in front."""
        if not text:
            return 0, 0.0
        chunks = text.replace(SPACE, " ").split(" ")
        if not self.cuts:
            return self.best(SPACE + SPACE.join(chunks))
        segments = self.segments(SPACE + SPACE.join(chunks)) if "" in chunks else [SPACE + c for c in chunks]
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
        memo = self.memo
        for segment in set(segments).difference(memo):
            memo[segment] = self.best(segment)
        found = list(map(memo.__getitem__, segments))
        return sum([n for n, _ in found]), sum([s for _, s in found])


@lru_cache(maxsize=1)
def from_model(path: str) -> Unigram:
    """Pieces and scores of a sentencepiece file, once per worker."""
    model = SentencePieceProcessor(model_file=path)
    return Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))], model.unk_id())


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, score`` of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = from_model(model)
        for batch in batches:
            counts, scores = columns(map(vocab.count, (t.as_py() for t in batch.column("text"))))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")


def columns(rows: Iterable[tuple[int, float]]) -> tuple[list[int], list[float]]:
    rows = list(rows)
    return [n for n, _ in rows], [s for _, s in rows]
