"""Exact encoding and decoding with a merge-type piece vocabulary, by backtracking.

The result of all merges, best score first and leftmost among equals, is the one sequence of
pieces in which every two neighbours are compatible: merging their joint text gives just these
two. So the encoder never merges a text. An Aho-Corasick pass tells the longest piece from every
position; the encoder takes it, or the next shorter one that is compatible with the piece before,
and steps back where none is. A bitfield marks positions that led nowhere, so none is tried twice.
Compatibility is found by re-merging the two pieces, once per pair and worker.

A text is cut where no piece holds the characters on both sides, so distinct words are encoded once
per worker; the cut is exact, and a text without such places is encoded as a whole.

Models must leave texts as they are but for spaces (identity normalisation with a space put in
front); others are refused. Defined results: a null text is empty and has only the end id; an
unknown character is spelled by its bytes; repeated rows keep a row each; texts are encoded whole,
however long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

#: What stands for a space.
SPACE = "▁"
#: How the library shows the unknown piece, and bytes that are no character (fixed values).
UNKNOWN_SURFACE, NO_CHARACTER = " ⁇ ", "�"
#: Below every score.
NEVER = float("-inf")
#: Words and pairs of pieces that a worker keeps before it starts anew.
MEMO_WORDS, MEMO_PAIRS = 800_000, 1_000_000
#: Rows that a task holds at a time.
BATCH_ROWS = 256
#: Marks that end a word, looked at as places to cut.
MARKS = "\n\t\r.,;:!?"


class PieceCodec:
    """Encoder and decoder of one vocabulary; ``scores`` holds the pieces that merges can make."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], unknown: int, controls: set[int]):
        self.scores, self.byte_ids, self.unknown = scores, byte_ids, unknown
        neighbours = {pair for piece in scores for pair in zip(piece, piece[1:], strict=False)}
        # Every character that merges may start from is a piece here, known to the vocabulary or not.
        texts = dict.fromkeys([*(c for piece in scores for c in piece), *(p for p in scores if self.merged(p) == [p])])
        self.texts = list(texts)
        self.lengths = [len(t) for t in self.texts]
        number = {t: i for i, t in enumerate(self.texts)}
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.texts]
        self.spelled = [(ids[t],) if t in ids else self.bytes_of(t) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for text, i in number.items():
            self.automaton.add_word(text, i)
        if number:
            self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(self.cutting(neighbours)).findall
        self.raw = {i: t.replace(SPACE, " ").encode() for t, i in ids.items()}
        self.raw |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.raw |= dict.fromkeys(controls, b"") | {unknown: UNKNOWN_SURFACE.encode()}
        self.controls, self.of_byte = controls, {i: b for b, i in enumerate(byte_ids)}

    def cutting(self, neighbours: set[tuple[str, str]]) -> str:
        """Pattern of the units of a text whose spaces are marked: no piece reaches from one to the next."""
        if any(b == SPACE != a for a, b in neighbours):
            return r"(?s).+"
        # No piece joins a mark to a letter or digit, but for these.
        joined = {c for pair in neighbours if not set(pair).isdisjoint(MARKS) for c in pair if c.isalnum()}
        letters = f"[^\\W_{re.escape(''.join(sorted(joined)))}]"
        marks = f"[{re.escape(MARKS)}]"
        apart = f"{SPACE}*{letters}+(?={marks}|{SPACE}|\\Z)|{marks}+(?={letters}|{SPACE}|\\Z)"
        return f"{apart}|{SPACE}*[^{SPACE}]+|{SPACE}+"

    def bytes_of(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode()) if self.byte_ids else (self.unknown,) * len(text)

    def merged(self, text: str, kept: int = 0) -> list[str] | None:
        """The parts of a short text after all merges; None once one reaches over position ``kept``."""
        score_of, parts = self.scores.get, list(text)
        scores = [score_of(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if kept and kept not in accumulate(map(len, parts)):
                return None
            if at:
                scores[at - 1] = score_of(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score_of(parts[at] + parts[at + 1], NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            x, y = self.texts[a], self.texts[b]
            found = self.pairs[a, b] = self.merged(x + y, len(x)) == [x, y]
        return found

    def pieces(self, text: str) -> list[int]:
        """Numbers of the pieces of a text, -1 for a character that no piece holds."""
        longest = [-1] * (len(text) + 1)
        lengths, shorter, known = self.lengths, self.shorter, self.pairs.get
        for end, piece in self.automaton.iter(text) if self.texts else ():
            longest[end + 1 - lengths[piece]] = piece  # ends only grow, so the longest comes last
        failed, stuck = bytearray(len(text) // 8 + 1), False
        found: list[int] = []
        at, last, piece = 0, -1, longest[0]
        while at < len(text):
            if longest[at] < 0:
                at, last = at + 1, -1
                found.append(-1)
                piece = longest[at]
                continue
            while piece >= 0:
                end = at + lengths[piece]
                if not (stuck and failed[end >> 3] >> (end & 7) & 1):
                    if last < 0:
                        break
                    fits = known((last, piece))
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            else:
                if last < 0:
                    raise ValueError("no sequence of compatible pieces")
                failed[at >> 3] |= 1 << (at & 7)
                stuck = True
                piece = found.pop()  # tried again at its start, with this end ruled out
                at -= lengths[piece]
                last = found[-1] if found else -1
                continue
            found.append(piece)
            at, last, piece = end, piece, longest[end]
        return found

    def word(self, text: str) -> tuple[int, ...]:
        """The ids of a unit of text."""
        found = self.pieces(text)
        if -1 not in found:
            return tuple(chain.from_iterable([self.spelled[p] for p in found]))
        at, ids = 0, []
        for piece in found:
            ids.append(self.spelled[piece] if piece >= 0 else self.bytes_of(text[at]))
            at += self.lengths[piece] if piece >= 0 else 1
        return tuple(chain.from_iterable(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without an end id."""
        if not text:
            return []
        memo = self.memo
        units = self.cut(SPACE + text.replace(" ", SPACE))
        found = list(map(memo.get, units))
        if None in found:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    unit = units[i]
                    ids = memo.get(unit)
                    if ids is None:
                        ids = memo[unit] = self.word(unit)
                    found[i] = ids
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, the space in front taken off."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode() if self.controls.isdisjoint(ids[:-1]) else None
        except UnicodeDecodeError:
            text = None
        if text is None:
            text = "".join(self._runs(ids))
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if first is not None and first not in self.of_byte and first != self.unknown and text[:1] == " " else text

    def _runs(self, ids: list[int]) -> Iterator[str]:
        """Pieces as text; runs of bytes character by character, what is none shown byte by byte."""
        run = bytearray()
        for i in [*ids, None]:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            while run:
                for width in range(1, 5):
                    try:
                        yield run[:width].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    width = 1
                    yield NO_CHARACTER
                del run[:width]
            if i is not None:
                yield self.raw[i].decode()


@lru_cache(maxsize=2)
def codec(model: str) -> tuple[PieceCodec, int]:
    """The codec of a model file and its end id; one per worker process."""
    p = SentencePieceProcessor(model_file=model)
    probe = " a\tＡ  ﬁ "
    if p.normalize(probe) != (SPACE + probe).replace(" ", SPACE) or not p.encode("a"):
        raise ValueError(f"{model} changes texts before it encodes them")
    size = range(p.get_piece_size())
    plain = [i for i in size if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
    if any(p.is_unused(i) for i in plain):
        raise ValueError(f"{model} has unused pieces")
    ids = {p.id_to_piece(i): i for i in plain}
    byte_ids = [i for i in size if p.is_byte(i)]
    scores = {t: p.get_score(i) for t, i in ids.items()}
    return PieceCodec(scores, ids, byte_ids, p.unk_id(), {i for i in size if p.is_control(i)}), p.eos_id()


def _mapped(docs: DataFrame, column: str, row: Callable[[object], tuple], names: list[str], types: list[str]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                rows = zip(*(row(x) for x in part.column(column).to_pylist()), strict=True)
                columns = [pa.array(c, known[t]) for c, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    schema = ", ".join(f"{n} {t}" for n, t in zip(["doc_id", *names], [kind, *types], strict=True))
    return docs.select("doc_id", column).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every text, the end id last."""

    def row(text: str | None) -> tuple:
        found, end = codec(model)
        return ([*found.encode(text or ""), end],)

    return _mapped(docs, "text", row, ["ids"], ["array<int>"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""
    return _mapped(encoded, "ids", lambda ids: (None if ids is None else codec(model)[0].decode(ids),), ["text"], ["string"])


def round_trip(docs: DataFrame, model: str, digest: Callable[[list[int], str], Iterable], names: list[str], types: list[str]) -> DataFrame:
    """``doc_id`` and what ``digest`` makes of the ids of every text and of the text decoded from them."""

    def row(text: str | None) -> tuple:
        found, end = codec(model)
        ids = [*found.encode(text or ""), end]
        return tuple(digest(ids, found.decode(ids)))

    return _mapped(docs, "text", row, names, types)
