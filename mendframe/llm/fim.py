"""Fill-in-middle documents: three spans of whole tokens, cut by a learned rank index.

A text is cut into tokens (white space and the word behind it, or white space alone). The byte
offsets of all token boundaries are kept in a piecewise-linear learned index: segments are fitted
so that every prediction ``rank -> offset`` is within ``ERROR`` bytes, and a residual of one byte
per boundary corrects it exactly. A cut at a rank is one prediction and one correction.

Defined results: a null text is empty; an empty text has no tokens and stays plain, as does one
that holds a sentinel; a null id draws as an empty number; repeated rows keep a row each and are
alike; texts are cut whole, however long; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
#: How far a segment's prediction may be off, in bytes: residuals fit into one byte.
ERROR = 64
#: Boundaries that a segment looks at first; twice as many every time they all fit.
FIRST_WINDOW = 256
#: Rows that a task holds at a time.
BATCH_ROWS = 256

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets of all token boundaries of a UTF-8 text, 0 and its end included."""
    if not len(data):
        return np.zeros(1, np.int64)
    white = WHITE[data]
    inner = np.flatnonzero(white[1:] > white[:-1]) + 1
    return np.concatenate([[0], inner, [len(data)]])


class RankIndex:
    """``index[rank]`` is the offset of a boundary: segments of bounded error and residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error <= 126:
            raise ValueError("residuals are single bytes: error must be from 1 to 126")
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            length, slope = longest_segment(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at += length
        self.starts, self.slopes = np.array(starts), np.array(slopes)
        self.bases = offsets[self.starts]
        self.residuals = (offsets - self._predicted(np.arange(len(offsets)))).astype(np.int8)

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, "right") - 1
        rise = np.floor(self.slopes[segment] * (ranks - self.starts[segment]) + 0.5)
        return self.bases[segment] + rise.astype(np.int64)

    def __len__(self) -> int:
        return len(self.residuals)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        return self._predicted(ranks) + self.residuals[ranks]


def longest_segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """Boundaries from ``at`` on that one line through the first keeps within ``error``, and its slope.

    The slopes that suit all boundaries so far form an interval, which narrows until it is empty.
    """
    low, high, done, window = -np.inf, np.inf, at + 1, FIRST_WINDOW
    while done < len(offsets):
        run = np.arange(done, min(done + window, len(offsets)))
        rise, run = offsets[run] - offsets[at], run - at
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        fits = int(np.searchsorted(lows > highs, True))
        if fits:
            low, high, done = lows[fits - 1], highs[fits - 1], done + fits
        if fits < len(run):
            break
        window *= 2
    return done - at, (low + high) / 2 if done > at + 1 else 0.0


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four independent 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def rearranged(text: bytes, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    data = np.frombuffer(text, np.uint8)
    offsets = boundaries(data)
    n = len(offsets) - 1
    first, second, formed, ordered = draws(doc_id, seed)
    if not text or formed % 100 >= fim_percent or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    ranks = np.sort(np.array([first % (n + 1), second % (n + 1)]))
    a, b = RankIndex(offsets)[ranks].tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    spm = ordered % 100 < spm_percent
    output = b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])
    return n, "spm" if spm else "psm", code_points(data[:a]), code_points(data[a:b]), output


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``fim_percent`` of the documents are rearranged, ``spm_percent`` of these suffix first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                rows = [
                    rearranged(t or b"", i, seed, fim_percent, spm_percent)
                    for i, t in zip(part.column("doc_id").to_pylist(), texts, strict=True)
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from.

    No text that is rearranged holds a sentinel, and none arises where two parts meet, so each
    sentinel of an output stands where it was put.
    """
    def between(start: str, end: str) -> Column:
        return F.split_part(F.split_part(output, F.lit(start), F.lit(2)), F.lit(end), F.lit(1))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
