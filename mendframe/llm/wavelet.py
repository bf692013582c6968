"""Token ids in wavelet-matrix files: one file per shard of documents, in ascending id order.

A file holds the ids of whole documents as bit planes, most significant bit first: each plane lists
that bit of all ids, then the ids are partitioned by it (zeros first) for the next plane. Ranks
before every block of a plane make access, counting and occurrence lookup possible from the planes
alone, reading only the blocks that a question touches; blocks are compressed one by one.

Layout (little endian): magic, header (ids, documents, planes, block bits), document ids, a byte
each telling which of them are null, document starts, per plane its number of zeros, then a
directory (offset, ones before) per block of each plane, then the blocks.

Tasks write files under names of their own attempt; only the files listed in the manifest, which
Spark commits as a table, belong to the result, so a task that is run again does no harm.

Defined results: a null text has only the end id; null ids come first; rows with one id are
ordered by the hash of their text; an empty table has no file.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from mendframe.session import materialise, scratch_path

MAGIC = b"WMX1"
#: Ids a shard gathers before it is closed (it ends with a whole document).
SHARD_TOKENS = 1 << 21
#: Bits of a block, the unit of compression and of stored ranks.
BLOCK_BITS = 1 << 17
#: Encoded words a worker keeps before it starts anew, and bytes of text whose words are held at a time.
MEMO_WORDS = 500_000
BATCH_BYTES = 1 << 22
#: Letters that neither normalisation nor splitting treats specially; punctuation that is cut off words.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Such letters and then ASCII symbols other than an apostrophe, which are never in one word.
TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
SPLIT_OFF = (b".", b",")
#: White space of ASCII as spaces, with and without its capitals as small letters.
SPACED = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
LOWERED = SPACED.lower()
#: The letters that a byte-level vocabulary spells bytes with; white space stays itself.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
SPELLED = "".join(" " if b == 32 else chr(b if b in SHOWN else 256 + HIDDEN.index(b)) for b in range(256))


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and ends every word with its own token.

    Works on UTF-8 bytes. Words between spaces are encoded once and kept; of some texts together only
    the distinct words are looked up, and positions among them say what each text is made of. Plain
    words go to the library many in one text, lower-cased and spelled as its vocabulary spells bytes,
    so that it only has to merge them, and are told apart by their end-of-word tokens; anything else
    goes to it by itself. A full stop or comma behind a word is cut off: it never belongs to the word of a
    letter or digit before it. Words that end in anything else are kept apart in ``closing``, and a
    text that has one is cut at its spaces alone.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.normalizer, self.merger.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.closing: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words."""
        if not words:
            return []
        spelled = charmap_decode(b" ".join(words).decode().lower().encode(), "strict", SPELLED)[0]
        ids = np.array(self.merger.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words):
            return self.whole([w.decode() for w in words])
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: Iterable[bytes]) -> None:
        """Adds the ids of new words."""
        memo, plain, other, tailed = self.memo, set(), [], {}
        for word in words:
            if word.isalpha():
                plain.add(word)
                continue
            text = word.decode()
            if PLAIN(text):
                plain.add(word)
            elif found := TAILED(text):
                tailed[word] = found[1].encode(), found[2]
            else:
                other.append(text)
        plain.update(core for core, _ in tailed.values() if core not in memo)
        cores = list(plain)
        memo |= zip(cores, self.plain(cores), strict=True)
        tails = list({tail for _, tail in tailed.values()})
        encoded = dict(zip(tails, self.whole(tails), strict=True))
        for word, (core, tail) in tailed.items():
            self.closing[word] = memo[core] + encoded[tail]
        for text, ids in zip(other, self.whole(other), strict=True):
            word = text.encode()
            if word in SPLIT_OFF or not open_ended(text):
                memo[word] = ids
            else:
                self.closing[word] = ids

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        held, size = [], 0
        for text in texts:
            text = text or b""
            if held and size + len(text) > BATCH_BYTES:
                yield from self._joined(held)
                held, size = [], 0
            held.append(text.translate(SPACED if b"<|" in text else LOWERED))
            size += len(text)
        yield from self._joined(held)

    def _joined(self, texts: list[bytes]) -> Iterator[bytes]:
        if len(self.memo) + len(self.closing) > MEMO_WORDS:
            self.memo.clear()
            self.closing.clear()
        found, closed = self._looked_up([punctuation_apart(t) for t in texts])
        # There a word ends in a character that punctuation behind it may belong to.
        whole = iter(self._looked_up([texts[i] for i in np.flatnonzero(closed)])[0])
        for ids, again in zip(found, closed.tolist(), strict=True):
            yield next(whole) if again else ids

    def _looked_up(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The ids of texts cut at single spaces, and which of them have a word of ``closing``."""
        if not texts:
            return [], np.zeros(0, bool)
        lists = pc.split_pattern(pa.array(texts, pa.large_binary()), " ")
        ends = lists.offsets.to_numpy()[1:].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.memo.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        self.learn([words[i] for i in gaps if words[i] not in self.closing])
        closing = np.zeros(len(words), bool)
        for i in gaps:
            # No word is kept in both.
            found[i] = self.memo.get(words[i])
            if found[i] is None:
                found[i], closing[i] = self.closing[words[i]], True
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        shift = (np.cumsum(sizes) - sizes)[at]
        sizes = sizes[at]
        stops = np.cumsum(sizes)
        shift -= stops - sizes
        data = memoryview(ids[np.repeat(shift, sizes) + np.arange(stops[-1])].tobytes())
        cuts = [0, *(4 * stops[ends - 1]).tolist()]
        closed = np.zeros(len(texts), bool)
        if closing.any():
            closed[np.searchsorted(ends, np.flatnonzero(closing[at]), side="right")] = True
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], closed


def open_ended(word: str) -> bool:
    """Whether a word, normalised as the tokenizer does, ends in neither a letter nor a digit."""
    return bool(word) and not normalize("NFC", word[-1]).lower()[-1].isalnum()


def punctuation_apart(text: bytes) -> bytes:
    """The text with a space before every full stop or comma that ends a word.

    Where two such marks follow each other the text stays as it is, as they may be one word.
    """
    apart = (text + b" ").replace(b". ", b" . ").replace(b", ", b" , ")
    if any(pair in apart for pair in (b". .", b", ,", b". ,", b", .")):
        return text
    return apart


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so later tasks find the words of earlier ones."""
    return WordEncoder(path)


def build(ids: np.ndarray, doc_ids: list, starts: list[int]) -> bytes:
    """The file of one shard."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    rest = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    codec, zeros, directory, blocks, at = pa.Codec("zstd", 1), [], [], [], 0
    for plane in range(planes - 1, -1, -1):
        bits = (rest >> rest.dtype.type(plane)) & rest.dtype.type(1) != 0
        packed, before = np.packbits(bits), 0
        for start in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[start : start + BLOCK_BITS // 8].tobytes()
            small = codec.compress(raw, asbytes=True)
            block = b"\1" + small if len(small) < len(raw) else b"\0" + raw
            directory.append((at, before))
            blocks.append(block)
            at += len(block)
            before += int.from_bytes(raw, "big").bit_count()
        directory.append((at, before))
        zeros.append(len(rest) - before)
        rest = np.concatenate([rest.take(np.flatnonzero(~bits)), rest.take(np.flatnonzero(bits))])
    header = MAGIC + struct.pack("<4Q", len(ids), len(doc_ids), planes, BLOCK_BITS)
    return b"".join(
        [
            header,
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(starts, "<u8").tobytes(),
            np.array(zeros, "<u8").tobytes(),
            np.array(directory, "<u8").tobytes(),
            *blocks,
        ]
    )


class WaveletFile:
    """Questions to one shard file; ``opened`` is a seekable file that only the needed blocks are read from."""

    def __init__(self, opened):
        self.file = opened
        if self._read(0, 4) != MAGIC:
            raise ValueError("no wavelet-matrix file")
        self.n, n_docs, self.planes, self.block = struct.unpack("<4Q", self._read(4, 32))
        at = 36
        ids, at = np.frombuffer(self._read(at, 8 * n_docs), "<i8"), at + 8 * n_docs
        null, at = self._read(at, n_docs), at + n_docs
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.starts, at = np.frombuffer(self._read(at, 8 * n_docs), "<u8").astype(np.int64), at + 8 * n_docs
        self.zeros, at = np.frombuffer(self._read(at, 8 * self.planes), "<u8").astype(np.int64).tolist(), at + 8 * self.planes
        self.blocks = -(-self.n // self.block)
        entries = (self.blocks + 1) * self.planes
        self.directory = np.frombuffer(self._read(at, 16 * entries), "<u8").astype(np.int64).reshape(self.planes, -1, 2)
        self.data = at + 16 * entries
        self.codec = pa.Codec("zstd")
        self.bits = lru_cache(maxsize=64)(self._bits)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _packed(self, plane: int, block: int) -> bytes:
        start, end = self.directory[plane, block, 0], self.directory[plane, block + 1, 0]
        stored = self._read(int(self.data + start), int(end - start))
        size = (min(self.block, self.n - block * self.block) + 7) // 8
        return stored[1:] if stored[:1] == b"\0" else self.codec.decompress(stored[1:], size, asbytes=True)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        count = min(self.block, self.n - block * self.block)
        return np.unpackbits(np.frombuffer(self._packed(plane, block), np.uint8), count=count)

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a position."""
        block, inside = divmod(at, self.block)
        ones = int(self.directory[plane, block, 1])
        return ones + int(np.count_nonzero(self.bits(plane, block)[:inside])) if inside else ones

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            block, inside = divmod(at, self.block)
            bit = int(self.bits(plane, block)[inside])
            ones = self._ones(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _narrow(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id within a range stand after the last plane."""
        for plane in range(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if token >> (self.planes - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range of positions."""
        if token >> self.planes:
            return 0
        a, b = self._narrow(token, start, self.n if end is None else end)
        return b - a

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Position of the k-th one (or zero) of a plane."""
        ones = self.directory[plane, :, 1]
        before = ones if bit else np.minimum(np.arange(len(ones)) * self.block, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * self.block + int(np.flatnonzero(self.bits(plane, block) == bit)[k - int(before[block])])

    def occurrence(self, token: int, k: int) -> int | None:
        """Position of the k-th occurrence (from 0) of an id, or None."""
        if not 0 <= k < self.count(token):
            return None
        at = self._narrow(token, 0, self.n)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._select(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the partitions are undone from the last plane up."""
        dtype = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, dtype)
        for plane in range(self.planes - 1, -1, -1):
            packed = b"".join(self._packed(plane, b) for b in range(self.blocks))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            before = np.empty(self.n, dtype)
            before[np.flatnonzero(~bits)] = out[: self.zeros[plane]]
            before[np.flatnonzero(bits)] = out[self.zeros[plane] :] | dtype(1 << (self.planes - 1 - plane))
            out = before
        return out.astype("<u4")


def opened(path: str):
    """A seekable file of any store that pyarrow knows."""
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes all texts and writes the files; the manifest has ``part, shard, path, documents, tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, end = word_encoder(tokenizer), TaskContext.get(), struct.pack("<I", end_id)
        store, name = fs.FileSystem.from_uri(folder)
        held, doc_ids, starts, size, shard = [], [], [], 0, 0

        def close():
            path = f"part-{task.partitionId():06d}-{shard:06d}-{task.taskAttemptId()}.wmx"
            with store.open_output_stream(f"{name}/{path}") as out:
                out.write(build(np.frombuffer(b"".join(held), "<u4"), doc_ids, starts))
            row = {"part": [task.partitionId()], "shard": [shard], "path": [f"{folder}/{path}"], "documents": [len(doc_ids)], "tokens": [size]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            for doc_id, data in zip(ids, encoder.encode(t.as_py() for t in texts), strict=True):
                if size >= shard_tokens:
                    yield close()
                    held, doc_ids, starts, size, shard = [], [], [], 0, shard + 1
                doc_ids.append(doc_id)
                starts.append(size)
                held.append(data + end)
                size += len(data) // 4 + 1
        if doc_ids:
            yield close()

    if not urlparse(folder).scheme:
        folder = f"file://{folder}"
    store, name = fs.FileSystem.from_uri(folder)
    store.create_dir(name, recursive=True)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    return materialise(rows.mapInArrow(run, "part int, shard int, path string, documents long, tokens long"), "wavelet-manifest")


def read_shards(manifest: DataFrame, shards_per_task: int = 4) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with opened(path) as file:
                    shard = WaveletFile(file)
                    data = memoryview(shard.ids().tobytes())
                ends = np.append(shard.starts[1:], shard.n).tolist()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(shard.starts.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts + first), pa.array(ends - shard.starts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "first")
    tasks = max(1, manifest.count() // shards_per_task)
    return placed.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files below the shared folder and returns their manifest."""
    return write_shards(docs, tokenizer, scratch_path(docs.sparkSession, "wavelet"), end_id)
