"""Byte-level BPE: frequent words from a minimal acyclic transducer, all others merged exactly.

The words of the corpus are counted, the frequent ones encoded and compiled into one automaton
whose states share prefixes and suffixes and whose arcs emit token ids. The compiled file is
handed to every executor and memory-mapped there. A word that the automaton does not accept is
merged by rank: all unseen words of a batch at once, lowest rank first, leftmost first.

The lexicon only saves work: ids are the same for any lexicon, the empty one included.

Defined results: a null text is encoded as the empty text, which has no ids; special tokens found
in a text become their ids; repeated rows keep a row each; very long words are merged like any
other; an empty table gives an empty result and an empty lexicon.
"""

from __future__ import annotations

import json
import mmap
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm.common import giving_back
from mendframe.session import materialise, scratch_path

#: Words of the corpus that the automaton holds, at most.
LEXICON_WORDS = 1 << 15
#: Longer words (in characters) are not considered for it.
LEXICON_CHARS = 32
#: Encoded chunks that a worker, and counted ones that a task keeps before it starts anew.
MEMO_WORDS = 600_000
#: Counted chunks that are split into words at a time.
COUNTED_CHUNKS = 1 << 16
#: Characters whose words are held at a time; a longer text is held alone.
BATCH_CHARS = 1 << 20
#: Fixed value: how the byte-level scheme splits text into words.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Punctuation that is a word by itself behind letters.
ENDINGS = tuple(".,;:!?")
NO_RANK = np.int64(1 << 40)
MAGIC = b"MAT1"


def byte_letters() -> dict[str, int]:
    """The scheme's printable letter of each byte: itself if printable, else from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Position of 64-bit keys in a fixed list, looked up many at a time."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for i, (slot, key) in enumerate(zip(self.slots(keys).tolist(), keys.tolist(), strict=True)):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.last
            self.keys[slot], self.values[slot] = key, i

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.MULTIPLIER >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position, or ``NO_RANK``."""
        slot, out = self.slots(keys), np.full(len(keys), NO_RANK)
        held = self.keys[slot]
        hit = np.flatnonzero(held == keys)
        out[hit] = self.values[slot[hit]]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            held = self.keys[slot[open_]]
            match = held == keys[open_]
            out[open_[match]] = self.values[slot[open_[match]]]
            open_ = open_[~match & (held != -1)]
        return out


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        described = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, vocab = byte_letters(), described["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        of_bytes = {b: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.byte_ids = np.array([of_bytes[bytes([b])] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        self.pairs, self.merged = PairTable(pairs[:, 0] << 32 | pairs[:, 1]), pairs[:, 2]
        self.words = regex.compile(PATTERN)
        named = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({named})").split if named else None

    def pretokens(self, text: str) -> list[str]:
        """The words of a text in order, special tokens among them as they stand."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        found: list[str] = []
        for part in self.split_special(text):
            found.extend([part] if part in self.special else self.words.findall(part))
        return found

    def words_after_space(self, chunk: str) -> list[str]:
        """The words of a space and a chunk without spaces; letters alone need no search."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in ENDINGS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1:]]
        return self.pretokens(" " + chunk)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array and where each word's start (one more entry at the end).

        In each round every open word merges its pairs of lowest rank.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(ids):
            rank = np.append(self.pairs.find(ids[:-1] << 32 | ids[1:]), NO_RANK)
            rank[np.flatnonzero(owner[:-1] != owner[1:])] = NO_RANK
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(ids)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            still = lowest < NO_RANK
            done_ids.append(ids[~still])
            done_owner.append(owner[~still])
            ids, owner, rank, lowest = ids[still], owner[still], rank[still], lowest[still]
            # In a run of chosen pairs they overlap: every second one, from the left, is merged.
            chosen = rank == lowest
            position = np.arange(len(ids))
            run = position - np.maximum.accumulate(np.where(chosen, -1, position))
            at = np.flatnonzero(chosen & (run % 2 == 1))
            ids[at] = self.merged[rank[at]]
            rest = np.ones(len(ids), bool)
            rest[at + 1] = False
            ids, owner = ids[rest], owner[rest]
        all_owner = np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(all_owner, minlength=len(words))))
        return np.concatenate(done_ids)[order].astype("<u4"), starts


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def shared_prefix(a: tuple, b: tuple) -> tuple:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return a[:n]


class Node:
    """A state while the automaton is built: arcs are byte -> [target, ids]; ``ends`` is None if not final."""

    __slots__ = ("arcs", "ends")

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.ends: tuple | None = None

    def delay(self, ids: tuple) -> None:
        """Emit these ids after this state instead of before it."""
        for arc in self.arcs.values():
            arc[1] = ids + arc[1]
        if self.ends is not None:
            self.ends = ids + self.ends


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal transducer of sorted, distinct, non-empty words, as the bytes of its file.

    Ids stand as early as all words through an arc allow. Once no later word can pass a state, it
    is replaced by an equal one seen before, so equal endings are stored once.
    """
    known: dict[tuple, int] = {}
    frozen: list[tuple] = []
    path, last = [Node()], b""

    def freeze(node: Node) -> int:
        made = (node.ends, tuple((b, t, ids) for b, (t, ids) in sorted(node.arcs.items())))
        if made not in known:
            known[made] = len(frozen)
            frozen.append(made)
        return known[made]

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            number = freeze(path.pop())
            path[-1].arcs[last[len(path) - 1]][0] = number

    for word, ids in entries:
        if word <= last:
            raise ValueError("words must be sorted, distinct and not empty")
        depth = 0
        while depth < len(last) and depth < len(word) and last[depth] == word[depth]:
            depth += 1
        close(depth)
        rest = ids
        for i in range(depth):
            arc = path[i].arcs[word[i]]
            common = shared_prefix(arc[1], rest)
            path[i + 1].delay(arc[1][len(common) :])
            arc[1], rest = common, rest[len(common) :]
        for i in range(depth, len(word)):
            path[-1].arcs[word[i]] = [-1, rest if i == depth else ()]
            path.append(Node())
        path[-1].ends = ()
        last = word
    close(0)
    root = freeze(path[0])
    first, label, target, out, ends, pool = [0], [], [], [0], [], []
    final_at = [0]
    final_pool: list[int] = []
    for end, arcs in frozen:
        for byte, to, ids in arcs:
            label.append(byte)
            target.append(to)
            pool.extend(ids)
            out.append(len(pool))
        first.append(len(label))
        ends.append(end is not None)
        final_pool.extend(end or ())
        final_at.append(len(final_pool))
    columns = [np.array(x, "<i4").tobytes() for x in (first, target, out, pool, final_at, final_pool)]
    columns += [bytes(label), bytes(ends)]
    return MAGIC + struct.pack("<9q", root, *map(len, columns)) + b"".join(columns)


class Lexicon:
    """A compiled automaton, memory-mapped: nothing is loaded but the pages that are used."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, *sizes = struct.unpack("<9q", self.map[4:76])
        view, at, parts = memoryview(self.map), 76, []
        for size in sizes:
            parts.append((at, size))
            at += size
        self.first, self.target, self.out, self.pool, self.final_at, self.final_pool = (
            view[a : a + n].cast("i") for a, n in parts[:6]
        )
        self.labels, self.ends = parts[6][0], parts[7][0]
        arcs = np.diff(np.frombuffer(self.first, np.int32))
        self.arc_keys = np.repeat(np.arange(len(arcs)), arcs) << 8 | np.frombuffer(view[parts[6][0] : sum(parts[6])], np.uint8)
        self.outs, self.final_outs = (np.frombuffer(x, np.int32).astype(np.int64) for x in (self.out, self.final_at))
        self.ids = np.frombuffer(self.pool, "<u4") if len(self.pool) else np.zeros(0, "<u4")
        self.all_ids = np.append(self.ids, np.frombuffer(self.final_pool, "<u4") if len(self.final_pool) else self.ids[:0])
        self.targets, self.final = np.frombuffer(self.target, np.int32), np.frombuffer(view[parts[7][0] : sum(parts[7])], np.uint8)

    def find_all(self, words: list[bytes]) -> dict[int, bytes]:
        """The ids (as bytes) of those of the words that it holds, by position; all take one step at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        arc_of, final_state = np.full(len(data), -1), np.full(len(words), -1)
        alive, state, depth = np.arange(len(words)), np.full(len(words), self.root), 0
        while len(alive):
            ended = sizes[alive] == depth
            done = ended & (self.final[state] != 0)
            final_state[alive[done]] = state[done]
            alive, state = alive[~ended], state[~ended]
            if not len(alive) or not len(self.arc_keys):
                break
            at = starts[alive] + depth
            key = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            there = self.arc_keys[arc] == key
            alive, arc = alive[there], arc[there]
            arc_of[at[there]] = arc
            state, depth = self.targets[arc].astype(np.int64), depth + 1
        held = np.flatnonzero(final_state >= 0)
        if not len(held):
            return {}
        # Outputs of the arcs of a held word, in order, then those of its final state.
        inside = np.repeat(final_state >= 0, sizes)
        arcs, owner = arc_of[inside], np.repeat(np.arange(len(words)), sizes)[inside]
        first = np.append(self.outs[arcs], self.final_outs[final_state[held]] + len(self.ids))
        last = np.append(self.outs[arcs + 1], self.final_outs[final_state[held] + 1] + len(self.ids))
        order = np.argsort(np.append(owner, held), kind="stable")
        first, count, owner = first[order], (last - first)[order], np.append(owner, held)[order]
        ends = np.cumsum(count)
        picked = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
        out = self.all_ids[picked].tobytes()
        upto = 4 * np.append(0, ends)[np.searchsorted(owner, np.append(held, len(words)))]
        return {i: out[a:b] for i, a, b in zip(held.tolist(), upto.tolist(), upto[1:].tolist(), strict=False)}

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word it holds, else None."""
        state, ids, data = self.root, [], self.map
        first, out, labels = self.first, self.out, self.labels
        for i in range(len(word)):
            at = data.find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if at < 0:
                return None
            arc = at - labels
            if out[arc] != out[arc + 1]:
                ids += self.pool[out[arc] : out[arc + 1]]
            state = self.target[arc]
        if not data[self.ends + state]:
            return None
        return ids + list(self.final_pool[self.final_at[state] : self.final_at[state + 1]])


def text_batches(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in order, grouped to about ``BATCH_CHARS``."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class Codec:
    """Encodes and decodes texts within a worker, which keeps what it has encoded for later tasks.

    A text is cut at its spaces: a word never reaches over a single space between other characters,
    and the space belongs to the word behind it. Chunks that white space touches on either side are
    marked, and a text that has one is split into words as a whole.
    """

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self.bytes_of = [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)]
        self.memo: dict[str, bytes | None] = {}

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words: from the automaton, else by merging all of them together."""
        found = {w: struct.pack("<I", self.vocab.special[w]) for w in words.intersection(self.vocab.special)}
        new = list(words.difference(found))
        coded = [w.encode() for w in new]
        held = self.lexicon.find_all(coded) if self.lexicon else {}
        for i, ids in held.items():
            found[new[i]] = ids
        unseen = [i for i in range(len(new)) if i not in held]
        ids, starts = self.vocab.merge([coded[i] for i in unseen])
        data, starts = ids.tobytes(), (4 * starts).tolist()
        for k, i in enumerate(unseen):
            found[new[i]] = data[starts[k] : starts[k + 1]]
        return found

    def learn(self, chunks: set[str]) -> None:
        """Adds the ids of new chunks; None for those whose words depend on their surroundings."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, ended, other = self.memo, {}, {}
        words = set()
        for chunk in chunks.difference(memo):
            core = chunk[:-1] if chunk[-1:] in ENDINGS else chunk
            if core.isalpha():
                if core not in memo:
                    words.add(core)
                if core is not chunk:
                    ended[chunk] = core
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                memo[chunk] = None
            else:
                other[chunk] = self.vocab.pretokens(" " + chunk)
        cores = self.encode_words({" " + w for w in words})
        for word in words:
            memo[word] = cores[" " + word]
        marks = self.encode_words(set(ENDINGS)) if ended else {}
        for chunk, core in ended.items():
            memo[chunk] = memo[core] + marks[chunk[-1]]
        known = self.encode_words({w for found in other.values() for w in found})
        for chunk, found in other.items():
            memo[chunk] = b"".join(map(known.__getitem__, found))

    def whole(self, text: str) -> bytes:
        words = self.vocab.pretokens(text)
        return b"".join(map(self.encode_words(set(words)).__getitem__, words))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for batch in text_batches(texts):
            split = [t.split(" ") for t in batch]
            # Forgets between batches only, so all chunks of this one are known below.
            self.learn({c for chunks in split for c in chunks[1:]})
            starts = self.encode_words({w for chunks in split for w in self.vocab.pretokens(chunks[0])})
            for text, chunks in zip(batch, split, strict=True):
                found = list(map(self.memo.__getitem__, chunks[1:]))
                if None in found or chunks[0][-1:].isspace():
                    yield np.frombuffer(self.whole(text), "<u4")
                else:
                    first = b"".join(map(starts.__getitem__, self.vocab.pretokens(chunks[0])))
                    yield np.frombuffer(first + b"".join(found), "<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def worker_codec(tokenizer: str, lexicon: str) -> Codec:
    return Codec(vocabulary(tokenizer), Lexicon(SparkFiles.get(lexicon)))


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``word, n`` over all texts, words up to ``LEXICON_CHARS`` characters; summed in each task first.

    A text is cut at its spaces, which belong to the word they precede. (Of runs of white space that
    are longer than one space other parts may be counted than encoding makes; ids don't depend on it.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, chunks = vocabulary(tokenizer), Counter()

        def rows():
            # Chunks go as their words come, so that no second table as large as the first is held.
            while chunks:
                seen: dict[str, int] = {}
                for _ in range(min(len(chunks), COUNTED_CHUNKS)):
                    chunk, n = chunks.popitem()
                    for word in vocab.words_after_space(chunk):
                        seen[word] = seen.get(word, 0) + n
                yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for text in batch.column("text"):
                # Equal chunks between spaces are counted first and split into words once.
                chunks.update((text.as_py() or "").split(" "))
                if len(chunks) > MEMO_WORDS:
                    yield from rows()
        yield from rows()

    counted = docs.select("text").mapInArrow(giving_back(run), "word string, n long")
    return counted.where(F.length("word") <= LEXICON_CHARS).groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, bound: int) -> list[str]:
    """The words above the lowest count that at most ``bound`` words exceed (counts in eighths of an octave)."""
    level = F.floor(F.log2("n") * 8).cast("int")
    rows = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    held, least = 0, None
    for row in rows:
        held += row["count"]
        if held > bound:
            break
        least = row["level"]
    return [] if least is None else [r["word"] for r in counts.where(level >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str, bound: int = LEXICON_WORDS) -> bytes:
    """Counts the words of all texts and compiles the frequent ones; at most ``bound`` reach the driver."""
    vocab = vocabulary(tokenizer)
    found = frequent_words(materialise(word_counts(docs, tokenizer), "bpe-words"), bound)
    words = sorted(w.encode() for w in found if w not in vocab.special)
    ids, starts = vocab.merge(words)
    return compile_lexicon((w, tuple(ids[a:b].tolist())) for w, a, b in zip(words, starts, starts[1:], strict=False))


def share(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and has Spark hand it to every executor; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'bpe-lexicon')}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode_with(docs: DataFrame, tokenizer: str, name: str, make, schema: str) -> DataFrame:
    """Rows that ``make(codec, doc_ids, texts)`` gives for every batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer, name)
        for batch in batches:
            yield from make(codec, batch.column("doc_id"), batch.column("text"))

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)


def encode(docs: DataFrame, tokenizer: str, bound: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, ids`` of every document."""
    name = share(docs.sparkSession, build_lexicon(docs, tokenizer, bound))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(codec, doc_ids, texts):
        for start in range(0, len(doc_ids), 256):  # so that no batch of ids grows large
            part = [ids.astype(np.int32) for ids in codec.encode(t.as_py() for t in texts[start : start + 256])]
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int32),
                pa.array(np.concatenate([np.zeros(0, np.int32), *part])),
            )
            yield pa.RecordBatch.from_arrays([doc_ids[start : start + 256], lists], ["doc_id", "ids"])

    return encode_with(docs, tokenizer, name, make, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, digest, schema: str, bound: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id`` and the columns of ``digest(ids, decoded)`` of every document, encoded and decoded."""
    name = share(docs.sparkSession, build_lexicon(docs, tokenizer, bound))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [c.split()[0] for c in schema.split(",")]

    def make(codec, doc_ids, texts):
        found = []
        for ids in codec.encode(t.as_py() for t in texts):
            listed = ids.tolist()
            found.append(digest(listed, codec.decode(listed)))
        arrays = [pa.array([row[i] for row in found]) for i in range(len(columns))]
        yield pa.RecordBatch.from_arrays([doc_ids, *arrays], ["doc_id", *columns])

    return encode_with(docs, tokenizer, name, make, f"doc_id {kind}, {schema}")
