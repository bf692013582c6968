"""Exact top-k search by BM25 over an inverted index, built and searched per shard.

Every task cuts its documents into shards of bounded size and writes each shard's index (postings
by term with counts, lengths) as one file to the shared folder; documents are not shuffled. The
manifest, which Spark commits, names the files that count, and the terms of each. Document
frequencies, the number of documents and the mean length are taken over all shards, so scores do
not depend on the sharding.

Queries are written in blocks, and every block meets every shard: a task gets the names of one
block and of a lot of shards. For each shard the frequent words of many queries at once are scored
by one matrix product, the postings of the others are added, and only documents that can still be
among the ``k`` best of all shards of the lot so far are scored again in double precision and kept.
The lists of the tasks are merged by score. Nothing is approximate: every document that can be in
the result is scored in full, and all documents are compared.

A query is a set of words (lower-cased runs of letters and digits). Defined results: a null or
wordless text neither finds nor is found; documents without a query word are no hits; ties go to the
smaller id; a row never finds its own id; rows that share an id are searched and found as rows, and
such an id counts with its best score; rows without an id take no part. Words are kept as 64-bit
hashes.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.session import materialise, scratch_path

#: Documents of a shard at most, and queries (about) that are searched together.
SHARD_DOCS, QUERY_BLOCK = 16_384, 4096
#: Queries whose scores by frequent words are one matrix product, and shards that one task searches at most.
QUERY_LOT, SHARD_LOT = 128, 32
#: Relative error allowed for first scores, which are single precision.
MARGIN = 1e-4
#: Words in more than this share of a shard's documents have their gains in a matrix, so many of them at most.
FREQUENT, DENSE_WORDS = 1 / 16, 512
K1, B = 1.2, 0.75
#: Tasks that lots of shards and blocks of queries are dealt to, at most.
MAX_TASKS = 20_000
words_of = re.compile(r"[^\W_]+").findall


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text as distinct words (as hashes, ascending) with their counts."""
    found = Counter(words_of((text or "").lower()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    hashes = (hashes ^ np.uint64(1 << 63)).view(np.int64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], np.fromiter(found.values(), np.int32, len(found))[order]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole numbers from each ``first`` on, so many of each, one range behind the other."""
    ends = np.cumsum(size)
    out = np.arange(ends[-1])
    out += np.repeat(first - ends + size, size)
    return out


class Shard:
    """One shard's index in memory: gains (weight times idf) of the asked words by posting, and those of the most
    frequent ones by document."""

    def __init__(self, arrays: dict[str, np.ndarray], mean_length: float, words: np.ndarray, idf: np.ndarray):
        self.doc_ids, terms, self.starts = arrays["doc_ids"], arrays["terms"], arrays["starts"]
        self.docs = arrays["docs"].astype(np.int32)
        n, self.sizes = len(self.doc_ids), np.diff(self.starts)
        # Where the shard has each word, or -1.
        self.spots = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
        self.spots[terms[self.spots] != words] = -1
        asked = np.zeros(len(terms))
        asked[self.spots[self.spots >= 0]] = idf[self.spots >= 0]
        tf, length = arrays["counts"].astype(float), arrays["lengths"].astype(float)
        self.gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs] / mean_length))
        self.gains *= np.repeat(asked, self.sizes)
        # Rows are sorted by id: whether each id has one row, and the number of each row's id.
        new_id = np.append(True, self.doc_ids[1:] != self.doc_ids[:-1])[:n]
        self.unique, self.id_of = bool(new_id.all()), np.cumsum(new_id) - 1
        frequent = np.flatnonzero((self.sizes > FREQUENT * n) & (asked > 0))
        frequent = frequent[np.argsort(-self.sizes[frequent], kind="stable")][:DENSE_WORDS]
        self.row = np.full(len(terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        for row, t in enumerate(frequent):
            at = slice(self.starts[t], self.starts[t + 1])
            self.dense[row, self.docs[at]] = self.gains[at]
        # The postings of a document, by ascending term, and their terms.
        self.by_doc = np.argsort(arrays["docs"], kind="stable").astype(np.int32)
        self.terms_by_doc = np.repeat(np.arange(len(terms), dtype=np.int32), self.sizes)[self.by_doc]
        self.doc_starts = np.append(0, np.cumsum(np.bincount(self.docs, minlength=n)))
        self.wanted = np.zeros(len(terms), bool)

    @staticmethod
    def build(doc_ids: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """Postings sorted by term, then by document; documents are numbered by ascending id."""
        order = np.argsort(np.array(doc_ids, np.int64), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        lengths = np.array([c.sum() for _, c in bags], np.int64)
        doc = np.repeat(number, [len(t) for t, _ in bags])
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in bags)])
        counts = np.concatenate([np.zeros(0, np.int32), *(c for _, c in bags)])
        by_term = np.lexsort((doc, terms))
        terms, doc, counts = terms[by_term], doc[by_term], counts[by_term]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        return {
            "doc_ids": np.array(doc_ids, np.int64)[order],
            "lengths": lengths[order],
            "terms": terms[first],
            "starts": np.append(first, len(terms)),
            "docs": doc.astype(np.min_scalar_type(len(order))),
            "counts": counts.astype(np.min_scalar_type(int(counts.max(initial=0)))),
        }

    def best_of_ids(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Where each id among ``rows`` has its best score."""
        if self.unique:
            return np.arange(len(rows))
        order = np.lexsort((-scores, self.id_of[rows]))
        ids = self.id_of[rows[order]]
        return order[np.append(True, ids[1:] != ids[:-1])[: len(ids)]]

    def search(self, queries: dict[str, np.ndarray], best: "Best") -> None:
        """Betters the lists of ``best`` by the documents of this shard, a query's own id left out."""
        own, starts = queries["query_id"], queries["starts"]
        own_from, own_to = np.searchsorted(self.doc_ids, own), np.searchsorted(self.doc_ids, own, side="right")
        for lot in range(0, len(own), QUERY_LOT):
            ends = starts[lot : lot + QUERY_LOT + 1]
            n = len(ends) - 1
            at = self.spots[queries["terms"][ends[0] : ends[-1]]]
            query, here = np.repeat(np.arange(n), np.diff(ends)), np.flatnonzero(at >= 0)
            at, query = at[here], query[here]
            rows = self.row[at]
            frequent, rare = rows >= 0, rows < 0
            asks = np.zeros((n, len(self.dense)), np.float32)
            asks[query[frequent], rows[frequent]] = 1
            first, size = self.starts[at[rare]], self.sizes[at[rare]]
            words, cuts = np.searchsorted(query, np.arange(n + 1)), np.searchsorted(query[rare], np.arange(n + 1))
            hits = []
            for i, scores in enumerate(asks @ self.dense):
                if words[i] == words[i + 1]:
                    continue
                if cuts[i] < cuts[i + 1]:
                    scores = self.added(scores, first[cuts[i] : cuts[i + 1]], size[cuts[i] : cuts[i + 1]])
                scores[own_from[lot + i] : own_to[lot + i]] = 0
                docs = self.hopeful(scores, best.floors[lot + i], best.k)
                if len(docs):
                    docs, gains = self.exact(docs, at[words[i] : words[i + 1]])
                    hits.append((np.full(len(docs), lot + i), self.doc_ids[docs], gains))
            best.add(lot, lot + n, hits)

    def added(self, scores: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``scores`` and the gains of words by their postings, so many of each from ``first`` on."""
        place = ranges(first, size)
        return scores + np.bincount(self.docs.take(place, mode="clip"), self.gains.take(place, mode="clip"), minlength=len(scores))

    def hopeful(self, scores: np.ndarray, floor: float, k: int) -> np.ndarray:
        """The documents that may be among the ``k`` best, by scores that are single precision."""
        docs = np.flatnonzero(scores >= floor * (1 - MARGIN) if floor else scores > 0)
        if len(docs) > k:
            scores = scores[docs]
            each = scores[self.best_of_ids(docs, scores)]
            if len(each) > k:
                docs = docs[scores >= np.partition(each, -k)[-k] * (1 - MARGIN)]
        return docs

    def exact(self, docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id among ``docs`` once with its best score, which is summed in the order of the words in every shard."""
        self.wanted[words] = True
        first, size = self.doc_starts[docs], self.doc_starts[docs + 1] - self.doc_starts[docs]
        place, owner = ranges(first, size), np.repeat(np.arange(len(docs)), size)
        hit = np.flatnonzero(self.wanted.take(self.terms_by_doc.take(place, mode="clip"), mode="clip"))
        scores = np.bincount(owner[hit], self.gains[self.by_doc[place[hit]]], minlength=len(docs))
        self.wanted[words] = False
        each = self.best_of_ids(docs, scores)
        return docs[each], scores[each]


class Best:
    """The ``k`` best ids of every query of a block so far, best first, and the score that another has to reach.

    A score of 0 marks a free place. ``scored`` counts the documents that were scored in full.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.floors, self.scored = k, np.zeros(queries), 0
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.zeros((queries, k))

    def add(self, start: int, stop: int, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Hits (query, id, score) of queries from ``start`` to ``stop``; an id keeps its best score."""
        old = np.nonzero(self.scores[start:stop])
        query, ids, scores = (np.concatenate(x) for x in zip((old[0] + start, self.ids[start:stop][old], self.scores[start:stop][old]), *hits, strict=True))
        self.scored += len(ids) - len(old[0])
        order = np.lexsort((-scores, ids, query))
        query, ids, scores = query[order], ids[order], scores[order]
        order = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)])
        order = order[np.lexsort((ids[order], -scores[order], query[order]))]
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        query, rank = query[kept], rank[kept]
        self.scores[start:stop] = 0
        self.ids[query, rank], self.scores[query, rank] = ids[kept], scores[kept]
        self.floors[start:stop] = self.scores[start:stop, -1]

    def rows(self, query_id: np.ndarray) -> pa.RecordBatch:
        query, rank = np.nonzero(self.scores)
        return pa.RecordBatch.from_arrays(
            [pa.array(query_id[query]), pa.array(self.ids[query, rank]), pa.array(self.scores[query, rank])],
            ["query_id", "doc_id", "score"],
        )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a URI."""
    folder = scratch_path(spark, name)
    folder = folder if urlparse(folder).scheme else f"file://{folder}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return folder


def stored(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays under a name of their own, so a repeated task writes another file; its URI."""
    data, (store, top) = io.BytesIO(), fs.FileSystem.from_uri(folder)
    np.savez(data, **arrays)
    name = f"{name}-{uuid4().hex}.npz"
    with store.open_output_stream(f"{top}/{name}") as out:
        out.write(data.getbuffer())
    return f"{folder}/{name}"


def loaded(path: str) -> dict[str, np.ndarray]:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file, np.load(io.BytesIO(file.read())) as arrays:
        return {key: arrays[key] for key in arrays.files}


def write_index(docs: DataFrame, shard_docs: int) -> DataFrame:
    """Builds and writes a shard for every ``shard_docs`` documents of a task.

    The manifest has ``shard, path, documents, words`` and the shard's ``terms`` with their ``dfs``.
    Wordless texts are left out.
    """
    folder = new_folder(docs.sparkSession, "bm25-index")
    kinds = pa.schema(
        [
            ("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("words", pa.int64()),
            ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, shard = [], [], 0
        part = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            arrays = Shard.build(ids, held)
            path = stored(folder, f"part-{part:06d}-{shard:06d}", arrays)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": [(part << 32) + shard], "path": [path], "documents": [len(ids)],
                    "words": [int(arrays["lengths"].sum())], "terms": [arrays["terms"]], "dfs": [np.diff(arrays["starts"])],
                },
                schema=kinds,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = bag(text.as_py())
                if len(found[0]):
                    ids.append(doc_id)
                    held.append(found)
                if len(ids) >= shard_docs:
                    yield close()
                    held, ids, shard = [], [], shard + 1
        if ids:
            yield close()

    schema = "shard long, path string, documents long, words long, terms array<long>, dfs array<int>"
    return materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "bm25-manifest")


def query_words(docs: DataFrame) -> DataFrame:
    """``query, query_id, terms``: the distinct words of the asking documents, numbered by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [bag(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(terms, pa.list_(pa.int64()))], ["query_id", "terms"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("query_id"), "text").mapInArrow(run, "query_id long, terms array<long>")
    numbered = rows.where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id())
    return materialise(numbered, "bm25-queries")


def search(docs: DataFrame, is_query: Column, k: int = 10, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``query_id, rank, doc_id, score`` for the rows with ``is_query`` (on ``doc_id``) against all others."""
    docs = docs.where("doc_id is not null")
    manifest = write_index(docs, shard_docs)
    total = manifest.agg(F.sum("documents").alias("n"), F.sum("words").alias("words"), F.count("*").alias("shards")).first()
    n = total["n"] or 0
    mean_length = total["words"] / n if n else 1.0

    asked = query_words(docs.where(is_query))
    asks = asked.select("query", "query_id", F.explode("terms").alias("term"))
    each = manifest.select(F.explode(F.arrays_zip("terms", "dfs")).alias("z"))
    seen = each.groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.dfs").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = materialise(
        seen.join(asks.select("term").distinct(), "term").select("term", idf.alias("idf")), "bm25-idf"
    )
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    folder = new_folder(docs.sparkSession, "bm25-queries")

    def write(table: pa.Table) -> pa.Table:
        """One block of queries as a file: their words by query, ascending, as places in the list of all of them."""
        table = table.sort_by([("query", "ascending"), ("term", "ascending")])
        query, first = np.unique(table.column("query").to_numpy(), return_index=True)
        words, places, terms = np.unique(table.column("term").to_numpy(), return_index=True, return_inverse=True)
        arrays = {
            "query_id": table.column("query_id").to_numpy()[first], "starts": np.append(first, len(table)),
            "words": words, "idf": table.column("idf").to_numpy()[places], "terms": terms.astype(np.int32),
        }
        number = table.column("block")[0].as_py()
        return pa.table({"block": [number], "asked": [stored(folder, f"block-{number:08d}", arrays)]})

    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    asking = asks.join(weighed, "term").select("query", "query_id", "term", "idf", block)
    files = materialise(asking.groupBy("block").applyInArrow(write, "block long, asked string"), "bm25-blocks")

    # Every block of queries meets every shard; only the names of files are sent to tasks. A task has one block and
    # a lot of shards, dealt by the numbers of the tasks that wrote them.
    spark, shards = docs.sparkSession, total["shards"]
    together = max(1, min(SHARD_LOT, shards * blocks // (4 * spark.sparkContext.defaultParallelism)))
    lots = max(1, -(-shards // together))
    number = F.shiftright("shard", 32) + F.col("shard").bitwiseAND((1 << 32) - 1)
    lot = F.pmod(number, F.lit(lots)).alias("lot")
    paths = manifest.groupBy(lot).agg(F.collect_list("path").alias("paths"))
    tasks = spark.range(0, lots * blocks, 1, min(lots * blocks, MAX_TASKS))
    tasks = tasks.select((F.col("id") % lots).alias("lot"), F.floor(F.col("id") / lots).alias("block"))
    tasks = tasks.join(F.broadcast(paths), "lot").join(F.broadcast(files), "block").select("paths", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths, asked in zip(batch.column("paths").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                queries = loaded(asked)
                best = Best(len(queries["query_id"]), k)
                for path in paths:
                    Shard(loaded(path), mean_length, queries["words"], queries["idf"]).search(queries, best)
                yield best.rows(queries["query_id"])

    found = tasks.mapInArrow(run, "query_id long, doc_id long, score double")
    found = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
