"""Neighbour search, BM25 and SimHash against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mendframe.llm import ann, bm25, simhash

VECTORS = "vec_id long, embedding array<double>, rank string"


def clustered(n: int, dims: int = 16, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    return centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dims))


def brute_nearest(ids, x, query, k):
    score = (x * x[query]).sum(axis=1)
    order = np.lexsort((ids, -score))
    return [(int(ids[i]), score[i]) for i in order if ids[i] != ids[query]][:k]


def found_lists(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_search_with_all_partitions_is_exact(spark):
    x = clustered(400)
    x[50:200] = x[50]  # one vector with a third of all rows
    x[210] = x[211]
    ids = np.arange(400)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(1000, None, "c"), (1020, [0.0] * 16, "c"), (1040, [math.nan] * 16, "c"), (1060, [None] * 16, "c"), (1080, [math.inf] * 16, "c"), (None, [1.0] * 16, "c")]
    vectors = spark.createDataFrame([*rows, *odd, *rows[60:70]], VECTORS)
    got = found_lists(ann.search(vectors, F.col("vec_id") % 20 == 0, 7, probes=1000, sample_rows=200).collect())
    assert sorted(got) == list(range(0, 400, 20))
    for q, hits in got.items():
        want = brute_nearest(ids, x, q, 7)
        assert [h for h, _ in hits] == [h for h, _ in want]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want], abs=1e-12)


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    x = clustered(300, seed=2)
    vectors = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], VECTORS)
    runs = []
    for size in (8192, 16):
        monkeypatch.setattr(ann, "BLOCK_ROWS", size)
        monkeypatch.setattr(ann, "QUERY_ROWS", size // 4)
        runs.append(sorted(ann.search(vectors, F.col("vec_id") % 3 == 0, 5, probes=2).collect()))
    assert runs[0] == runs[1]


def test_search_recall(spark):
    x = clustered(3000, seed=3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], VECTORS)
    got = found_lists(ann.search(vectors, F.col("vec_id") % 20 == 0, 20).collect())
    hits = [len({h for h, _ in got[q]} & {h for h, _ in brute_nearest(np.arange(3000), x, q, 20)}) for q in got]
    assert np.mean(hits) / 20 >= 0.9


@pytest.mark.parametrize("grouped", [True, False])
def test_search_recall_with_unlike_lengths(spark, grouped):
    """Lengths spread log-normally: the longest vectors are among the best of queries everywhere."""
    rng = np.random.default_rng(6)
    x = clustered(4000, seed=6) if grouped else rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(0.5 * rng.normal(size=(4000, 1)))
    vectors = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], VECTORS)
    got = found_lists(ann.search(vectors, F.col("vec_id") % 20 == 0, 20).collect())
    hits = np.array([len({h for h, _ in got[q]} & {h for h, _ in brute_nearest(np.arange(4000), x, q, 20)}) for q in got]) / 20
    assert len(hits) == 200 and hits.mean() >= 0.95 and hits.min() >= 0.8


def test_ties_go_to_the_smaller_id(spark):
    """Vectors of zeros and ones: most scores tie, and all partitions are searched."""
    x = (np.random.default_rng(7).random((600, 16)) < 0.4).astype(float)
    x[:, 0] = 1
    ids = np.random.default_rng(8).permutation(600)
    vectors = spark.createDataFrame([(int(i), v.tolist(), "") for i, v in zip(ids, x)], VECTORS)
    got = found_lists(ann.search(vectors, F.col("vec_id") % 20 == 0, 20, probes=1000, sample_rows=300).collect())
    place = np.argsort(ids)
    for q, hits in got.items():
        score = x[place] @ x[place[q]]
        want = [int(i) for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert [h for h, _ in hits] == want


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(20, [1.0, 2.0], ""), (21, [0.5, 0.0], ""), (22, [1.0, 1.0, 1.0], ""), (40, [1.0], ""), (60, [0.0, 3.0], "")]
    got = found_lists(ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 20).collect())
    assert {q: [h for h, _ in hits] for q, hits in got.items()} == {20: [60, 21], 60: [20, 21]}


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0], "")], [(20, [1.0, 2.0], ""), (21, [0.5, 0.0], "")], [(20, [1.0, 2.0], "")] * 3 + [(40, [1.0, 2.0], "")]])
def test_search_of_few(spark, rows):
    got = found_lists(ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 20).collect())
    ids = sorted({r[0] for r in rows})
    assert {q: [h for h, _ in hits] for q, hits in got.items()} == {
        q: [i for i in ids if i != q] for q in ids if q % 20 == 0 and len(ids) > 1
    }


def test_partitions_are_balanced(spark):
    x = clustered(1000, seed=5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(spark, unit, unit, 8)
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    assert (np.sort(graph, axis=1) == np.sort(np.argsort(-near, axis=1)[:, :8], axis=1)).all()
    label = ann.balanced_partitions(graph, 3)
    sizes = np.bincount(label)
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3
    cut = np.mean(label[graph] != label[:, None])
    shuffled = np.random.default_rng(0).permutation(label)
    assert cut < 0.6 * np.mean(shuffled[graph] != shuffled[:, None])


DOCS = "doc_id long, text string, score double"


def brute_bm25(rows, k):
    bags = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows if i is not None}
    bags = {i: b for i, b in bags.items() if b}
    n = len(bags)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, n)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for q, words in bags.items():
        if q % 100 == 0:
            score = Counter()
            for i, b in bags.items():
                if i != q:
                    for w in words.keys() & b.keys():
                        tf = b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
                        score[i] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf
            out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return {q: hits for q, hits in out.items() if hits}


def test_bm25_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(900)]
    rows += [(1000 + i, rows[0][1].upper()) for i in range(40)]  # copies of one query, all of equal score
    rows += [(1100, None), (1200, ""), (1300, "... --"), (None, "w1 w2"), (1400, "unheardof"), (1401, "w1 " * 3000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS)
    want = brute_bm25(rows, 10)
    for shard_docs in (100_000, 120):
        got: dict = {}
        for r in sorted(bm25.search(docs, F.col("doc_id") % 100 == 0, 10, shard_docs).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert got.keys() == want.keys()
        for q in got:
            assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_bm25_counts_ids_not_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 30)))) for i in range(200)]
    best = (500, rows[0][1])  # the best match of query 0, repeated more than k times
    twice = [r for r in rows if r[0] % 100] * 2
    odd = [(501, rows[0][1] + " w1"), (501, "w1 w2"), (501, rows[100][1])]
    every = [*rows, *twice, *[best] * 25, *odd]
    docs = spark.createDataFrame([(*r, 0.5) for r in every], DOCS).coalesce(1)
    for k in (1, 10):
        want = brute_bm25_rows(every, k)
        for shard_docs in (100_000, 90):
            got: dict = {}
            for r in sorted(bm25.search(docs, F.col("doc_id") % 100 == 0, k, shard_docs).collect(), key=lambda r: r["rank"]):
                got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
            assert got.keys() == want.keys()
            for q in got:
                assert [d for d, _ in got[q]] == [d for d, _ in want[q]]
                assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def brute_bm25_rows(rows, k):
    """As brute_bm25, where ids repeat: every row is searched and found, an id has its best score."""
    numbered = [(i * 1000 + at, t) for at, (i, t) in enumerate(rows)]
    bags = {n: Counter(re.findall(r"[^\W_]+", t)) for n, t in numbered}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out: dict = {}
    for q, words in bags.items():
        if q // 1000 % 100 == 0:
            best = out.setdefault(q // 1000, {})
            for n, b in bags.items():
                if n // 1000 != q // 1000 and words.keys() & b.keys():
                    score = 0.0
                    for w in words.keys() & b.keys():
                        tf = b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
                        score += math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf
                    best[n // 1000] = max(score, best.get(n // 1000, 0))
    return {q: sorted(hits.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k] for q, hits in out.items()}


def test_bm25_tasks_keep_a_query_s_best_over_many_shards():
    """Shards of one task: lists as by brute force, few documents are scored in full."""
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.5))}" for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(1600)]
    rows = [(i, texts[i] if i % 40 else texts[7]) for i in range(1600)]
    bags = [bm25.bag(t) for _, t in rows]
    n, mean = len(rows), sum(int(counts.sum()) for _, counts in bags) / len(rows)
    all_words, df = np.unique(np.concatenate([words for words, _ in bags]), return_counts=True)
    asking = range(0, n, 100)
    words, terms = np.unique(np.concatenate([bags[i][0] for i in asking]), return_inverse=True)
    df = df[np.searchsorted(all_words, words)]
    queries = {
        "query_id": np.array(asking), "starts": np.append(0, np.cumsum([len(bags[i][0]) for i in asking])),
        "words": words, "idf": np.log(1 + (n - df + 0.5) / (df + 0.5)), "terms": terms,
    }
    best = bm25.Best(len(asking), 10)
    for start in range(0, n, 100):
        arrays = bm25.Shard.build([i for i, _ in rows[start : start + 100]], bags[start : start + 100])
        bm25.Shard(arrays, mean, words, queries["idf"]).search(queries, best)
    found: dict = {}
    for hit in sorted(best.rows(queries["query_id"]).to_pylist(), key=lambda r: (-r["score"], r["doc_id"])):
        found.setdefault(hit["query_id"], []).append((hit["doc_id"], hit["score"]))
    want = brute_bm25(rows, 10)
    assert found.keys() == want.keys()
    for q in found:
        assert [d for d, _ in found[q]] == [d for d, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)
    # Ten of every shard would be 160 a query.
    assert best.scored <= 80 * len(asking)


def test_bm25_of_nothing(spark):
    assert bm25.search(spark.createDataFrame([], DOCS), F.col("doc_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(0, "a b", 0.0), (1, None, 0.0)], DOCS)
    assert bm25.search(lone, F.col("doc_id") % 100 == 0).count() == 0


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    values = sorted({v for _, v in marks})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least: dict = {}
    for i, v in marks:
        least.setdefault(find(v), []).append(i)
    named = {v: min((i for i in ids if i is not None), default=None) for v, ids in least.items()}
    return {(i, v): named[find(v)] for i, v in marks}


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not difference & m for m in masks)


@pytest.mark.parametrize("pair_rows", [32, 1])
def test_groups_equal_brute_force(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(simhash, "PAIR_ROWS", pair_rows)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(6)]
    marks = [(i, c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) for i, c in enumerate(rng.choices(centres, k=260))]
    marks += [(1000 + i, 0) for i in range(5)] + [(None, 0), (None, 12345), (5, marks[4][1])]
    df = spark.createDataFrame([(i, simhash.signed(v)) for i, v in marks], "doc_id long, fp long")
    got = sorted((r["doc_id"] or -1, r["fp"], r["component_id"] or -1) for r in simhash.groups(df, 2).collect())
    want = plain_components(marks, 2)
    assert got == sorted((i or -1, simhash.signed(v), want[i, v] or -1) for i, v in marks)


def test_fingerprints_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    texts = [None, "", " \t ", "One", "one TWO", "a b c", "a b c d", "É É é\x0bx y z", "w " * 500, " ".join(map(str, range(1000)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r["h"] for r in simhash.fingerprints(docs, 3).select("doc_id", simhash.hex_of(F.col("fp")).alias("h")).collect()}
    assert got == {i: f"{plain_fingerprint(t, 3):016x}" for i, t in enumerate(texts)}
    assert simhash.near_duplicates(docs.limit(0), 3, 2).count() == 0


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + j) for j in range(1, 40)] + [(500, 501)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + j: 100 for j in range(1, 40)} | {501: 500}
    assert simhash.components(df.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base = [[word() for _ in range(rng.randint(80, 300))] for _ in range(60)]
    rows, want = [], set()
    for g, words in enumerate(base):
        rows.append((g * 100, " ".join(words), g, "s"))
        want.add(g * 100)
        for c in range(1, g % 4):  # near copies: one changed word, other letter case
            copy = list(words)
            copy[rng.randrange(len(copy))] = word()
            rows.append((g * 100 + c, " ".join(copy).title(), g, "s"))
    rows += [(7000 + i, " ".join(base[0]), 0, "s") for i in range(30)]  # exact copies
    scrambled = sorted(base[1])
    rows += [(8000, " ".join(scrambled), 0, "s"), (9000, None, 0, "s"), (9001, None, 0, "s"), (9002, "", 0, "s"), (9003, "", 0, "s")]
    rows += [(None, "no id at all", 0, "s"), (None, "no id at all", 0, "s"), (0, " ".join(base[0]), 0, "s")]
    want |= {8000, 9000, None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long, node string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_kept(rows, similar=0.8):
    """The smallest id of every component of the pairs with that Jaccard similarity of 5-word shingles."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both / (len(x) + len(sets[j]) - both) >= similar:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def changed(rng, words, count):
    """A copy with ``count`` words replaced, far from each other."""
    copy = list(words)
    for at in rng.sample(range(0, len(words), 6), count):
        copy[at] = f"new{rng.randrange(1 << 40)}"
    return copy


@pytest.mark.parametrize("pair_rows", [1, 32])
def test_near_copies_joined_by_one_member_only(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(simhash, "PAIR_ROWS", pair_rows)
    rng = random.Random(pair_rows)
    groups = []
    for size in (4, 60):
        # Copies near the base alone: under 0.8 to each other; the base has no special id.
        base = [f"b{size}w{i}" for i in range(300)]
        groups += [[base, *(changed(rng, base, 6) for _ in range(size))]]
        # Chains: each is near the next alone.
        chain = [[f"c{size}w{i}" for i in range(300)]]
        for _ in range(size):
            chain.append(changed(rng, chain[-1], 6))
        groups += [chain]
        # Pairs that share a hub which neither of them is near to.
        hub = [f"h{size}w{i}" for i in range(300)]
        groups += [[hub, *(w for _ in range(size // 2) for w in [changed(rng, hub, 12)] for w in (w, changed(rng, w, 2)))]]
    texts = [" ".join(words) for group in groups for words in group]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)


def test_every_pair_from_the_threshold_on_is_found(spark):
    rng = random.Random(8)
    texts = []
    for vocabulary in (1 << 40, 250, 60):  # all words distinct, or repetitive texts
        for n in range(12):
            words = [f"v{n}x{rng.randrange(vocabulary)}" for _ in range(450)]
            extra = [f"e{rng.randrange(1 << 40)}" for _ in range(10 + 9 * n)]
            texts += [words, [*words, *extra]]  # J from 0.98 down to 0.80
            words = [f"v{n}y{rng.randrange(vocabulary)}" for _ in range(450)]
            texts += [words, words[: 450 - 8 * n - 3]]  # J from 0.99 down to 0.79
            words = [f"v{n}z{rng.randrange(vocabulary)}" for _ in range(450)]
            texts += [words, changed(rng, words, n)]  # J from 1 down to 0.78
    rows = list(zip(rng.sample(range(10_000), len(texts)), map(" ".join, texts), strict=True))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)


def test_texts_of_near_fingerprints_are_one_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))
    rows = []
    for g in range(20):  # one shingle makes up nearly all of a text; the rest differs, so do the sets
        rows += [(10 * g + i, " ".join([word()] + [f"often{g}"] * 300 + [word() for _ in range(4)])) for i in range(3)]
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    want = plain_components([(i, plain_fingerprint(t, 5)) for i, t in rows], 2)
    assert len(brute_kept(rows)) == len(rows) > len(set(want.values()))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8, 2)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))
