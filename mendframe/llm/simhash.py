"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of all word shingles. To find all
fingerprints within ``radius`` bits, every bit position gets a non-zero vector of radius + 1 bits,
and there is one table per non-zero vector v, whose mask keeps the positions whose vector has an
odd inner product with v. Any ``radius`` positions leave some v orthogonal to all of them, so
every pair within the radius agrees under at least one mask: no pair is missed.

Equal fingerprints collapse to one row first. In a bucket of at most ``PAIR_ROWS`` fingerprints
all pairs are compared; in a larger one every fingerprint emits its variants with up to radius / 2
of the bits flipped that the mask leaves free, and fingerprints that share a variant are linked.
Both find exactly the pairs within the radius, and no bucket's pairs are multiplied out.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any
other; repeated rows keep a row each; a null id never names a component unless all ids in it are
null; an empty table gives an empty result.

Near-duplicate texts (``keep_one``) are first grouped by their fingerprints in this way. A fingerprint
misses most pairs that differ by a passage, so an exact join on the first shingles of every text in a
common order, confirmed by all its shingles, then adds the pairs that the groups leave open.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import arrow_batches, giving_back, hash_unit
from mendframe.operators.sizing import small_side
from mendframe.session import materialise

BITS = 64
#: Buckets up to this size are compared pair by pair.
PAIR_ROWS = 32
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Near-duplicate texts: one in so many texts tells which tokens are frequent, of which so many are kept.
ORDER_SHARE, ORDER_TOKENS = 16, 1 << 18
#: Longs of 64 bits that hold the parities of a token set.
PARITY_LONGS = 8
#: Rows of a bucket that are ranked together, and ranks whose turn comes in the first round.
RANKED_ROWS, FIRST_RANKS = 1024, 1
#: Tokens of a prefix by which copies are looked for first.
FIRST_TOKENS = 4
PARITY = [f"parity{i}" for i in range(PARITY_LONGS)]
#: Texts, or pairs of them, that Python gets at a time.
BATCH_TEXTS = 256
#: The token of texts without words.
WORDLESS = -1


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 (seed 42) of each space-joined shingle; of the whole sequence if it is shorter."""
    hashed = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= width:
        return [hashed(b" ".join(words), 42)]
    return [hashed(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def hash_parts(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles of a text, repeats included, ``CHUNK`` of them at a time."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    for start in range(0, max(1, len(words) - width + 1), CHUNK):
        yield np.array(shingle_hashes(words[start : start + CHUNK + width - 1], width), np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of all hashes as a signed 64-bit integer."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprint(text: str | None, width: int) -> int:
    return majority(hash_parts(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every text as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The covering family: 2^(radius + 1) - 1 masks as signed 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [i % vectors + 1 for i in range(BITS)]
    kept = ([i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2] for v in range(1, vectors + 1))
    return [signed(sum(1 << i for i in bits)) for bits in kept]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def flips(fp: Column, mask: Column, count: int) -> Column:
    """``fp`` with up to ``count`` of the bits flipped that ``mask`` leaves out."""
    free = F.filter(
        F.array(*[F.lit(signed(1 << i)).cast("long") for i in range(BITS)]), lambda b: b.bitwiseAND(mask) == 0
    )
    found = F.array(fp)
    for _ in range(count):
        more = F.flatten(F.transform(found, lambda x: F.transform(free, lambda b: x.bitwiseXOR(b))))
        found = F.array_distinct(F.concat(found, more))
    return found


def links(fps: DataFrame, radius: int, parts: tuple[str, ...] = ()) -> DataFrame:
    """``a < b``: links that join exactly the distinct ``fp`` values within ``radius`` bits.

    ``parts`` are columns that set independent families of fingerprints apart. With a column ``root``
    values of one root count as joined already, and only links between roots are looked for. Pairs of
    small buckets appear as they are; of a large one each variant's members are linked to their
    smallest, which leaves the connected components unchanged.
    """
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even")
    bucket = [*parts, "table", "key"]
    tables = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    rows = fps.select(*parts, "fp", F.posexplode(tables).alias("table", "mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )
    shared = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    members = rows.join(shared, bucket)
    if "root" in fps.columns:
        # Few rows share a bucket: roots are looked up for them alone, and buckets of one root left out.
        members = materialise(members, "simhash-shared").join(fps.select(*parts, "fp", "root"), [*parts, "fp"])
        members = materialise(members, "simhash-rooted")
        mixed = members.groupBy(*bucket).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        members = members.join(mixed.select(*bucket), bucket, "left_semi")
    else:
        members = members.withColumn("root", F.col("fp"))
    members = materialise(members, "simhash-buckets")
    small = members.where(F.col("n") <= PAIR_ROWS).groupBy(*bucket).agg(F.collect_list(F.struct("fp", "root")).alias("l"))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = (
        small.select(*parts, "l", F.explode("l").alias("x"))
        .select(*parts, "x", F.explode("l").alias("y"))
        .where((F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & near)
        .select(*parts, F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    # A variant has few members: all of them lie within radius / 2 bits of it. One of each root will do.
    variants = members.where(F.col("n") > PAIR_ROWS).select(
        *bucket, "fp", "root", F.explode(flips(F.col("fp"), F.col("mask"), radius // 2)).alias("variant")
    )
    stars = (
        variants.groupBy(*bucket, "variant", "root")
        .agg(F.min("fp").alias("fp"))
        .groupBy(*bucket, "variant")
        .agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        .where(F.size("fps") > 1)
        .select(*parts, F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 1 << 30)).alias("b"))
    )
    return materialise(pairs.union(stars).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a < b``: the smallest node it is connected to.

    Alternates two local steps until nothing changes: every node sends its larger neighbours to
    its smallest one, then its smaller neighbours. Each round is written to the shared folder.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    current = edges.select("a", "b")
    before = state(current)
    while before[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = materialise(large, "component-large")
        # Now every edge leads from a node down to a smaller one: group by the larger end.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(
            low.select(F.col("m").alias("x"), F.col("b").alias("y"))
        )
        current = materialise(
            small.where("x < y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), "component-small"
        )
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def groups(marks: DataFrame, radius: int) -> DataFrame:
    """``doc_id, fp, component_id`` from ``doc_id, fp``: the smallest id reachable over links."""
    by_fp = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(by_fp.select("fp"), radius))
    named = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every document: components of fingerprints within ``radius``."""
    return groups(materialise(fingerprints(docs, width), "simhash-marks"), radius)


def distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The different hashes, ascending as unsigned; one token of their own for all wordless texts."""
    found = np.unique(np.concatenate(list(parts))).view(np.int64)
    return found if len(found) else np.array([WORDLESS], np.int64)


def token_set(text: str | None, width: int) -> np.ndarray:
    return distinct(hash_parts(text, width))


def least_overlap(size: int, similar: float) -> int:
    """Tokens that a set of that size shares at least with any set of that Jaccard similarity."""
    return max(1, math.ceil(similar * size - 1e-9))


def frequent_tokens(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are frequent in a share of all texts, ascending, and how frequent. Only an order is taken from them.

    The share is fixed, so how many texts a token may be in before it counts as frequent does not grow with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [token_set(t.as_py(), width) for t in batch.column("text").slice(start, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["token"])

    sample = texts.where(hash_unit("digest") < 1 / ORDER_SHARE).dropDuplicates(["digest"]).select("text")
    counts = sample.mapInArrow(giving_back(run), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    with arrow_batches(texts.sparkSession, BATCH_TEXTS):
        counts = materialise(counts, "near-frequent")
    octave = F.floor(F.log2("n")).cast("int").alias("octave")
    least, kept = 64, 0
    for row in counts.groupBy(octave).count().orderBy(F.desc("octave")).collect():  # at most 64 rows
        kept += row["count"]
        if kept > ORDER_TOKENS:
            break
        least = row["octave"]
    rows = counts.where(octave >= least).toArrow()
    tokens, n = (rows.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of ``64 * PARITY_LONGS`` bits, whether an odd number of the tokens falls on it, as longs.

    Of two sets at most as many bits differ as tokens are in only one of them.
    """
    bits = 64 * PARITY_LONGS
    mixed = (tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    odd = np.bincount((mixed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(texts: DataFrame, width: int, similar: float) -> DataFrame:
    """``node, digest, fp, size, tokens, parity`` of every different text of ``digest, text``.

    The tokens are the first ones of the text in one common order, frequent ones last. There are as many
    that two sets of that similarity have one of them in common, whatever the order.
    """
    frequent, counts = frequent_tokens(texts, width)

    def first_tokens(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
        parts = list(hash_parts(text, width))
        tokens = distinct(parts)
        parity = parities(tokens)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            tokens = tokens[np.lexsort((tokens, np.where(frequent[at] == tokens, counts[at], 0)))]
        return majority(parts), len(tokens), tokens[: len(tokens) - least_overlap(len(tokens), similar) + 1], parity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                fps, sizes, found, parity = zip(*(first_tokens(t.as_py()) for t in part.column("text")), strict=True)
                starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(found)))
                words = np.stack(parity)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), lists, *[pa.array(w) for w in words.T.copy()]],
                    ["digest", "fp", "size", "tokens", *PARITY],
                )

    schema = "digest string, fp long, size int, tokens array<long>, " + ", ".join(f"{p} long" for p in PARITY)
    marks = texts.select("digest", "text").mapInArrow(giving_back(run), schema).dropDuplicates(["digest"])
    with arrow_batches(texts.sparkSession, BATCH_TEXTS):
        return materialise(marks.withColumn("node", F.monotonically_increasing_id()), "near-prefixes")


def bucket_members(marks: DataFrame, roots: DataFrame, first: int | None = None) -> DataFrame:
    """``token, node, size, at, rank, root`` and parities of the texts that share a token of their prefix
    (of its ``first`` tokens) with a text of another root.

    Ranks go from 0 in each bucket, texts with the fewest prefix tokens of their own first: the one
    that others were copied from has few. A large bucket is ranked in parts, whose ranks interleave.
    """
    known = marks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tokens = F.slice("tokens", 1, first) if first else F.col("tokens")
    rows = known.select("node", "root", "size", F.posexplode(tokens).alias("at", "token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    members = materialise(rows.join(small_side(shared.select("token", "n")), "token"), "near-shared")
    common = members.groupBy("node").agg(F.count("*").alias("common"))
    lone = marks.select("node", F.size("tokens").alias("length"), *PARITY).join(common, "node")
    members = members.join(lone.select("node", (F.col("length") - F.col("common")).alias("lone"), *PARITY), "node")
    parts = F.ceil(F.col("n") / RANKED_ROWS)
    members = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    order = Window.partitionBy("token", "part").orderBy("lone", "node")
    rank = (F.row_number().over(order) - 1) * F.col("parts") + F.col("part")
    return materialise(members.withColumn("rank", rank).select("token", "node", "size", "at", "rank", "root", *PARITY), "near-members")


def similar_pairs(pairs: DataFrame, marks: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """Of the pairs ``a, b`` of nodes those whose token sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                sets = []
                for node, text in ((a.as_py(), x), (b.as_py(), y)):
                    if node not in memo:
                        if len(memo) >= 256:
                            memo.clear()
                        memo[node] = token_set(text.as_py(), width)
                    sets.append(memo[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(both / (len(sets[0]) + len(sets[1]) - both) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Only texts that are in a pair move.
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = small_side(marks.select("node", "digest").join(ends, "node", "left_semi"))
    texts = texts.select("digest", "text").join(ends, "digest").dropDuplicates(["digest"])
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(name)), end)
    return pairs.select("a", "b", "x", "y").mapInArrow(giving_back(run), "a long, b long")


def joined_roots(members: DataFrame, start: int, end: int, marks: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """``a < b``: roots that a similar pair joins, of members of ranks from ``start`` to below ``end`` with members of higher ranks."""
    hub = members.where((F.col("rank") >= start) & (F.col("rank") < end))
    hub = hub.select("token", *[F.col(c).alias(f"hub_{c}") for c in ("node", "size", "at", "rank", "root", *PARITY)])
    # The most that the sets can share if this token is the first that they share.
    most = F.least(F.col("size") - F.col("at"), F.col("hub_size") - F.col("hub_at"))
    both = F.col("size") + F.col("hub_size")
    # What is in one set alone is at least the number of parities that differ.
    alone = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"hub_{p}"))) for p in PARITY)
    possible = (most * (1 + similar) >= similar * both - 1e-6) & (alone * (1 + similar) <= (1 - similar) * both + 1e-6)
    pairs = members.join(hub, "token").where((F.col("hub_rank") < F.col("rank")) & (F.col("hub_root") != F.col("root")) & possible)
    ends = [f("node", "hub_node").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b"))]
    of_end = [f("root", "hub_root").alias(n) for f, n in ((F.least, "root_a"), (F.greatest, "root_b"))]
    pairs = materialise(pairs.select(*ends, *of_end).distinct(), "near-pairs")
    near = similar_pairs(pairs.select("a", "b"), marks, texts, width, similar)
    joined = pairs.join(near, ["a", "b"], "left_semi").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    with arrow_batches(marks.sparkSession, BATCH_TEXTS):
        return materialise(joined.distinct(), "near-joined")


def fingerprint_roots(marks: DataFrame, radius: int) -> DataFrame:
    """``node, root`` of the nodes that links between fingerprints join to a smaller one."""
    found = groups(marks.select(F.col("node").alias("doc_id"), "fp"), radius)
    return found.where("doc_id <> component_id").select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))


def moved_up(roots: DataFrame, moved: DataFrame) -> DataFrame:
    """``node, root`` after some roots (``node`` of ``moved``) have been joined to others (its ``root``)."""
    moved = materialise(moved, "near-moved")
    up = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
    roots = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).union(moved)
    return materialise(roots, "near-roots")


def near_groups(texts: DataFrame, width: int, similar: float, radius: int = 2) -> DataFrame:
    """``digest, root`` of all texts (``digest, text``): texts of one group have one root.

    Groups are the connected components over all pairs whose fingerprints differ in at most ``radius``
    bits (``groups``) or whose token sets have that Jaccard similarity. A pair of that similarity
    shares a prefix token, so it lies in a bucket. Fingerprints come first; then the first few tokens of
    the prefixes join most other copies to one of their group; then all tokens are looked at whose texts
    are not of one group yet. In every
    round the members of next ranks are compared with all members of higher rank that are not in one
    group with them; a bucket is done when its members are one group or all its ranks have had
    their turn. So a pair is left out only if it is joined already or its sets are too unlike in size,
    order or parity to be similar.
    """
    marks = prefixes(texts, width, similar)
    roots = materialise(fingerprint_roots(marks, radius), "near-roots")
    members = bucket_members(marks, roots, FIRST_TOKENS)
    roots = moved_up(roots, components(joined_roots(members, 0, 1, marks, texts, width, similar)))
    members = bucket_members(marks, roots)
    start, end = 0, FIRST_RANKS
    while members.head(1):
        roots = moved_up(roots, components(joined_roots(members, start, end, marks, texts, width, similar)))
        members = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ranks = members.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rank").alias("last"))
        open_buckets = ranks.where((F.col("lo") != F.col("hi")) & (F.col("last") > end)).select("token")
        members = materialise(members.join(small_side(open_buckets), "token", "left_semi"), "near-members")
        start, end = end, end * 8
    return marks.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, similar: float = 0.8, radius: int = 2) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Equal texts are one group. Different texts are linked if their fingerprints over ``width``-word
    shingles differ in at most ``radius`` bits, or if the sets of these shingles have a Jaccard
    similarity of ``similar`` or more; every such pair counts (``near_groups``).
    Groups are connected links. Rows that repeat an id and text count once; of a group without ids
    one row stays.
    """
    digest = F.coalesce(F.md5("text"), F.lit("")).alias("digest")
    roots = materialise(near_groups(docs.select(digest, "text"), width, similar, radius), "near-named")
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest)
    # Without their texts: the rows that have to go, and those of which one of several alike stays.
    ids = materialise(docs.groupBy("doc_id", digest).agg(F.count("*").alias("n")), "near-ids")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(roots, "digest")
    order = F.struct(F.col("first_id").isNull(), "first_id", "digest")
    winners = first.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.digest").alias("digest"), F.col("w.first_id").alias("first_id"), F.lit(True).alias("wins"))
    judged = ids.join(winners, "digest", "left").withColumn("stays", F.coalesce(F.col("wins") & F.col("doc_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    special = small_side(judged.where(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "digest", "stays"))
    same = rows["digest"].eqNullSafe(special["digest"]) & rows["row.doc_id"].eqNullSafe(special["doc_id"])
    single = rows.join(special, same, "left_anti").select("row.*")
    one = rows.join(special.where("stays"), same).select(rows["digest"], "row").dropDuplicates(["digest"]).select("row.*")
    return single.unionByName(one)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
