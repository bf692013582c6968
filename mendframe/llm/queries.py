"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm import ann, bm25, bpe, convtree, fim, langid, mixing, piece, simhash, tokencount, toxicity, urls, wavelet
from mendframe.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_WEIGHTS = [1, 2, 3]
MIX_SEED = 20

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


TOXIC_FROM = 0.7

#: Token ids as text.
DECIMAL = [str(i) for i in range(1 << 16)]


@query("op1_learned_partitions")
def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by inner product."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op2_language_kernel")
def language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = langid.predict(docs, langid.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op3_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document contributes to a mix of sources with weights 1, 2, 3, repeating."""
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLES["op3_source_mix"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{MIX_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k FROM documents),
  s AS (SELECT s, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY s) - 1) % 3 AS w FROM d GROUP BY s),
  l AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
  c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
    sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM l),
  t AS (SELECT s, source_size, least(cap, max((total - closed) / open_w) OVER () * w) AS target FROM c),
  b AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t USING (s)),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::BIGINT AS taken FROM e"""


@query("op4_wavelet_shards")
def wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet-matrix files and read back from them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return wavelet.read_shards(wavelet.store_tokens(table(spark, sf_dir, "documents"), path, end_id=1))


@query("op5_toxicity_scores")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from those outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = toxicity.predict(docs, toxicity.fit(docs.where(~out), labels.where(~out)))
    predicted = F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0)
    return found.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


def id_digests(ids: list[int], decoded: str) -> tuple[int, str, str]:
    joined = ",".join(map(DECIMAL.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@query("op6_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the transducer and exact merges, then decoded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, id_digests, schema)


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and score of the best unigram segmentation of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_bm25_top10")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to every document whose id is divisible by 100, by BM25."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bm25.search(docs, F.col("doc_id") % 100 == 0, k=10)
    return found.withColumn("score", F.round("score", 6))


ORACLES["op8_bm25_top10"] = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
  tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL),
  dl AS (SELECT doc_id, sum(tf)::DOUBLE AS len FROM tf GROUP BY doc_id),
  st AS (SELECT count(*) AS n, avg(len) AS mean FROM dl),
  df AS (SELECT w, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY w),
  hits AS (SELECT q.doc_id AS query_id, d.doc_id, sum(idf * (d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean)))) AS score
    FROM tf q JOIN tf d USING (w) JOIN df USING (w) JOIN dl ON dl.doc_id = d.doc_id, st
    WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits) WHERE rank <= 10"""


@query("op9_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url judged by domain rules, or else by boosted trees on lexical features."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op10_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, links at 2 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op11_prefix_tree")
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sequence of first turns of the rebuilt conversations, with totals of its subtree."""
    return convtree.prefix_tree(table(spark, sf_dir, "conversations"), block=100, heads=6)


ORACLES["op11_prefix_tree"] = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, (c & 1) * 3988292384))) AS t),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
  o AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
  c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h FROM o, crc),
  k AS (SELECT c.*, least(h, coalesce(o.own, 0)) AS shared FROM c LEFT JOIN o ON o.conv_id = c.base),
  r AS (SELECT k.conv_id, pos + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base WHERE pos < h
    UNION ALL SELECT k.conv_id, shared + pos - h + 1, role, text FROM k JOIN t USING (conv_id) WHERE pos >= h),
  p AS (SELECT conv_id, depth, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node,
      max(depth) OVER (PARTITION BY conv_id) AS len FROM r),
  q AS (SELECT *, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM p
    UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM r WHERE r.conv_id = o.conv_id), 0), NULL FROM o),
  n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n_convs, min(conv_id) AS conv_id,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256 FROM q GROUP BY node),
  f AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
  g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (node)),
  s AS (SELECT q.node, sum((g.n_children = 0)::INT) AS n_leaves, sum((g.n_convs - 1) * g.size) AS saved FROM g JOIN q ON q.conv_id = g.conv_id AND q.depth <= g.depth GROUP BY q.node)
SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, g.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends_sha256 FROM g JOIN s USING (node) LEFT JOIN n u ON u.node = g.parent"""


def spaced_digests(ids: list[int], decoded: str) -> tuple[int, str, str]:
    joined = " ".join(map(DECIMAL.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@query("op12_piece_round_trip")
def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by backtracking over compatible pieces, then decoded."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    names, types = ["n_tokens", "ids_sha256", "decoded_sha256"], ["long", "string", "string"]
    return piece.round_trip(table(spark, sf_dir, "documents"), path, spaced_digests, names, types)


@query("op13_fill_in_middle")
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three by the learned rank index, and restored from its output."""
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)
    restored = fim.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
  h AS (SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT % (len(t) + 1) AS x, ('0x' || substr(s, 9, 8))::BIGINT % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(s, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(s, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
  c AS (SELECT doc_id, text, n, form, array_to_string(t[1:least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(t[greatest(x, y) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c"""
