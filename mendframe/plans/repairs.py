"""Repairs, resampling, corruption and generated tables over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators import repair, sampling, synth
from mendframe.plans.diagnosis import KEYS, _fences, _quoted, rounded
from mendframe.plans.inputs import (
    DIRTY_EVENTS_SQL,
    DOCS_SQL,
    SQL_DIMENSIONS,
    embedding_columns,
    EVENT_FEATURES,
    ORDERS_SQL,
    dirty_events,
    docs_labelled,
    embedding_features,
    embeddings_sql,
    labelled_orders,
    table,
)
from mendframe.plans.registry import query

#: Columns of the embeddings as SQL names them.
EMBEDDING_COLUMNS = embedding_columns(SQL_DIMENSIONS)

TWO_52 = 4503599627370496.0


def h(stream, key, seed=K.SEED):
    """SQL digest of a key."""
    return f"md5('{seed}|{stream}|' || CAST({key} AS VARCHAR))"


def u(stream, key, seed=K.SEED):
    """SQL unit draw of a key."""
    return f"(('0x' || substr({h(stream, key, seed)}, 1, 13))::BIGINT / {TWO_52}::DOUBLE)"


def pick(stream, key, size):
    return f"CAST(least(floor({u(stream, key)} * {size}), {size} - 1) AS BIGINT)"


# Column repairs.


@query(
    "impute_median",
    f"""WITH {DIRTY_EVENTS_SQL} SELECT _row_id, round(coalesce(value_n,
      (SELECT quantile_cont(value_n, 0.5) FROM dirty)), 6) AS value_n FROM dirty""",
)
def impute_median(spark, sf):
    df = dirty_events(spark, sf).select("_row_id", "value_n")
    return rounded(repair.impute(df, "value_n", "median_impute"))


@query(
    "impute_mean",
    f"""WITH {DIRTY_EVENTS_SQL} SELECT _row_id, round(coalesce(k_n, (SELECT avg(k_n) FROM dirty)), 6)
      AS k_n FROM dirty""",
)
def impute_mean(spark, sf):
    df = dirty_events(spark, sf).select("_row_id", "k_n")
    return rounded(repair.impute(df, "k_n", "mean_impute"))


_ALL = ["value_n", "k", "k_n", "value_z", "value_s", "rare"]


@query(
    "impute_all",
    f"WITH {DIRTY_EVENTS_SQL} SELECT _row_id, etype, label, "
    + ", ".join(
        f"round(coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM dirty)), 6) AS {c}"
        for c in _ALL
    )
    + " FROM dirty",
)
def impute_all(spark, sf):
    return rounded(repair.impute(dirty_events(spark, sf)))


@query(
    "zero_to_median",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN
      (SELECT quantile_cont(l_discount, 0.5) FROM lineitem WHERE l_discount <> 0)
      ELSE l_discount END, 6) AS l_discount FROM lineitem""",
)
def zero_to_median(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return rounded(repair.zero_to_median(df, "l_discount"))


@query(
    "log1p_transform",
    "SELECT doc_id, round(ln(1 + greatest(n_chars, 0)), 6) AS n_chars FROM documents",
)
def log1p_transform(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    return rounded(repair.log_transform(df, "n_chars"))


@query(
    "drop_null_rows",
    f"""WITH {DIRTY_EVENTS_SQL} SELECT * FROM dirty
      WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*EVENT_FEATURES, "label"))}""",
)
def drop_null_rows(spark, sf):
    return repair.drop_null_rows(dirty_events(spark, sf))


@query(
    "drop_null_rows_subset",
    f"WITH {DIRTY_EVENTS_SQL} SELECT * FROM dirty WHERE k_n IS NOT NULL",
)
def drop_null_rows_subset(spark, sf):
    return repair.drop_null_rows(dirty_events(spark, sf), ["k_n"])


@query("drop_redundant", f"WITH {DIRTY_EVENTS_SQL} SELECT * EXCLUDE (etype) FROM dirty")
def drop_redundant(spark, sf):
    return repair.drop_column(dirty_events(spark, sf), "etype")


@query(
    "dedup_rows",
    f"""WITH {DIRTY_EVENTS_SQL} SELECT min(_row_id) AS _row_id, {KEYS} FROM dirty GROUP BY {KEYS}""",
)
def dedup_rows(spark, sf):
    return repair.remove_duplicates(dirty_events(spark, sf))


@query(
    "dedup_documents",
    """SELECT min(doc_id) AS _row_id, md5(text) AS text_md5, lang, source, n_chars FROM documents
      GROUP BY text, lang, source, n_chars""",
)
def dedup_documents(spark, sf):
    df = table(spark, sf, "documents").withColumnRenamed("doc_id", "_row_id")
    return repair.remove_duplicates(df).withColumn("text_md5", F.md5("text")).drop("text")


def _clip_sql(k):
    low, high = _fences("value", k)
    return f"""WITH b AS (SELECT round_even({low}, 4) AS lo, round_even({high}, 4) AS hi FROM events)
    SELECT event_id, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value
    FROM events, b"""


@query("clip_outliers", _clip_sql(3))
def clip_outliers(spark, sf):
    from mendframe.operators.profile import outlier_profile

    df = table(spark, sf, "events").select("event_id", "value")
    fences = outlier_profile(df, K.IQR_MULTIPLIER, ["value"]).select(
        S.round_even("lower", 4).alias("lower"), S.round_even("upper", 4).alias("upper")
    ).first()
    return repair.clip_column(df, "value", fences["lower"], fences["upper"])


# Every kind of repair, with what it does to the rows and the holes of the table in SQL.
_FULL = [*EVENT_FEATURES, "label"]
_WHOLE = [c for c in _FULL if c != "rare"]


def _holes(columns, where="TRUE"):
    cells = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)
    return f"(SELECT coalesce(sum({cells}), 0)::BIGINT FROM dirty WHERE {where})"


def _present(columns):
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


_N = "(SELECT count(*) FROM dirty)"
_CLASSES = f"(SELECT label, count(*) AS n FROM dirty WHERE {_present(_WHOLE)} GROUP BY label)"
_LO, _HI = f"(SELECT min(n) FROM {_CLASSES})", f"(SELECT max(n) FROM {_CLASSES})"
_OWN = f"(SELECT n FROM {_CLASSES} WHERE label = 1)"
_DISTINCT = f"(SELECT DISTINCT {', '.join(_FULL)} FROM dirty)"
# Columns, recommendation, message, rows after, missing cells after.
_REPAIRS = [
    (_FULL, {"type": "zero_to_nan_impute", "column": "value_z", "strategy": "zero_to_nan_then_median"},
     f"printf('{K.DONE_ZEROS}', (SELECT count(*) FROM dirty WHERE value_z = 0))", _N, _holes(_FULL)),
    (_FULL, {"type": "impute", "column": "value_n", "strategy": "median_impute"},
     f"printf({_quoted(K.DONE_IMPUTE)}, 'median_impute', 'value_n', {_holes(['value_n'])})", _N,
     _holes([c for c in _FULL if c != "value_n"])),
    (_FULL, {"type": "impute", "column": "k_n", "strategy": "mean_impute"},
     f"printf({_quoted(K.DONE_IMPUTE)}, 'mean_impute', 'k_n', {_holes(['k_n'])})", _N,
     _holes([c for c in _FULL if c != "k_n"])),
    (_FULL, {"type": "impute", "column": "rare", "strategy": "drop_rows"},
     f"printf('{K.DONE_DROP_ROWS}', (SELECT count(*) FROM dirty WHERE NOT ({_present(_FULL)})))",
     f"(SELECT count(*) FROM dirty WHERE {_present(_FULL)})", "0"),
    (_FULL, {"type": "log_transform", "column": "value_s", "strategy": "log1p"},
     f"printf({_quoted(K.DONE_LOG)}, 'value_s')", _N, _holes(_FULL)),
    (_FULL, {"type": "drop_redundant", "column": "etype", "strategy": "drop_column"},
     f"printf({_quoted(K.DONE_DROP_COLUMN)}, 'etype')", _N, _holes([c for c in _FULL if c != "etype"])),
    (_WHOLE, {"type": "augment", "target_class": 1, "n_to_add": 150, "strategy": "interpolation"},
     f"printf('{K.DONE_AUGMENT}', 150, '1')", f"{_N} + 150", _holes(_WHOLE)),
    (_WHOLE, {"type": "balance", "target_class": 0, "strategy": "undersample_majority"},
     f"printf('{K.DONE_UNDERSAMPLE}', {_LO})", f"2 * {_LO}", "0"),
    (_WHOLE, {"type": "balance", "target_class": 1, "strategy": "oversample_minority"},
     f"printf('{K.DONE_OVERSAMPLE}', '1', {_HI} - {_OWN})", f"2 * {_HI}", "0"),
    (_FULL, {"type": "remove_duplicates", "strategy": "drop_duplicates"},
     f"printf('{K.DONE_DUPLICATES}', {_N} - (SELECT count(*) FROM {_DISTINCT}))",
     f"(SELECT count(*) FROM {_DISTINCT})", _holes(_FULL).replace("FROM dirty", f"FROM {_DISTINCT}")),
    (_FULL, {"type": "clip_outliers", "column": "k", "strategy": "clip_iqr", "lower": 1.5, "upper": 60.25},
     f"printf({_quoted(K.DONE_CLIP)}, 'k', '1.5', '60.25')", _N, _holes(_FULL)),
]


@query(
    "repair_report",
    f"WITH {DIRTY_EVENTS_SQL}, r AS (" + " UNION ALL ".join(
        f"""SELECT '{rec["type"]}' AS repair, {message} AS message, {_N}::BIGINT AS rows_before,
        ({rows})::BIGINT AS rows_after, {_holes(columns)} AS missing_before, ({holes})::BIGINT AS missing_after"""
        for columns, rec, message, rows, holes in _REPAIRS
    ) + ") SELECT *, rows_before - rows_after AS rows_removed, missing_before - missing_after AS missing_fixed FROM r",
)
def repair_report(spark, sf):
    df = dirty_events(spark, sf)
    rows = [repair.repair_report(df.select("_row_id", *columns), rec) for columns, rec, *_ in _REPAIRS]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "integrity_guard",
    f"""WITH {DOCS_SQL}, c AS (SELECT label, count(*) AS n FROM docs GROUP BY label),
    t AS (SELECT sum(n)::BIGINT AS rows_before, (min(n) * count(*))::BIGINT AS rows_after FROM c)
    SELECT rows_before, rows_after, round_even((rows_before - rows_after)::DOUBLE / rows_before, 4)
      AS deletion_pct, (rows_before - rows_after)::DOUBLE / rows_before <= 0.1 AS accepted FROM t""",
)
def integrity_guard(spark, sf):
    df = docs_labelled(spark, sf)
    return repair.integrity_guard(df, sampling.undersample(df))


@query(
    "sentinel_to_null",
    f"WITH {DIRTY_EVENTS_SQL} SELECT _row_id, nullif(etype, '?') AS etype FROM dirty",
)
def sentinel_to_null(spark, sf):
    return dirty_events(spark, sf).select("_row_id", S.sentinel_to_null("etype").alias("etype"))


_CODES = "CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER)"


@query(
    "encode_categories",
    f"""WITH {DIRTY_EVENTS_SQL}, d AS (SELECT _row_id, nullif(etype, '?') AS etype FROM dirty),
    codes AS (SELECT etype, {_CODES.format(c='etype')} AS code FROM
      (SELECT DISTINCT etype FROM d WHERE etype IS NOT NULL))
    SELECT _row_id, code AS etype FROM d LEFT JOIN codes USING (etype)""",
)
def encode_categories(spark, sf):
    df = dirty_events(spark, sf).select("_row_id", S.sentinel_to_null("etype").alias("etype"))
    return repair.encode_categories(df)


@query(
    "encode_categories_null_code",
    f"""WITH {DIRTY_EVENTS_SQL},
    d AS (SELECT _row_id, coalesce(nullif(etype, '?'), 'nan') AS etype FROM dirty)
    SELECT _row_id, {_CODES.format(c='etype')} AS etype FROM d""",
)
def encode_categories_null_code(spark, sf):
    df = dirty_events(spark, sf).select("_row_id", S.sentinel_to_null("etype").alias("etype"))
    return repair.encode_categories(df, null_as_category=True)


@query(
    "encode_priorities",
    f"SELECT o_orderkey, {_CODES.format(c='o_orderpriority')} AS o_orderpriority FROM orders",
)
def encode_priorities(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return repair.encode_categories(df, ["o_orderpriority"])


# Sampling. `_picked_sql` ranks rows by digest inside their class.


def _ranked_by_hash(source, stream, label="label"):
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h(stream, '_row_id')}, _row_id)"
        f" AS rk, count(*) OVER (PARTITION BY {label}) AS cls_n FROM {source})"
    )


_QUOTAS = """counts AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
    tot AS (SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT - CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT)
      AS train FROM counts),
    exact AS (SELECT label, n, n * train::DOUBLE / total AS x, train FROM counts, tot),
    floors AS (SELECT *, floor(x)::BIGINT AS f, train - sum(floor(x)::BIGINT) OVER () AS spare,
      row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, label) AS pos FROM exact),
    quotas AS (SELECT label, (n - f - CASE WHEN pos <= spare THEN 1 ELSE 0 END)::BIGINT AS quota
      FROM floors)"""


def _split_sql(head, source):
    return f"""WITH {head}, {_QUOTAS.format(source=source)}
    SELECT r._row_id, r.label, r.rk <= q.quota AS holdout
    FROM {_ranked_by_hash(source, 'split')} r JOIN quotas q USING (label)"""


@query("stratified_split", _split_sql(ORDERS_SQL, "ords"))
def stratified_split(spark, sf):
    marked = sampling.mark_holdout(labelled_orders(spark, sf))
    return marked.select("_row_id", "label", F.col("_picked").alias("holdout"))


@query(
    "stratified_split_events",
    _split_sql("ev AS (SELECT event_id AS _row_id, event_type AS label FROM events)", "ev"),
)
def stratified_split_events(spark, sf):
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("_row_id"), F.col("event_type").alias("label")
    )
    return sampling.mark_holdout(df).select("_row_id", "label", F.col("_picked").alias("holdout"))


@query(
    "undersample",
    f"""WITH {DOCS_SQL} SELECT _row_id, n_chars, text_len, label FROM {_ranked_by_hash('docs', 'under')}
    WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM docs GROUP BY label))""",
)
def undersample(spark, sf):
    return sampling.undersample(docs_labelled(spark, sf))


@query(
    "undersample_orders",
    f"""WITH {ORDERS_SQL} SELECT _row_id, price, custkey, label FROM {_ranked_by_hash('ords', 'under')}
    WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ords GROUP BY label))""",
)
def undersample_orders(spark, sf):
    return sampling.balance_or_drop_nulls(labelled_orders(spark, sf))


@query(
    "oversample",
    f"""WITH {DOCS_SQL}, ix AS (SELECT *, row_number() OVER (ORDER BY {h('over', '_row_id')}, _row_id)
      - 1 AS idx FROM docs WHERE label = 0),
    s AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM docs GROUP BY label)) AS big,
      (SELECT count(*) FROM ix) AS own),
    draws AS (SELECT i, {pick('over/draw', 'i', 'own')} AS idx
      FROM (SELECT unnest(range(big - own)) AS i, own FROM s))
    SELECT _row_id, n_chars, text_len, label FROM docs
    UNION ALL SELECT least(0, (SELECT min(_row_id) FROM docs)) - 1 - i, n_chars, text_len, label
    FROM draws JOIN ix USING (idx)""",
)
def oversample(spark, sf):
    return sampling.oversample(docs_labelled(spark, sf), 0)


def _mix_sql(features, add):
    mixed = ", ".join(
        f"round(a.{c} * alpha + b.{c} * (1.0::DOUBLE - alpha), 6) AS {c}" for c in features
    )
    return f"""ix AS (SELECT *, row_number() OVER (ORDER BY {h('mix', '_row_id')}, _row_id) - 1 AS idx
      FROM src WHERE label = 1),
    s AS (SELECT count(*) AS n FROM ix),
    d0 AS (SELECT i, {pick('mix/a', 'i', 'n')} AS x, {pick('mix/b', 'i', '(n - 1)')} AS y,
      {u('mix/alpha', 'i')} AS alpha FROM (SELECT unnest(range({add})) AS i, n FROM s)),
    d AS (SELECT i, x, y + CASE WHEN y >= x THEN 1 ELSE 0 END AS y, alpha FROM d0)
    SELECT least(0, (SELECT min(_row_id) FROM src)) - 1 - i AS _row_id, {mixed}, 1 AS label
    FROM d JOIN ix a ON a.idx = d.x JOIN ix b ON b.idx = d.y"""


_MINOR = "label = 0"


@query(
    "smote_mix",
    f"""WITH {embeddings_sql(_MINOR)}, src AS (SELECT * FROM emb),
    {_mix_sql(EMBEDDING_COLUMNS, "(SELECT count(*) FROM src WHERE label = 0) * 85 // 100 - n")}
    UNION ALL SELECT _row_id, {", ".join(f"round({c}, 6)" for c in EMBEDDING_COLUMNS)}, label FROM src""",
)
def smote_mix(spark, sf):
    from mendframe.operators.diagnose import augmenter_recommendation

    df = embedding_features(spark, sf, _MINOR)
    rec = augmenter_recommendation(df, cap=None).first()
    return rounded(repair.apply_recommendation(df, rec.asDict()))


def _smote_sql():
    vec = "[" + ", ".join(EMBEDDING_COLUMNS) + "]"
    grown = ", ".join(
        f"round(p.{c} + gap * (q.{c} - p.{c}), 6) AS {c}" for c in EMBEDDING_COLUMNS
    )
    kept = ", ".join(f"round({c}, 6)" for c in EMBEDDING_COLUMNS)
    return f"""WITH {embeddings_sql(_MINOR)},
    own AS (SELECT *, {vec} AS vec, row_number() OVER (ORDER BY {h('smote/1', '_row_id')}, _row_id) - 1
      AS idx FROM emb WHERE label = 1),
    near AS (SELECT * FROM (SELECT a._row_id AS id, b._row_id AS neighbour, row_number() OVER
      (PARTITION BY a._row_id ORDER BY round(list_distance(a.vec, b.vec), 6), b._row_id) AS rk
      FROM own a JOIN own b ON a._row_id <> b._row_id) WHERE rk <= {K.SMOTE_NEIGHBOURS}),
    s AS (SELECT count(*) AS n FROM own),
    d AS (SELECT i, {pick('smote/1/row', 'i', 'n')} AS idx,
      {pick('smote/1/near', 'i', K.SMOTE_NEIGHBOURS)} + 1 AS rk, {u('smote/1/gap', 'i')} AS gap
      FROM (SELECT unnest(range((SELECT count(*) FROM emb WHERE label = 0) - n)) AS i, n FROM s))
    SELECT least(0, (SELECT min(_row_id) FROM emb)) - 1 - i AS _row_id, {grown}, 1 AS label
    FROM d JOIN own p USING (idx) JOIN near x ON x.id = p._row_id AND x.rk = d.rk
      JOIN own q ON q._row_id = x.neighbour
    UNION ALL SELECT _row_id, {kept}, label FROM emb"""


@query("smote_knn", _smote_sql())
def smote_knn(spark, sf):
    return rounded(synth.smote(embedding_features(spark, sf, _MINOR)))


@query(
    "nearest_neighbours",
    f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
    near AS (SELECT a.id, b.id AS neighbour, round(list_distance(a.vec, b.vec), 6) AS distance
      FROM v a JOIN v b ON a.id <> b.id)
    SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM (SELECT *, row_number() OVER
      (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM near)
    WHERE rank <= {K.SMOTE_NEIGHBOURS}""",
)
def nearest(spark, sf):
    from mendframe.operators.neighbours import nearest_neighbours

    df = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return nearest_neighbours(df, K.SMOTE_NEIGHBOURS)


@query(
    "shuffled",
    f"""WITH {ORDERS_SQL} SELECT _row_id, price, row_number() OVER (ORDER BY {h('shuffle', '_row_id')}, _row_id) AS position FROM ords""",
)
def shuffled(spark, sf):
    """Orders numbered in their repeatable random order, as an export would hold them."""
    from mendframe.operators.ranking import ordered_index

    # The numbers that the sorted rows get, partition after partition, rise along their order.
    exported = sampling.shuffled(labelled_orders(spark, sf)).withColumn("_at", F.monotonically_increasing_id())
    numbered = ordered_index(exported, ["_at"], "_place")
    return numbered.select("_row_id", "price", (F.col("_place") + 1).alias("position"))


# Golden rows and corruption.

_GOLDEN = f"""gold AS (SELECT *, rk <= {K.GOLDEN_ROWS // 2} AND cls_n >= {K.GOLDEN_ROWS // 2} AS golden
      FROM {_ranked_by_hash('src', 'golden')})"""
_ORDER_SRC = f"{ORDERS_SQL}, src AS (SELECT * FROM ords)"


@query("golden_rows", f"WITH {_ORDER_SRC}, {_GOLDEN} SELECT _row_id, label, golden FROM gold")
def golden_rows(spark, sf):
    marked = sampling.mark_golden(labelled_orders(spark, sf))
    return marked.select("_row_id", "label", F.col("_golden").alias("golden"))


@query(
    "golden_check",
    f"""WITH {_ORDER_SRC}, {_GOLDEN},
    fences AS (SELECT quantile_cont(price, 0.5) AS mid FROM src),
    clipped AS (SELECT _row_id, least(price, mid) AS price, custkey, label FROM src, fences),
    now AS (SELECT * FROM {_ranked_by_hash('clipped', 'under')}
      WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM src GROUP BY label)))
    SELECT g._row_id, CASE WHEN n._row_id IS NULL THEN 'missing'
      WHEN n.price = g.price AND n.label = g.label THEN 'intact' ELSE 'changed' END AS state
    FROM gold g LEFT JOIN now n USING (_row_id) WHERE golden""",
)
def golden_check(spark, sf):
    from mendframe.operators.quantiles import fit_medians

    df = labelled_orders(spark, sf)
    golden = sampling.mark_golden(df).filter("_golden").drop("_golden")
    middle = fit_medians(df, ["price"])["price"]
    repaired = sampling.undersample(repair.clip_column(df, "price", 0.0, middle))
    return sampling.golden_check(golden, repaired)


@query(
    "inject_missing",
    f"""WITH {ORDERS_SQL} SELECT _row_id, label,
      CASE WHEN {u('missing/price', '_row_id')} < 0.15 THEN NULL ELSE price END AS price,
      CASE WHEN {u('missing/custkey', '_row_id')} < 0.15 THEN NULL ELSE custkey END AS custkey
    FROM ords""",
)
def inject_missing(spark, sf):
    return sampling.inject_missing(labelled_orders(spark, sf), 0.15)


def _flip_sql(source, stream, count):
    return f"""SELECT _row_id, CASE WHEN rk <= {count} THEN 1 - label ELSE label END AS label
    FROM (SELECT *, row_number() OVER (ORDER BY {h(stream, '_row_id')}, _row_id) AS rk FROM {source})"""


@query(
    "inject_label_noise",
    f"""WITH {ORDERS_SQL} {_flip_sql("ords", "noise", "(SELECT floor(count(*) * 0.12::DOUBLE) FROM ords)")}""",
)
def inject_label_noise(spark, sf):
    return sampling.flip_labels(labelled_orders(spark, sf), 0.12).select("_row_id", "label")


@query(
    "inject_imbalance",
    f"""WITH {ORDERS_SQL} SELECT _row_id, price, custkey, label FROM {_ranked_by_hash('ords', 'thin')}
    WHERE label <> 1 OR rk <= greatest(1, floor(cls_n * 0.35::DOUBLE))""",
)
def inject_imbalance(spark, sf):
    return sampling.thin_class(labelled_orders(spark, sf), 0.35)


@query(
    "drop_first_of_class",
    f"""WITH {ORDERS_SQL} SELECT _row_id, price, custkey, label FROM (SELECT *,
      row_number() OVER (PARTITION BY label ORDER BY _row_id) AS rk,
      count(*) OVER (PARTITION BY label) AS n FROM ords)
    WHERE label <> 1 OR rk > floor(n * 0.4::DOUBLE)""",
)
def drop_first_of_class(spark, sf):
    return sampling.drop_first_of_class(labelled_orders(spark, sf))


@query(
    "label_flip_fraction",
    f"""WITH {DOCS_SQL} {_flip_sql("docs", "relabel",
      "(SELECT greatest(1, floor(count(*) * 0.3::DOUBLE * 0.3::DOUBLE)) FROM docs)")}""",
)
def label_flip_fraction(spark, sf):
    return sampling.relabel_share(docs_labelled(spark, sf)).select("_row_id", "label")


def _corrupt_sql(features, level):
    recipe = K.CORRUPTION[level]
    holes = ", ".join(
        f"CASE WHEN NOT golden AND {u(f'missing/{c}', '_row_id')} < {recipe['missing']}::DOUBLE"
        f" THEN NULL ELSE {c} END AS {c}"
        for c in features
    )
    return f"""{_GOLDEN},
    holes AS (SELECT _row_id, {holes}, label, golden FROM gold),
    noise AS (SELECT *, row_number() OVER (PARTITION BY golden ORDER BY {h('noise', '_row_id')}, _row_id)
      AS nr FROM holes),
    flipped AS (SELECT * REPLACE (CASE WHEN NOT golden AND nr <= (SELECT floor(count(*) *
      {recipe['noise']}::DOUBLE) FROM holes WHERE NOT golden) THEN 1 - label ELSE label END AS label)
      FROM noise)
    SELECT _row_id, {", ".join(features)}, label, golden FROM {_ranked_by_hash('flipped', 'thin')}
    WHERE label <> 1 OR rk <= greatest(1, floor(cls_n * {recipe['keep']}::DOUBLE))"""


@query("corrupt_table", f"WITH {_ORDER_SRC}, {_corrupt_sql(['price', 'custkey'], 'medium')}")
def corrupt_table(spark, sf):
    return sampling.corrupt(labelled_orders(spark, sf), "medium").withColumnRenamed("_golden", "golden")


def _normal_sql(stream):
    return (
        f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(stream + '/r', '_row_id')}))"
        f" * cos(6.283185307179586::DOUBLE * {u(stream + '/a', '_row_id')})"
    )


def _generated_sql(informative, redundant, separation):
    names = [f"feature_{i}" for i in range(synth.N_FEATURES)]
    cells = []
    for i, name in enumerate(names):
        if i < informative:
            sign = separation if i % 2 == 0 else -separation
            cells.append(f"{_normal_sql(name)} + (label * 2 - 1) * ({sign})::DOUBLE AS {name}")
        elif i >= informative + redundant:
            cells.append(f"{_normal_sql(name)} AS {name}")
    mixes = [
        f"(feature_{i % informative} + feature_{(i + 1) % informative}) / 2 AS {names[informative + i]}"
        for i in range(redundant)
    ]
    return f"""keys AS (SELECT o_orderkey AS _row_id FROM orders),
    lab AS (SELECT _row_id, CAST({u('label', '_row_id')} < 0.5 AS INTEGER) AS label FROM keys),
    src AS (SELECT _row_id, label, {", ".join(names)} FROM (SELECT *, {", ".join(mixes)} FROM
      (SELECT _row_id, label, {", ".join(cells)} FROM lab)))"""


_GEN = [f"feature_{i}" for i in range(synth.N_FEATURES)]
_GEN_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _GEN)


def _order_keys(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("_row_id"))


@query(
    "synthetic_table",
    f"""WITH {_generated_sql(*K.ARCHETYPES['fraud'])}, out AS (WITH {_corrupt_sql(_GEN, 'hard')})
    SELECT _row_id, {_GEN_ROUND}, label, golden, 'fraud' AS archetype FROM out""",
)
def synthetic_table(spark, sf):
    df = synth.archetype_table(_order_keys(spark, sf), "fraud", "hard")
    return rounded(df).withColumnsRenamed({"_golden": "golden", "_archetype": "archetype"})


@query(
    "synthetic_fallback",
    f"""WITH {_generated_sql(5, 2, 0.8)},
    holes AS (SELECT _row_id, label, {", ".join(
        f"CASE WHEN {u(f'missing/{c}', '_row_id')} < 0.12 THEN NULL ELSE {c} END AS {c}"
        if i < 8 else c for i, c in enumerate(_GEN))} FROM src)
    SELECT _row_id, {_GEN_ROUND}, label FROM (SELECT *,
      row_number() OVER (PARTITION BY label ORDER BY _row_id) AS rk,
      count(*) OVER (PARTITION BY label) AS n FROM holes)
    WHERE label <> 1 OR rk > floor(n * 0.4::DOUBLE)""",
)
def synthetic_fallback(spark, sf):
    from mendframe.sources.catalogue import CATALOGUE

    return rounded(synth.fallback_table(_order_keys(spark, sf), CATALOGUE["diabetes_pima"]))


