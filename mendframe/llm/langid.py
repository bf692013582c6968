"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of distinct character n-grams
(lengths 1 to ``GRAMS``) they share, divided by the geometric mean of their own numbers. Texts are
lower-cased and every run of non-letters becomes one space, so only spelling counts. A bounded
sample of labelled texts gives the landmarks and the ridge regressions, one per language against
the rest, in the Nyström feature space of the landmarks. Scoring a batch is two matrix products:
presence of landmark n-grams times landmarks, then kernel values times regression weights.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything
when no language can be learned; rows with a null language, id or text are not learned from;
repeated rows are judged alike; whole texts are read, in pieces whose n-grams are united.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import giving_back, hash_unit

UNKNOWN = "und"
#: Longest n-gram; three code points of 21 bits fill one 64-bit key.
GRAMS = 3
#: Texts per language the regressions are fitted on, and those of them that become landmarks.
TRAIN_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 24
#: Landmarks are taken from texts of this many characters first.
LANDMARK_CHARS = (200, 20_000)
#: More distinct labels than this are refused: the sample would no longer be small.
MAX_LANGUAGES = 400
RIDGE = 1e-3
PIECE = 1 << 20
ROWS = 64


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def normalised(text: str | None) -> np.ndarray | None:
    """Code points of the lower-cased text with runs of non-letters as one space; None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
    return points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]


def grams(points: np.ndarray) -> np.ndarray:
    """The distinct n-grams as sorted 64-bit keys; keys of different lengths never meet."""
    found = []
    for start in range(0, len(points), PIECE):
        part = points[start : start + PIECE + GRAMS - 1]
        keys, rows = part, [part]
        for n in range(1, GRAMS):
            keys = keys[:-1] << 21 | part[n:]
            rows.append(keys)
        found.append(np.unique(np.concatenate(rows)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Landmarks:
    """The n-grams of the landmarks, and for each which landmarks hold it (scaled by their norm)."""

    keys: np.ndarray
    holds: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str]) -> Landmarks:
        sets = [grams(p) for t in texts if (p := normalised(t)) is not None]
        keys = np.unique(np.concatenate(sets))
        holds = np.zeros((len(keys), len(sets)), np.float32)
        for j, found in enumerate(sets):
            holds[np.searchsorted(keys, found), j] = 1 / np.sqrt(len(found))
        return cls(keys, holds)

    def kernel(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Kernel values with every landmark, ``ROWS`` texts at a time; NaN for texts without letters."""
        held: list[np.ndarray | None] = []
        for text in texts:
            points = normalised(text)
            held.append(None if points is None else grams(points))
            if len(held) == ROWS:
                yield self._product(held)
                held = []
        if held:
            yield self._product(held)

    def _product(self, sets: list[np.ndarray | None]) -> np.ndarray:
        present, norm = np.zeros((len(sets), len(self.keys)), np.float32), np.full((len(sets), 1), np.nan)
        for i, found in enumerate(sets):
            if found is not None:
                at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                present[i, at[self.keys[at] == found]] = 1
                norm[i] = np.sqrt(len(found))
        return present @ self.holds / norm


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Languages and scores (the winning regression's value, cut to 0..1) of batches of texts."""
        names = np.array([*self.languages, UNKNOWN], object)
        for kernel in self.landmarks.kernel(texts):
            blank = np.isnan(kernel[:, 0])
            values = np.nan_to_num(kernel) @ self.weights
            best = np.where(blank, len(self.languages), values.argmax(axis=1))
            yield names[best].tolist(), np.where(blank, 0.0, np.clip(values.max(axis=1), 0, 1))


def regression(landmarks: Landmarks, kernel: np.ndarray, labels: np.ndarray, languages: list[str]) -> np.ndarray:
    """Landmark weights of one ridge regression per language, by way of the Nyström features."""
    own = landmarks.holds.T.astype(np.float64) @ landmarks.holds.astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    kept = values > 1e-6 * values.max()
    project = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ project
    targets = (labels[:, None] == np.array(languages, object)[None, :]).astype(np.float64)
    # Every language counts alike, however many texts it had.
    share = (targets / np.maximum(targets.sum(axis=0), 1)).sum(axis=1, keepdims=True) / len(languages)
    gram = features.T @ (features * share) + RIDGE * np.eye(features.shape[1])
    return project @ np.linalg.solve(gram, features.T @ (targets * share))


def fit(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """Learns from rows with ``doc_id, text, lang``; None if no language has a usable text.

    Per language the ``per_language`` rows of smallest id hash are taken; ids and languages are
    ranked without their texts, and ranks are cut in each task before they are shuffled.
    """
    usable = labelled.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    low, high = LANDMARK_CHARS
    order = Window.partitionBy("lang").orderBy(hash_unit("doc_id", seed=11), "doc_id")
    fit_length = F.length("text").between(low, high)
    ranked = usable.select("doc_id", "lang", fit_length.alias("mid"))
    picked = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).collect()
    languages = sorted({r["lang"] for r in picked})
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} can be learned")
    chosen = {}
    for row in sorted(picked, key=lambda r: (not r["mid"], r["r"])):
        chosen.setdefault(row["lang"], [])
        if len(chosen[row["lang"]]) < landmarks:
            chosen[row["lang"]].append(row["doc_id"])
    spark, kind = labelled.sparkSession, labelled.schema["doc_id"].dataType.simpleString()
    marks = {i for ids in chosen.values() for i in ids}
    ids = spark.createDataFrame(
        [(i, i in marks) for i in sorted({r["doc_id"] for r in picked})], f"doc_id {kind}, mark boolean"
    )
    sample = usable.join(F.broadcast(ids), "doc_id")
    held = Landmarks.of(r["text"] for r in sample.where("mark").select("doc_id", "lang", "text").orderBy("doc_id", "lang", "text").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [*held.kernel(t.as_py() for t in batch.column("text"))]
            if rows:
                values = np.concatenate(rows).astype(np.float64)
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "kernel": pa.array(list(values))})

    rows = sample.select("lang", "text").mapInArrow(giving_back(run), "lang string, kernel array<double>").collect()
    kernel, labels = np.array([r["kernel"] for r in rows]), np.array([r["lang"] for r in rows], object)
    order = np.lexsort([*kernel.T[:8], labels.astype(str)])
    return Model(languages, held, regression(held, kernel[order], labels[order], languages))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document from its text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for found, values in model.predict(t.as_py() for t in batch.column("text")):
                names += found
                scores.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` with a recognised language that scores ``least`` or more, all columns kept."""
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(0, bool)
            for names, scores in shared.value.predict(t.as_py() for t in batch.column("text")):
                kept = np.append(kept, (np.array(names, object) != UNKNOWN) & (scores >= least))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
