"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are words and word beginnings that fire in a text (a fixed list, and those whose presence
goes with the label in a bounded labelled sample), and patterns such as shouting. The label model
holds, per voter, how often it fires in toxic and in clean texts, and how voters go together within
a class: a voter that repeats others counts only by its share. It is estimated by EM over labelled
and unlabelled texts together, labelled ones fixed. Its posteriors are the labels a logistic
regression is trained on; only that regression scores documents, from their text alone.

Defined results: null and empty texts get the score of a text in which nothing fires; repeated
rows are scored alike; without labels of both kinds the fixed list and the patterns vote alone, with
preset rates; rows without an id are scored but never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import giving_back, hash_sample
from mendframe.session import materialise

#: Fixed value: insults that vote from the start.
SEED_WORDS = (
    "idiot moron imbecile stupid dumb fool loser scum trash clown jerk pathetic worthless disgusting"
    " filthy vermin bastard bitch whore slut asshole dickhead retard shit fuck"
).split()
#: Labelled and unlabelled texts the model is fitted on (about), each.
TRAIN_ROWS = 20_000
#: Voters and further classifier features chosen from the labelled sample.
VOTERS, FEATURES = 600, 3000
#: A voter fires in this many toxic sample texts at least, an additional feature in this many texts.
MIN_TOXIC, MIN_TEXTS = 4, 20
#: How far above chance (in units of the log-likelihood ratio) an event must go with the label.
SURE = 4.0
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
#: Voters are treated as repeating each other from this correlation within a class on.
CORRELATED = 0.7
ROUNDS, STEPS, RIDGE = 25, 300, 1e-6
PRESET_PRIOR, PRESET_TOXIC, PRESET_CLEAN = 0.1, 0.2, 0.002
MEMO_WORDS = 300_000
WORDS = re.compile(r"[^\W\d_]+").findall
PATTERNS = {
    "!shouts": re.compile(r"!!").search,
    "!masked": re.compile(r"[A-Za-z][*@#$]{2,}[A-Za-z]").search,
    "!capitals": re.compile(r"\b[A-Z]{3,}\W+[A-Z]{3,}\b").search,
    "!address": re.compile(r"\b[Yy]ou(?:'re| are) (?:an? |such |all )").search,
}


def words_of(text: str) -> set[str]:
    return set(WORDS(text.lower()))


def forms_of(word: str) -> list[str]:
    """A word and its proper beginnings, marked as such."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def patterns_of(text: str) -> list[str]:
    return [name for name, found in PATTERNS.items() if found(text)]


def events_of(text: str) -> set[str]:
    """Everything that may vote in a text."""
    return {*chain.from_iterable(map(forms_of, words_of(text))), *patterns_of(text)}


def association(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed log-likelihood ratio of presence against the label; positive if more frequent in toxic texts."""
    counts = np.array([[toxic, clean], [n_toxic - toxic, n_clean - clean]], float)
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / max(1, n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(counts > 0, counts * np.log(counts / expected), 0.0)
    return 2 * parts.sum(axis=(0, 1)) * np.where(counts[0, 0] >= expected[0, 0], 1, -1)


def event_counts(labelled: DataFrame) -> DataFrame:
    """``event, toxic, clean``: in how many texts of the sample each event occurs; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def rows():
            events = [*seen[0].keys() | seen[1].keys()]
            out = {"event": pa.array(events, pa.string())}
            out |= {n: pa.array([seen[y][e] for e in events], pa.int64()) for n, y in (("toxic", 1), ("clean", 0))}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                seen[label].update(events_of(text.as_py() or ""))
                if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                    yield rows()
                    seen[0].clear()
                    seen[1].clear()
        yield rows()

    rows = labelled.select("text", "label").mapInArrow(giving_back(run), "event string, toxic long, clean long")
    return rows.groupBy("event").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Firings:
    """Which events fire in which text, as two parallel arrays sorted by text."""

    n: int
    row: np.ndarray
    event: np.ndarray

    def sums(self, weight: np.ndarray, events: int) -> np.ndarray:
        return np.bincount(self.event, weight[self.row], minlength=events)

    def scores(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, value[self.event], minlength=self.n)


@dataclass
class LabelModel:
    """Firing rates of each voter in both classes, the share it counts by, and the toxic share."""

    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, fired: Firings) -> np.ndarray:
        absent = np.log((1 - self.toxic) / (1 - self.clean)) * self.share
        present = np.log(self.toxic / self.clean) * self.share - absent
        odds = math.log(self.prior / (1 - self.prior)) + absent.sum() + fired.scores(present)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def repeated_share(fired: Firings, rate: np.ndarray) -> np.ndarray:
    """1 / (1 + the sum of a voter's correlations with others within one class), from joint firings."""
    joint = np.zeros((len(rate), len(rate)))
    for events in np.split(fired.event, np.flatnonzero(np.diff(fired.row)) + 1):
        joint[np.ix_(events, events)] += 1 / max(1, fired.n)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    related = (joint - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    return 1 / (1 + np.where(related >= CORRELATED, np.minimum(related, 1), 0).sum(axis=1))


def fit_label_model(fired: Firings, voters: int, labels: np.ndarray, start: LabelModel) -> LabelModel:
    """EM over all texts; ``labels`` holds 1, 0 or -1 (unknown). Known labels stay fixed."""
    model, known = start, labels >= 0
    toxic_rows = Firings(*restricted(fired, labels == 1))
    clean_rows = Firings(*restricted(fired, labels == 0))
    if known.any():
        # Correlations within a class come from texts whose class is known.
        rates = [np.bincount(f.event, minlength=voters) / max(1, f.n) for f in (toxic_rows, clean_rows)]
        share = np.minimum(repeated_share(toxic_rows, rates[0]), repeated_share(clean_rows, rates[1]))
        model = LabelModel(model.toxic, model.clean, share, model.prior)
    for _ in range(ROUNDS):
        p = model.posterior(fired)
        p[known] = labels[known]
        toxic, n_toxic = fired.sums(p, voters), p.sum()
        clean, n_clean = fired.sums(1 - p, voters), (1 - p).sum()
        # Smoothed towards the rate of all texts, so a voter that never fires says nothing either way.
        rate = (toxic + clean + 0.5) / (fired.n + 1)
        model = LabelModel(
            (toxic + rate) / (n_toxic + 1), (clean + rate) / (n_clean + 1), model.share, (n_toxic + 1) / (fired.n + 2)
        )
    return model


def restricted(fired: Firings, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The firings in some of the texts, which are numbered anew."""
    number, kept = np.cumsum(rows) - 1, rows[fired.row]
    return int(rows.sum()), number[fired.row[kept]], fired.event[kept]


def fit_linear(fired: Firings, events: int, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels with a small ridge, by L-BFGS; the last weight is the intercept."""
    mean = min(max(float(target.mean()), 1e-4), 1 - 1e-4)
    w = np.zeros(events + 1)
    w[-1] = math.log(mean / (1 - mean))
    ridge = np.append(np.full(events, RIDGE), 0.0)

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        odds = fired.scores(at[:-1]) + at[-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - target
        slope = np.append(fired.sums(error, events), error.sum()) / fired.n + ridge * at
        return float(np.mean(np.logaddexp(0, odds) - target * odds) + 0.5 * (ridge * at * at).sum()), slope

    value, slope = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, used = -slope, []
        for s, y in reversed(memory):
            a = (s @ step) / (s @ y)
            used.append(a)
            step = step - a * y
        if memory:
            s, y = memory[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(memory, reversed(used), strict=True):
            step = step + (a - (y @ step) / (s @ y)) * s
        descent, size = slope @ step, 1.0
        while True:
            new_value, new_slope = loss(w + size * step)
            if new_value <= value + 1e-4 * size * descent or size < 1e-10:
                break
            size /= 2
        s, y = size * step, new_slope - slope
        if s @ y > 1e-14:
            memory = [*memory, (s, y)][-10:]
        gain, w, value, slope = value - new_value, w + s, new_value, new_slope
        if gain < 1e-9:
            break
    return w


@dataclass
class Model:
    """The linear classifier: a weight per event and an intercept."""

    events: dict[str, float]
    intercept: float

    def scorer(self) -> Scorer:
        return Scorer(self)

    def score(self, text: str) -> float:
        return self.scorer().score(text)


class Scorer:
    """Scores texts of one task; which events a word sets off is kept while the task lasts."""

    def __init__(self, model: Model):
        self.events, self.intercept = model.events, model.intercept
        self.memo: dict[str, tuple] = {}

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.array([self.score(t or "") for t in texts], float)

    def score(self, text: str) -> float:
        words = words_of(text)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for word in words.difference(self.memo):
            self.memo[word] = tuple(f for f in forms_of(word) if f in self.events)
        fired = {*chain.from_iterable(map(self.memo.__getitem__, words)), *patterns_of(text)}
        odds = self.intercept + math.fsum(self.events.get(e, 0.0) for e in fired)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def firings(texts: Iterable[str | None], events: dict[str, int]) -> Iterator[list[int]]:
    for text in texts:
        yield sorted(events[e] for e in events_of(text or "") if e in events)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``docs`` (``doc_id, text``), some of which have a row in ``labels`` (``doc_id, toxic``).

    Rows with one id count with the larger label. At most about twice ``train_rows`` texts are
    used, chosen by id hash; of each only the numbers of the events that fire reach the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = known.agg(F.max("toxic").cast("int").alias("label"))
    named = docs.select("doc_id", "text").where("doc_id is not null")
    ids = named.select("doc_id")
    picked = hash_sample(ids.join(known, "doc_id"), train_rows, "doc_id", seed=5)
    others = hash_sample(ids.join(known, "doc_id", "left_anti"), train_rows, "doc_id", seed=6)
    chosen = picked.unionByName(others.withColumn("label", F.lit(-1))).distinct()
    rows = [(r["doc_id"], r["label"]) for r in chosen.collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = docs.sparkSession.createDataFrame(rows, f"doc_id {kind}, label int")
    sample = named.join(F.broadcast(small), "doc_id")
    n_toxic, n_clean = sum(y == 1 for _, y in rows), sum(y == 0 for _, y in rows)

    events = list(dict.fromkeys([*SEED_WORDS, *PATTERNS]))
    if n_toxic and n_clean:
        counts = materialise(event_counts(sample.where("label >= 0")), "toxicity-events")
        n_events = counts.where(F.col("toxic") + F.col("clean") >= MIN_TOXIC).count()
        counted = counts.where((F.col("toxic") >= MIN_TOXIC) | (F.col("toxic") + F.col("clean") >= MIN_TEXTS))
        found = sorted((r["event"], r["toxic"], r["clean"]) for r in counted.collect())
        names = [e for e, _, _ in found]
        toxic, clean = np.array([x[1:] for x in found], float).reshape(-1, 2).T
        value = association(toxic, clean, n_toxic, n_clean)
        # So many events are looked at that some go with the label by chance: the bar rises with them.
        bar = 2 * math.log(max(1, n_events)) + SURE
        ranked = [names[i] for i in np.argsort(-value, kind="stable") if value[i] >= bar and toxic[i] >= MIN_TOXIC]
        events = list(dict.fromkeys([*events, *ranked[:VOTERS]]))
        voters = len(events)
        rest = [names[i] for i in np.argsort(-np.abs(value), kind="stable") if abs(value[i]) >= bar]
        events = list(dict.fromkeys([*events, *rest[:FEATURES]]))
    else:
        voters = len(events)
    number = {e: i for i, e in enumerate(events)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = list(firings((t.as_py() for t in batch.column("text")), number))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.list_(pa.int32()))],
                ["doc_id", "label", "events"],
            )

    fired_rows = sorted(
        sample.select("doc_id", "label", "text").mapInArrow(giving_back(run), f"doc_id {kind}, label int, events array<int>").collect()
    )
    label = np.array([r["label"] for r in fired_rows], int)
    row = np.repeat(np.arange(len(fired_rows)), [len(r["events"]) for r in fired_rows])
    event = np.fromiter(chain.from_iterable(r["events"] for r in fired_rows), int, len(row))
    everything = Firings(len(fired_rows), row, event)
    votes = Firings(len(fired_rows), row[event < voters], event[event < voters])
    rates = np.full(voters, PRESET_TOXIC), np.full(voters, PRESET_CLEAN)
    start = LabelModel(*rates, np.ones(voters), PRESET_PRIOR)
    if n_toxic and n_clean:
        start = fit_label_model(Firings(*restricted(votes, label >= 0)), voters, label[label >= 0], start)
    model = fit_label_model(votes, voters, label, start) if len(fired_rows) else start
    target = model.posterior(votes)
    w = fit_linear(everything, len(events), target) if len(target) else np.zeros(len(events) + 1)
    return Model(dict(zip(events, w[:-1].tolist(), strict=True)), float(w[-1]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document from its text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = scorer.scores(t.as_py() for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, score double")


def keep_below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = scorer.scores(t.as_py() for t in batch.column("text"))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(giving_back(run), docs.schema)
