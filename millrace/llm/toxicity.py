"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: each logistic model sees which
words of a selected vocabulary a document holds, and the probabilities of the
categories before it. While training, those probabilities are out-of-fold
predictions, so that a later model does not lean on an earlier one's fit.
The models are fitted on a bounded sample of labelled rows, each fold in a task of
its own, to the optimum by Newton steps; every document is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import numbered, settle

#: Bounds of the fit: labelled rows (those of least id hash) and words (most frequent first).
SAMPLE_ROWS, VOCABULARY, MIN_DOCS = 10_000, 30_000, 5
FOLDS = 3
#: Rows whose words a task holds at a time.
ROWS = 256
#: Weight of the Gaussian prior against one row.
PRIOR = 10.0
#: Beginnings of words of these lengths are features as well: they tell forms and compounds of a word.
BEGINNINGS = (4, 5)
_WORD = re.compile(r"\w+")
_SEGMENT = 4 << 20


def word_set(text: str | None) -> set[str]:
    """The different lower-case words of a whole text, and the beginnings of the longer ones."""
    text, found, at = text or "", set(), 0
    while at < len(text):
        end = len(text)
        if end - at > _SEGMENT:
            cut = text.find(" ", at + _SEGMENT)
            end = cut if cut > 0 else end
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    for n in BEGINNINGS:
        found |= {"^" + w[:n] for w in found if len(w) > n and w[0] != "^"}
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ROWS rows, as words as Python strings take many times a text's size."""
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which to say yes: that of the best F1 on out-of-fold
    predictions, half-way to the next lower one; one half where one class is missing."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # equal probabilities stand or fall together
    i = int(f1.argmax())
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0.0)) / 2)


@dataclass
class Logistic:
    """Weights of words, of earlier probabilities (as log-odds) and a constant."""

    words: np.ndarray
    before: np.ndarray
    bias: float

    def odds(self, held: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        lengths = [len(h) for h in held]
        rows = np.repeat(np.arange(len(held)), lengths)
        at = np.concatenate(held) if held else np.empty(0, np.int64)
        return np.bincount(rows, self.words[at], minlength=len(held)) + before @ self.before + self.bias


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(held: list[np.ndarray], before: np.ndarray, y: np.ndarray, words: int, rounds: int = 30) -> Logistic:
    """Logistic regression with a Gaussian prior on all but the constant, by Newton steps
    whose directions come from conjugate gradients. Rows of one class only give a
    constant: zero if none is positive, else the smoothed share."""
    n, k = len(y), before.shape[1]
    if not n or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n and y.max() else 1e-4
        return Logistic(np.zeros(words), np.zeros(k), float(log_odds(np.array([rate]))[0]))
    lengths = np.array([len(h) for h in held])
    rows, at = np.repeat(np.arange(n), lengths), np.concatenate(held)
    prior = np.full(words + k + 1, PRIOR)
    prior[-1] = 0.0

    def odds(t: np.ndarray) -> np.ndarray:
        return np.bincount(rows, t[at], minlength=n) + before @ t[words : words + k] + t[-1]

    def back(e: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(at, e[rows], minlength=words), before.T @ e, [e.sum()]))

    def loss(z: np.ndarray, t: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + (prior * t * t).sum() / 2)

    theta = np.zeros(words + k + 1)
    theta[-1] = log_odds(np.array([y.mean()]))[0]
    z = odds(theta)
    start = None
    for _ in range(rounds):
        p = probability(z)
        g = back(p - y) + prior * theta
        size = float(np.sqrt(g @ g))
        start = size if start is None else start
        if size <= 1e-5 * max(1.0, start):
            break
        w = np.maximum(p * (1 - p), 1e-10)
        scale = np.concatenate((np.bincount(at, w[rows], minlength=words), (before * before).T @ w, [w.sum()])) + prior
        scale[scale <= 0] = 1.0
        step, r = np.zeros_like(theta), -g
        d = r / scale
        old = r @ d
        goal = size * min(0.1, np.sqrt(size / start))
        for _ in range(50):
            h = back(w * odds(d)) + prior * d
            a = old / (d @ h)
            step += a * d
            r = r - a * h
            if np.sqrt(r @ r) <= goal:
                break
            new = r @ (r / scale)
            d, old = r / scale + (new / old) * d, new
        turn, now, share = odds(step), loss(z, theta), 1.0
        while loss(z + share * turn, theta + share * step) > now + 1e-4 * share * (g @ step) and share > 1e-6:
            share /= 2
        theta, z = theta + share * step, z + share * turn
    return Logistic(theta[:words], theta[words : words + k], float(theta[-1]))


@dataclass
class Chain:
    """Fitted chain: the vocabulary, and one model and one threshold a category, in order."""

    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Logistic] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def places(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([i for w in word_set(text) if (i := get(w)) is not None], np.int64)

    def predict(self, held: list[np.ndarray]) -> np.ndarray:
        """Probabilities, one column a category."""
        out = np.zeros((len(held), 0))
        for model in self.models:
            p = probability(model.odds(held, log_odds(out)))
            out = np.column_stack((out, p))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY, min_docs: int = MIN_DOCS, folds: int = FOLDS, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Fit the chain on at most ``rows`` labelled documents and ``vocabulary`` words.

    Labels of a repeated id are merged by their maximum; a null label leaves the
    row out of that category's model. Of rows that repeat an id one counts, that of
    the least text hash. Without labelled rows every probability is near zero.
    """
    spark, names = docs.sparkSession, [f"y{i}" for i in range(len(categories))]
    marked = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(*[F.max(F.col(f"`{c}`").cast("int")).alias(y) for c, y in zip(categories, names)])
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows)
    said = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen.select("id")), "id")
    texts = said.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = pa.array([sorted(word_set(t.as_py())) for t in batch.column(1)], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), sets], names=["id", "words"])

    sample = settle(texts.mapInArrow(words, "id long, words array<string>"), "labelled")
    frequent = sample.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= min_docs).orderBy(F.desc("count"), "word").limit(vocabulary)
    known = {r.word: i for i, r in enumerate(frequent.collect())}
    shared = spark.sparkContext.broadcast(known)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in _slices(batches):
            found = [[i for w in ws if (i := get(w)) is not None] for ws in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["id", "places"])

    # At most ``rows`` of them, each the places of its words in the vocabulary.
    placed = sample.mapInArrow(places, "id long, places array<int>").join(F.broadcast(chosen), "id").orderBy("id").toArrow().combine_chunks()
    lists = placed.column("places").combine_chunks()
    values, ends = (lists.flatten().to_numpy(), lists.offsets.to_numpy()) if placed.num_rows else (np.empty(0, np.int32), np.zeros(1, np.int32))
    marks = np.array([[np.nan if v is None else float(v > 0) for v in placed.column(y).to_pylist()] for y in names]).reshape(len(names), placed.num_rows)
    return fit_chain(spark, list(categories), known, values, ends - ends[0], marks, folds)


def fit_chain(spark: SparkSession, categories: list[str], known: dict[str, int], values: np.ndarray, ends: np.ndarray, marks: np.ndarray, folds: int) -> Chain:
    """Fit the models in order on rows given by ``values`` and ``ends`` (places of words)
    and ``marks`` (a row of labels a category, nan for none); one task a fold."""
    chain, n = Chain(categories, known), marks.shape[1]
    fold = np.random.default_rng(0).permutation(n) % folds  # ids may be periodic
    data = spark.sparkContext.broadcast((values, ends, fold))
    before, size = np.zeros((n, 0)), len(known)
    for i, category in enumerate(categories):
        now = spark.sparkContext.broadcast((before, marks[i]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, ends, fold = data.value
            before, y = now.value
            held = np.split(values, ends[1:-1]) if len(y) else []
            for batch in batches:
                for f in batch.column(0).to_pylist():  # a fold to leave out, or none for the model of all rows
                    use = np.flatnonzero(~np.isnan(y) & (fold != f))
                    model = fit_logistic([held[j] for j in use], before[use], y[use], size)
                    rest = np.flatnonzero(fold == f)
                    p = probability(model.odds([held[j] for j in rest], before[rest]))
                    weights = np.concatenate((model.words, model.before, [model.bias])) if f < 0 else p
                    yield pa.record_batch([pa.array([f]), pa.array([weights.tobytes()], pa.binary())], names=["fold", "numbers"])

        tasks = spark.range(-1, folds, 1, folds + 1).mapInArrow(run, "fold long, numbers binary")
        found = {r.fold: np.frombuffer(r.numbers) for r in tasks.collect()}
        out_of_fold = np.zeros(n)
        for f in range(folds):
            out_of_fold[fold == f] = found[f]
        given = ~np.isnan(marks[i])
        chain.thresholds[category] = best_threshold(out_of_fold[given], marks[i][given])
        chain.models.append(Logistic(found[-1][:size], found[-1][size:-1], float(found[-1][-1])))
        before = np.column_stack((before, log_odds(out_of_fold)))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_", keep_text: bool = True) -> DataFrame:
    """``docs`` with one double column ``p_<category>`` each. A null or empty text
    holds no word and gets the probability of that; columns of the same names
    are replaced, all rows and other columns stay."""
    new = [prefix + c for c in chain.categories]
    fields = [f for f in docs.schema if f.name not in new and (keep_text or f.name != text)]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in new])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    at, kept = docs.columns.index(text), [docs.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in _slices(batches):
            p = model.predict([model.places(t.as_py()) for t in batch.column(at)])
            yield pa.record_batch([batch.column(i) for i in kept] + [pa.array(p[:, i]) for i in range(len(new))], names=schema.names)

    return numbered(docs).mapInArrow(run, schema)
