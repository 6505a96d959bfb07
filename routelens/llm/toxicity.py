"""Toxicity by two Kneser-Ney word models, one of toxic and one of ordinary documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from routelens.llm.common import bound_batches, held, release, slices, written

DISCOUNT = 0.75
#: Words in the passages whose likelihoods are compared besides those of the whole text.
PASSAGE = 8
WORST = 3
FEATURES = 3
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def core(chunk: str) -> str:
    """A chunk between white space in lower case, ASCII punctuation off its ends."""
    return chunk.lower().strip(_MARKS)


@dataclass
class Model:
    """Log ratios of the toxic and the ordinary model.

    ``single``: by word, of its back-off probabilities; ``fresh`` for words never seen.
    ``pairs``: sorted (word before << 32 | word), with ``paired`` the ratio after that word.
    ``rest``: by word before, the ratio of what the two models leave to their back-off.
    ``weights``: logistic regression on 1 and the features.
    """

    words: list[str]
    single: np.ndarray
    fresh: float
    pairs: np.ndarray
    paired: np.ndarray
    rest: np.ndarray
    weights: np.ndarray
    name: str = field(default_factory=lambda: uuid4().hex)


#: Pairs that a task adds up before it gives them on.
MOST_PAIRS = 200_000


class Scorer:
    """Features of texts; remembers the words of at most ``most`` chunks."""

    def __init__(self, model: Model, most: int = 120_000):
        self.model, self.most = model, most
        self.rest = np.append(model.rest, 0.0)
        self.known = {word: i for i, word in enumerate(model.words)}
        self.chunks: dict[str, int] = {}

    def _word(self, chunk: str) -> int:
        place = self.chunks.get(chunk)
        if place is None:
            word = core(chunk)
            place = self.known.get(word, len(self.known)) if word else -1
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = place
        return place

    def features(self, text: str | None) -> tuple[float, ...]:
        """Mean log ratio of the words of the whole text, of its worst passage, and of its
        ``WORST`` worst words. Shorter texts count as filled up with neutral words."""
        chunks = (text or "").split()
        words = np.fromiter(map(self._word, chunks), np.int64, len(chunks))
        words = words[words >= 0]
        if not len(words):
            return (0.0,) * FEATURES
        model = self.model
        # A text begins after place len(model.words), which a word never seen has too: after such a
        # word nothing is known, so as the word before it has a place of its own.
        unseen = len(model.words)
        before = np.concatenate([[unseen], np.where(words[:-1] == unseen, unseen + 1, words[:-1])])
        ratio = model.single[words] + self.rest[before]
        if len(model.pairs):
            wanted = before << 32 | words
            at = np.searchsorted(model.pairs, wanted)
            at[at == len(model.pairs)] = 0
            ratio = np.where(model.pairs[at] == wanted, model.paired[at], ratio)
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        size = min(PASSAGE, len(ratio))
        worst = float((sums[size:] - sums[:-size]).max()) / PASSAGE
        words = float(np.sort(ratio)[-WORST:].sum()) / WORST
        return float(sums[-1] / max(len(ratio), PASSAGE)), worst, words


def _scorer(model: Broadcast) -> Scorer:
    return held(model.value.name, lambda: Scorer(model.value))


def _features(model: Broadcast):
    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        scorer = _scorer(model)
        return pa.array([scorer.features(text.as_py()) for text in texts], pa.list_(pa.float64()))

    return features


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, w, toxic, plain): in how many texts of either class a word pair stands, added up in parts."""
    release()
    counts = (Counter(), Counter())  # of ordinary texts, of toxic ones

    def added() -> Iterator[pa.RecordBatch]:
        for toxic, pairs in enumerate(counts):
            n, none = pa.array(pairs.values(), pa.int64()), pa.array(np.zeros(len(pairs), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string()),
                 n if toxic else none, none if toxic else n], names=["v", "w", "toxic", "plain"])
            pairs.clear()

    for batch in slices(batches, "text", 1 << 20):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
            words = [word for word in map(core, (text.as_py() or "").split()) if word]
            # Once a document, or a text that repeats itself would pass for usage.
            counts[toxic].update(set(zip(["", *words[:-1]][:len(words)], words, strict=True)))
        if sum(map(len, counts)) > MOST_PAIRS:
            yield from added()
    yield from added()


def _constant(rate: float) -> Model:
    """A model that gives every text the same score."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Model([], np.zeros(1), 0.0, np.empty(0, np.int64), np.empty(0), np.zeros(1),
                 np.array([np.log(rate / (1 - rate)), *[0.0] * FEATURES]))


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 4000,
                   least_pairs: int = 8) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) where ``learn`` holds.

    ``learn`` is a condition on doc_id. The model is fitted on a bounded sample: about
    ``per_class`` documents of each class, as many of either, chosen by a hash of the id and
    taken whole; copies count once. A quarter as many others fit the logistic regression that turns log ratios into a score,
    weighted to the classes' real shares. Pairs of words seen fewer than ``least_pairs`` times
    go to the back-off. A document with contradicting labels is toxic; rows with a NULL
    doc_id or label, and labels other than 0 and 1, teach nothing. If a class is missing,
    every text gets the other's rate, and 0 if there are no labels.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    truth = (labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = dict(truth.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return _constant(float(max(sizes, default=0)))
    # As many of either class, so that chance spares both models' rare words alike.
    size = min(per_class, 0.8 * sizes[0], 0.8 * sizes[1])
    share = F.when(F.col("toxic") == 1, size / sizes[1]).otherwise(size / sizes[0])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    # The sample has a bounded number of rows, so its ids may be sent to every task.
    chosen = truth.where(draw < 1.25 * share).withColumn("fits", draw < share)
    sample = written(docs.select("doc_id", "text").where(F.col("text").isNotNull())
                     .join(F.broadcast(chosen), "doc_id"))
    counted = written(
        sample.where("fits").select("toxic", "text").distinct()
        .mapInArrow(_count_pairs, "v string, w string, toxic long, plain long")
        .groupBy("v", "w").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")))
    model = _fit(counted, least_pairs)
    rows = sample.where("NOT fits").select(
        "toxic", _features(spark.sparkContext.broadcast(model))("text").alias("x")).collect()
    _calibrate(model, [row.toxic for row in rows], [row.x for row in rows], sizes)
    model.name = uuid4().hex
    return model


def _fit(counted: DataFrame, least_pairs: int) -> Model:
    kind = {c: F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "plain")}
    singles = counted.groupBy("w").agg(kind["toxic"], kind["plain"]).toArrow()
    pairs = counted.where(F.col("toxic") + F.col("plain") >= least_pairs).toArrow()
    contexts = counted.groupBy("v").agg(
        F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"),
        F.max(F.col("toxic") + F.col("plain")).alias("most")).where(
        F.col("most") >= least_pairs).drop("most").toArrow()
    words = singles.column("w").to_pylist()
    number = {word: i for i, word in enumerate(words)}
    number[""] = len(words)
    column = {c: singles.column(c).to_numpy().astype(np.float64) for c in ("toxic", "plain")}
    # Shared back-off: not how often a word occurs but in how many of the classes, and one
    # place for unseen words.
    classes = (column["toxic"] > 0).astype(float) + (column["plain"] > 0)
    shared, new = classes / (classes.sum() + 1), 1 / (classes.sum() + 1)
    of_pair = {c: pairs.column(c).to_numpy().astype(np.float64) for c in ("toxic", "plain")}
    v = np.array([number[x] for x in pairs.column("v").to_pylist()], np.int64)
    w = np.array([number[x] for x in pairs.column("w").to_pylist()], np.int64)
    at = np.array([number[x] for x in contexts.column("v").to_pylist()], np.int64)
    log_single, log_rest, log_pair = {}, {}, {}
    for c in ("toxic", "plain"):
        kinds = column[c]
        total = max(kinds.sum(), 1.0)
        rest = 1 - np.maximum(kinds - DISCOUNT, 0).sum() / total
        p = np.append(np.maximum(kinds - DISCOUNT, 0) / total + rest * shared, rest * new)
        seen = np.zeros(len(words) + 1)
        seen[at] = contexts.column(c).to_numpy()
        direct = np.maximum(of_pair[c] - DISCOUNT, 0) / np.maximum(seen[v], 1)
        left = np.maximum(1 - np.bincount(v, direct, len(words) + 1), 1e-3)
        log_single[c], log_rest[c] = np.log(p), np.log(left)
        log_pair[c] = np.log(direct + left[v] * p[w])
    single = log_single["toxic"] - log_single["plain"]
    rest = log_rest["toxic"] - log_rest["plain"]
    keys = v << 32 | w
    order = np.argsort(keys)
    return Model(words, single.astype(np.float32), float(single[-1]), keys[order],
                 (log_pair["toxic"] - log_pair["plain"])[order].astype(np.float32),
                 rest.astype(np.float32), np.zeros(1 + FEATURES))


def _calibrate(model: Model, toxic: list[int], features: list, sizes: dict) -> None:
    """Logistic regression by Newton's method, slightly drawn to 0."""
    rate = sizes[1] / (sizes[0] + sizes[1])
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        model.weights = np.array([np.log(rate / (1 - rate)), 0.0, 0.0, 1.0])
        return
    x = np.column_stack([np.ones(len(y)), np.array(features, np.float64).reshape(len(y), FEATURES)])
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    beta = np.zeros(1 + FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(1 + FEATURES)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = beta


def _scores(model: Broadcast):
    @arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        scorer, weights = _scorer(model), model.value.weights
        x = np.array([(1.0, *scorer.features(text.as_py())) for text in texts]).reshape(-1, 1 + FEATURES)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return scores


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1. Texts without words, NULL ones too, get the score
    of no evidence. Whole texts are read; there is no shuffle."""
    bound_batches(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("toxicity", _scores(fitted)("text"))
