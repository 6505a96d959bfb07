"""A log-bilinear language model trained by noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import byte_texts, held, slices, written

#: Symbols of the model: the end, the classes of rarer words, and the commonest words.
SYMBOLS, CLASSES = 1024, 128
END = 0
#: Commonest words whose counts every task holds; rarer ones are joined.
HELD = 50_000
_PARTIAL = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
            "base_logs double, score double, rare array<struct<word:binary,n:long>>")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: ASCII letters and ASCII white space only


def rare_class(word: bytes) -> int:
    """The symbol of a word that has none of its own: a hash of its last four bytes."""
    return 1 + zlib.crc32(word[-4:]) % CLASSES


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, the end as an empty word; added up within a task."""
    counts: Counter = Counter()
    for batch in slices(batches, "text"):
        texts = byte_texts(batch.column("text"))
        counts[b""] += len(texts)
        for text in texts:
            counts.update(words_of(text))
        if len(counts) > 300_000:
            yield _word_rows(counts)
            counts = Counter()
    yield _word_rows(counts)


def _word_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "n"])


class _Lookup(dict):
    """Places of the held words; a rarer word gives -1 - its class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - rare_class(word)


@dataclass
class Model:
    """``held``: common words with their counts, the commonest first, of which as many as fit
    are symbols. ``log_p``: log10 probability of each symbol (column) after each (row).
    ``class_mass``: log10 of the counts, plus one each and one for any new word, of a class.
    """

    held: list[bytes]
    held_counts: np.ndarray
    log_p: np.ndarray
    class_mass: np.ndarray
    tokens: int
    distinct: int
    ends: int
    name: str = field(default_factory=lambda: uuid4().hex)

    def symbols(self) -> np.ndarray:
        """The symbol of each held word."""
        own = SYMBOLS - 1 - CLASSES
        return np.array([1 + CLASSES + i if i < own else rare_class(word)
                         for i, word in enumerate(self.held)], np.int64)


class Reader:
    """Turns texts into symbols."""

    def __init__(self, model: Model):
        self.lookup = _Lookup(zip(model.held, range(len(model.held)), strict=True))
        self.symbol = model.symbols()

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words and the end; and the words' places, negative for rare ones."""
        places = np.fromiter(map(self.lookup.__getitem__, words), np.int64, len(words))
        symbols = np.zeros(len(words) + 1, np.int64)
        if len(words):
            symbols[:-1] = np.where(places >= 0, self.symbol[np.maximum(places, 0)]
                                    if len(self.symbol) else 0, -1 - places)
        return symbols, places


def _reader(model: Model) -> Reader:
    return held(model.name, lambda: Reader(model))


def _count_neighbours(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        cells = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in slices(batches, "text"):
            pairs = [np.empty(0, np.int64)]
            for text in byte_texts(batch.column("text")):
                symbols, _ = reader.read(words_of(text))
                pairs.append(np.concatenate([[END], symbols[:-1]]) * SYMBOLS + symbols)
            cells += np.bincount(np.concatenate(pairs), minlength=len(cells))
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])],
                                         names=["cell", "n"])

    return run


def train(counts: np.ndarray, size: int = 40, noise: float = 20.0, steps: int = 150,
          rate: float = 0.05, seed: int = 1) -> np.ndarray:
    """log10 probabilities of each symbol after each, from counts of neighbours.

    A symbol's score after a context is the product of the context's and the symbol's vector,
    plus the symbol's bias and its log frequency. The vectors are trained to tell the counted
    neighbours from ``noise`` times as many drawn by frequency; as every pair's count is
    known, both expectations are taken in full, as matrix products. The scores are then
    normalised over all symbols, and each row is mixed with the frequencies in the share that
    Witten and Bell give to what a context has not shown.
    """
    n = counts.astype(np.float64)
    rows, total = n.sum(axis=1), max(n.sum(), 1.0)
    unigram = (n.sum(axis=0) + 0.5) / (total + 0.5 * len(n))
    rng = np.random.default_rng(seed)
    left, right = (rng.normal(0, 0.1, (len(n), size)) for _ in range(2))
    bias = np.zeros(len(n))
    # Each context counts by the root of its size, or the commonest would drown all others.
    weight = np.sqrt(rows / total) / np.maximum(rows, 1)
    data = (n * weight[:, None]).astype(np.float32)
    noisy = (noise * (rows * weight)[:, None] * unigram).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (left, right, bias)]
    for step in range(1, steps + 1):
        score = (left.astype(np.float32) @ right.T.astype(np.float32) + bias.astype(np.float32)
                 - np.float32(np.log(noise)))
        real = 1 / (1 + np.exp(-score))
        slope = data - (data + noisy) * real
        slopes = (slope @ right, slope.T @ left, slope.sum(axis=0))
        for value, gradient, moment in zip((left, right, bias), slopes, moments, strict=True):
            moment[0] = 0.9 * moment[0] + 0.1 * gradient
            moment[1] = 0.99 * moment[1] + 0.01 * gradient ** 2
            value += (rate * (1 - step / (steps + 1)) * (moment[0] / (1 - 0.9 ** step))
                      / (np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-10))
    logits = left @ right.T + bias + np.log(unigram)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    kinds = (n > 0).sum(axis=1)
    known = (rows / np.maximum(rows + kinds, 1))[:, None]
    return np.log10(known * p + (1 - known) * unigram).astype(np.float32)


def learn_language_model(docs: DataFrame, learn: Column) -> tuple[Model, DataFrame]:
    """The model, and the counts (word, n) of all words, from the rows where ``learn`` holds.

    Every text is counted, whole; the end of a document counts as an empty word. Word counts
    are added up in Spark and stay there. The driver gets the ``HELD`` commonest, and the
    counts of neighbouring symbols, which are ``SYMBOLS`` squared whatever the input's size.
    """
    spark = docs.sparkSession
    texts = docs.where(learn).select(F.col("text"))
    counted = written(texts.mapInArrow(_count_words, "word binary, n long")
                      .groupBy("word").agg(F.sum("n").alias("n")))
    tokens, distinct = counted.where("n > 0").agg(F.sum("n"), F.count("*")).first()
    common = (counted.where("length(word) > 0").orderBy(F.desc("n"), "word").limit(HELD).collect())
    held = [bytes(row.word) for row in common]
    own = SYMBOLS - 1 - CLASSES
    last = F.when(F.length("word") > 4, F.expr("substring(word, length(word) - 3, 4)")).otherwise(
        F.col("word"))
    mass = counted.where("length(word) > 0").groupBy(
        F.pmod(F.crc32(last), F.lit(CLASSES)).alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    in_class = np.ones(1 + CLASSES)  # one place for any new word
    for c, n, kinds in mass:
        in_class[1 + c] += n + kinds
    for row in common[:own]:
        in_class[rare_class(bytes(row.word))] -= row.n + 1
    model = Model(held, np.array([row.n for row in common], np.int64), np.zeros((0, 0)),
                  np.log10(np.maximum(in_class, 1)), int(tokens or 0), int(distinct or 0),
                  sum(row.n for row in counted.where("length(word) = 0").collect()))
    shared = spark.sparkContext.broadcast(model)
    cells = (texts.mapInArrow(_count_neighbours(shared), "cell int, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(SYMBOLS * SYMBOLS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    model.log_p = train(counts.reshape(SYMBOLS, SYMBOLS))
    model.name = uuid4().hex
    return model, counted


def _score(shared):
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_known", pa.int64()), ("base_logs", pa.float64()), ("score", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, _reader(shared.value)
        end_logs = float(np.log10(model.ends + 1.0))
        logs = np.log10(model.held_counts + 1.0)
        symbol = reader.symbol
        # What a word's class leaves to the word itself; words that are symbols need nothing.
        within = np.where(symbol <= CLASSES, logs - model.class_mass[np.minimum(symbol, CLASSES)], 0.0)
        for batch in slices(batches, "text"):
            rows = []
            for text in byte_texts(batch.column("text")):
                words = words_of(text)
                symbols, places = reader.read(words)
                before = np.concatenate([[END], symbols[:-1]])
                score = float(model.log_p[before, symbols].sum(dtype=np.float64))
                known = places[places >= 0]
                base = end_logs + float(logs[known].sum())
                score += float(within[known].sum())
                lacking = np.flatnonzero(places < 0)
                score -= float(model.class_mass[-1 - places[lacking]].sum())
                rare = Counter([words[i] for i in lacking])
                rows.append((len(words) + 1, len(known) + (model.tokens > 0), base, score,
                             [{"word": w, "n": n} for w, n in rare.items()]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in ("row", "doc_id", "held_out")),
                 *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[3:], strict=True)]],
                schema=schema)

    return run


def score_texts(docs: DataFrame, held_out: Column, model: Model, counted: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``score`` is the model's log10 probability of the whole text and its end: each symbol given
    the one before, and of a word without a symbol of its own its share of its class, by its
    count plus one. ``base_score`` is that of counts plus one alone. Words beyond the held ones
    are joined with their counts, so no table of words has to fit anywhere. NULL and empty
    texts consist of their end. A NULL doc_id is not held out; repeated rows each give a row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    partial = written(rows.mapInArrow(_score(shared), _PARTIAL))
    rare = partial.select("row", F.explode("rare").alias("r")).select(
        "row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    added = (rare.join(counted, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known")))
    logs = F.coalesce("logs", F.lit(0.0))
    mass = float(np.log10(model.tokens + model.distinct + 1))
    return partial.drop("rare").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_logs") + logs - F.col("n_tokens") * mass).alias("base_score"),
        (F.col("score") + logs).alias("score"))
