"""Language ID by interpolated Kneser-Ney models of characters, one for each language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from routelens.llm.common import bound_batches, held
from routelens.llm.minhash import mix

ORDER = 5
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two edges, end to end; and the words' lengths."""
    text = "\x01" + "\x01\x01".join(words) + "\x01"
    return (np.frombuffer(text.encode("utf-32-le"), np.uint32),
            np.array([len(word) + 2 for word in words], np.int64))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order n from 1: the hash of the n characters that end at each place, 0 where the
    word has not so many yet. Also the number of the word at each place."""
    codes, lengths = _codes(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    singles = mix(codes.astype(np.uint64) + _STEP)
    out = [singles]
    for n in range(2, order + 1):
        joined = np.zeros_like(singles)
        # The hash of n characters is made of that of the first n - 1 and of the last one.
        joined[1:] = mix((out[-1][:-1] * np.uint64(3)) ^ (singles[1:] + np.uint64(n)))
        joined[place < n - 1] = 0
        out.append(joined)
    return out, owner


@dataclass
class Model:
    """All n-grams of all languages in one sorted array of hashes.

    ``log_p`` holds for each n-gram and language the interpolated log probability of its last
    character after the others, ``log_rest`` the log of what its characters as a context leave
    to the shorter context, ``floor`` the log probability of a character never seen. ``mean``
    and ``spread`` are those of cross-entropy in documents of each language.
    """

    languages: list[str]
    hashes: np.ndarray
    log_p: np.ndarray
    log_rest: np.ndarray
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    name: str = field(default_factory=lambda: uuid4().hex)


def _find(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted hashes in a sorted array, -1 for those that it lacks."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    place = np.searchsorted(hashes, wanted)
    place[place == len(hashes)] = 0
    return np.where(hashes[place] == wanted, place, -1)


def word_scores(model: Model, words: list[str], order: int = ORDER) -> np.ndarray:
    """Per word and language the log probability of its characters and its end."""
    sums = np.zeros((len(words), len(model.languages)))
    if not words:
        return sums
    hashes, owner = grams(words, order)
    total = np.zeros((len(owner), len(model.languages)))
    left = np.concatenate([[False], owner[1:] == owner[:-1]])  # the edge in front is given
    for n in range(order, 0, -1):
        at = np.flatnonzero(left & (hashes[n - 1] != 0))
        found = _find(model.hashes, hashes[n - 1][at])
        hit = found >= 0
        total[at[hit]] += model.log_p[found[hit]]
        left[at[hit]] = False
        if n > 1:
            missed = at[~hit]
            context = _find(model.hashes, hashes[n - 2][missed - 1])
            known = context >= 0
            total[missed[known]] += model.log_rest[context[known]]
    total[left] += model.floor
    np.add.at(sums, owner, total)
    return sums


def fit(counts: dict[str, dict[str, int]], order: int = ORDER, discount: float = 0.75,
        characters: int = 1 << 12) -> Model:
    """A model from word counts for each language.

    The highest order counts occurrences, the lower ones different characters before, as
    Kneser and Ney have it; the lowest is mixed with an even spread over ``characters``.
    """
    languages = sorted(counts)
    tables = [_kneser_ney(counts[language], order, discount, characters) for language in languages]
    hashes = np.unique(np.concatenate([t["hash"] for t in tables] or [np.empty(0, np.uint64)]))
    shape = (len(hashes), len(languages))
    level, shorter, given = (np.zeros(len(hashes), np.int64) for _ in range(3))
    places = [np.searchsorted(hashes, t["hash"]) for t in tables]
    for table, at in zip(tables, places, strict=True):
        level[at] = table["level"]
        shorter[at] = np.searchsorted(hashes, table["shorter"]) % max(len(hashes), 1)
        given[at] = np.searchsorted(hashes, table["context"]) % max(len(hashes), 1)
    log_p, log_rest = np.zeros(shape), np.zeros(shape)
    floor = np.array([t["floor"] for t in tables])
    for column, (table, at) in enumerate(zip(tables, places, strict=True)):
        log_p[at, column], log_rest[at, column] = table["log_p"], table["log_rest"]
        lacking = np.ones(len(hashes), bool)
        lacking[at] = False
        log_p[lacking & (level == 1), column] = floor[column]
        for n in range(2, order + 1):
            other = np.flatnonzero(lacking & (level == n))
            log_p[other, column] = log_rest[given[other], column] + log_p[shorter[other], column]
    return Model(languages, hashes, log_p.astype(np.float32), log_rest.astype(np.float32), floor,
                 np.zeros(len(languages)), np.ones(len(languages)))


def _kneser_ney(words: dict[str, int], order: int, discount: float, characters: int) -> dict:
    """The n-grams of one language: hash, level, log_p, log_rest, and the hashes of the n-gram
    without its first character (shorter) and without its last one (context)."""
    weight = np.array(list(words.values()), np.float64)
    hashes, owner = grams(list(words), order)
    inside = np.concatenate([[False], owner[1:] == owner[:-1]])
    keys, counts, shorter, context = [], [], [], []
    for n in range(1, order + 1):
        at = np.flatnonzero((hashes[n - 1] != 0) & inside)
        kinds, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        keys.append(kinds)
        counts.append(np.bincount(inverse, weight[owner[at]], len(kinds)))
        at = at[first]
        shorter.append(hashes[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64))
        context.append(hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64))
    for n in range(1, order):
        before = _find(keys[n - 1], shorter[n])
        before = np.bincount(before[before >= 0], minlength=len(keys[n - 1]))
        # Those at the beginning of a word have nothing before them and keep their occurrences.
        counts[n - 1] = np.where(before > 0, before, counts[n - 1])
    total = counts[0].sum()
    left = discount * len(keys[0]) / total
    floor = float(np.log(left / characters))
    log_p = [np.log(np.maximum(counts[0] - discount, 0) / total + left / characters)]
    log_rest = [np.zeros(len(k)) for k in keys]
    for n in range(2, order + 1):
        at = np.searchsorted(keys[n - 2], context[n - 1])
        size = len(keys[n - 2])
        total = np.bincount(at, counts[n - 1], size)
        left = discount * np.bincount(at, minlength=size) / np.maximum(total, 1)
        used = total > 0
        log_rest[n - 2][used] = np.log(left[used])
        below = np.exp(log_p[-1][np.searchsorted(keys[n - 2], shorter[n - 1])])
        log_p.append(np.log(np.maximum(counts[n - 1] - discount, 0) / total[at] + left[at] * below))
    level = np.repeat(np.arange(1, order + 1), [len(k) for k in keys])
    return {"hash": np.concatenate(keys), "level": level, "log_p": np.concatenate(log_p),
            "log_rest": np.concatenate(log_rest), "shorter": np.concatenate(shorter),
            "context": np.concatenate(context), "floor": floor}


#: Characters scored at a time, and of the longest chunk that is remembered after it.
PART, LONGEST = 1 << 20, 64


class Scorer:
    """Log-likelihoods of texts; remembers those of at most ``most`` chunks between white space."""

    def __init__(self, model: Model, most: int = 120_000):
        self.model, self.most = model, most
        self._start()

    def _start(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1 << 16, len(self.model.languages)))
        self.symbols = np.zeros(1 << 16, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        words, owner = [], []
        for row, chunk in enumerate(chunks):
            for word in _WORD.findall(chunk.lower()):
                words.append(word)
                owner.append(row)
        scores = np.zeros((len(chunks), len(self.model.languages)))
        symbols = np.zeros(len(chunks), np.int64)
        np.add.at(scores, owner, word_scores(self.model, words))
        np.add.at(symbols, owner, [len(word) + 1 for word in words])
        first = len(self.places)
        self.places.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        end = len(self.places)
        while end > len(self.symbols):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.symbols = np.concatenate([self.symbols, np.zeros_like(self.symbols)])
        self.scores[first:end] = scores
        self.symbols[first:end] = symbols

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log-likelihood in each language, and the number of symbols they cover.

        Texts are taken in parts of about ``PART`` characters. What is remembered is bounded before
        each: at most ``most`` chunks, none of over ``LONGEST`` characters, besides those of one part.
        """
        totals = np.zeros((len(texts), len(self.model.languages)))
        symbols = np.zeros(len(texts), np.int64)
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= PART or end == len(texts):
                self._score(texts, start, end, totals, symbols)
                start, size = end, 0
        return totals, symbols

    def _score(self, texts: list[str | None], start: int, end: int, totals: np.ndarray,
               symbols: np.ndarray) -> None:
        split = [(text or "").split() for text in texts[start:end]]
        fresh = {chunk for chunks in split for chunk in chunks} - self.places.keys()
        if len(self.places) + len(fresh) > self.most:
            self._start()
            fresh = {chunk for chunks in split for chunk in chunks}
        some = sorted(fresh)
        for first in range(0, len(some), 4000):  # which bounds the arrays of n-grams
            self._learn(some[first:first + 4000])
        for row, chunks in enumerate(split, start):
            at = np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))
            totals[row] = self.scores[at].sum(axis=0)
            symbols[row] = self.symbols[at].sum()
        if any(len(chunk) > LONGEST for chunk in fresh):
            self._start()


_PREDICTION = StructType([
    StructField("lang", StringType()), StructField("score", DoubleType()),
    StructField("entropy", DoubleType()), StructField("symbols", LongType()),
    StructField("rejected", BooleanType())])


def _predictor(model: Broadcast, margin: float, deviations: float):
    @arrow_udf(_PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        fitted = model.value
        scorer = held(fitted.name, lambda: Scorer(fitted))
        out = []
        for start in range(0, len(texts), 200):
            totals, symbols = scorer.score(texts.slice(start, 200).to_pylist())
            for total, n in zip(totals, symbols, strict=True):
                if not n or not fitted.languages:
                    out.append((UNKNOWN, 0.0, None, int(n), True))
                    continue
                best = int(np.argmax(total))
                posterior = float(1 / np.exp(np.minimum(total - total[best], 0)).sum())
                entropy = float(-total[best] / n)
                excess = entropy - fitted.mean[best]
                rejected = bool(excess > margin
                                and excess * np.sqrt(n) > deviations * fitted.spread[best])
                out.append((fitted.languages[best], posterior, entropy, int(n), rejected))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(),
                                                      pa.int64(), pa.bool_()), strict=True)],
            names=["lang", "score", "entropy", "symbols", "rejected"])

    return predict


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts.setdefault(lang, Counter()).update(_WORD.findall(text.as_py().lower()))
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()),
                                            strict=True)], names=["lang", "word", "n"])


def learn_languages(docs: DataFrame, learn: Column, per_language: int = 1000) -> Model:
    """A model from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds.

    It is fitted on a bounded sample: about ``per_language`` documents of each language, chosen
    by a hash of the id and taken whole. A quarter as many others calibrate rejection. Only
    the sample's word counts reach the driver. Rows with a NULL lang, id or text teach nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                      & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return fit({})
    # Shares of the ids' hashes, so the choice needs no sort and is the same in each run.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(per_language / n, 0.8)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    counted = (rows.where(draw < share).mapInArrow(_count_words, "lang string, word string, n long")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in counted.toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    model = fit(counts)
    predict = _predictor(spark.sparkContext.broadcast(model), 0.0, 0.0)
    scored = rows.where((draw >= share) & (draw < 1.25 * share)).select("lang", predict("text").alias("p")).where(
        (F.col("p.symbols") > 0) & (F.col("p.lang") == F.col("lang")))
    mean = dict(scored.groupBy("lang").agg(F.sum(F.col("p.entropy") * F.col("p.symbols"))
                                           / F.sum("p.symbols")).collect())
    # A language too rare to have documents of both kinds is judged as the most varied one is.
    highest = max(mean.values(), default=float(np.log(1 << 12)))
    model.mean = np.array([mean.get(lang, highest) for lang in model.languages])
    means = F.lit(0.0)
    for lang, value in zip(model.languages, model.mean, strict=True):
        means = F.when(F.col("lang") == lang, float(value)).otherwise(means)
    off = (F.col("p.entropy") - means) * F.sqrt("p.symbols")
    spread = dict(scored.groupBy("lang").agg(F.sqrt(F.avg(off * off))).collect())
    widest = max(spread.values(), default=1.0)
    model.spread = np.array([spread.get(lang, widest) for lang in model.languages])
    return model


def predict_languages(docs: DataFrame, model: Model, margin: float = 1.5,
                      deviations: float = 6.0) -> DataFrame:
    """``docs`` with ``prediction``: lang, score, entropy, symbols, rejected.

    lang is the language of the lowest cross-entropy for each letter and word end, of equal
    ones the first by name; score its posterior. A text is rejected if that entropy exceeds
    the mean of the language's documents by more than ``margin`` nats and by more than
    ``deviations`` standard deviations of a text of its length. NULL and empty texts and
    those without a letter are ``und``, score 0, rejected. Whole texts are read; there is no
    shuffle.
    """
    bound_batches(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("prediction", _predictor(fitted, margin, deviations)("text"))
