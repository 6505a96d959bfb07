"""Quality rules: counts within a text, and lines that many documents of a host share."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from routelens.llm.common import byte_texts, slices, written
from routelens.llm.line_dedup import line_key

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_PROFILE = ("doc_id long, host string, digest binary, "
            + ", ".join(f"{name} long" for name in _COUNTS)
            + ", lines array<struct<line:binary,words:long>>")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in windows of ``width`` words found at least twice."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    windows = ids[:len(ids) - width + 1]
    for i in range(1, width):
        # Numbers of pairs instead of the pairs keep the next product small.
        pairs = windows * len(number) + ids[i:len(ids) - width + 1 + i]
        windows = np.unique(pairs, return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(windows)[windows] > 1)
    covered = np.zeros(len(ids), bool)
    for i in range(width):
        covered[often + i] = True
    return int(covered.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()  # on bytes: ASCII white space only
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = Counter(line for line in text.split(b"\n") if line.strip())
    return len(words), chars, symbols, lines.total() - len(lines), repeated_words(words)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))
    for batch in slices(batches, "text"):
        digests, counts, lines = [], [], []
        for text in byte_texts(batch.column("text")):
            digests.append(xxhash.xxh3_128_digest(text))
            counts.append(counts_of(text))
            words: Counter = Counter()
            for line in text.split(b"\n"):
                n = len(line.split())
                if n:
                    words[xxhash.xxh3_128_digest(line_key(line))] += n
            lines.append([{"line": line, "words": n} for line, n in words.items()])
        columns = list(zip(*counts, strict=True)) or [()] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), pa.array(digests, pa.binary()),
             *[pa.array(c, pa.int64()) for c in columns], pa.array(lines, kind)],
            names=["doc_id", "host", "digest", *_COUNTS, "lines"])


def _profiled(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("host"),
                               "text").mapInArrow(_profiles, _PROFILE)
                   .withColumn("row", F.monotonically_increasing_id()))


def _frequent(profiles: DataFrame, least: int) -> DataFrame:
    """(host, line) of lines that more than ``least`` documents of a host hold.

    The documents that hold a line are made distinct by host, line and document together, so a
    common line or a large host is spread over all tasks, and then counted per task first. Rows
    without an id are no documents of their own and not counted.
    """
    return (profiles.where("doc_id IS NOT NULL").select("host", "doc_id", F.explode("lines.line").alias("line"))
            .distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
            .where(F.col("n") > least).select("host", "line"))


def quality_rules(docs: DataFrame, least: int = 20, remaining: int = 30) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
    base_failed, kept), one row for each row of ``docs`` (doc_id, text, source).

    A document fails the base rules with fewer than 50 words, or if more than half of them lie
    in repeated windows of three words. Lines (``line_key``) found in more than ``least``
    documents of a host are boilerplate, whatever the size of the host; copies count each. A document is kept if it passes the base rules and at least ``remaining`` percent of
    its words stand in other lines.

    NULL and empty texts have no words and fail. A NULL source is a host, that of the empty
    name. Repeated rows and NULL ids each give a row.
    """
    profiles = _profiled(docs)
    removed = (profiles.select("row", "host", F.explode("lines").alias("l"))
               .select("row", "host", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
               .join(_frequent(profiles, least), ["host", "line"])
               .groupBy("row").agg(F.sum("words").alias("n_removed_words")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (profiles.drop("lines").join(removed, "row", "left")
            .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
            .select("doc_id", *_COUNTS, "n_removed_words", failed.alias("base_failed"),
                    (~failed & (100 * left >= remaining * F.col("n_words"))).alias("kept")))


@arrow_udf(StringType())
def _without(texts: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(byte_texts(texts), lines.to_pylist(), strict=True):
        if gone:
            gone = set(gone)
            text = b"\n".join(line for line in text.split(b"\n")
                              if xxhash.xxh3_128_digest(line_key(line)) not in gone)
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string())


@arrow_udf(BinaryType())
def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(text) for text in byte_texts(texts)], pa.binary())


def without_frequent_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """``docs`` with boilerplate lines (see ``quality_rules``) taken out of ``text``."""
    profiles = _profiled(docs)
    gone = (profiles.select("row", "doc_id", "host", "digest", F.explode("lines.line").alias("line"))
            .join(_frequent(profiles, least), ["host", "line"])
            .groupBy("host", "digest").agg(F.collect_set("line").alias("__lines"))
            .withColumnRenamed("host", "__host").withColumnRenamed("digest", "__digest"))
    keyed = docs.withColumn("__key", _digest("text"))
    joined = keyed.join(gone, (F.coalesce("source", F.lit("")) == F.col("__host"))
                        & (F.col("__key") == F.col("__digest")), "left")
    return joined.withColumn("text", _without("text", "__lines")).select(
        *[F.col(f"`{name}`") for name in docs.columns])
