"""Phrase collocations by relational mining of sorted occurrences (SETM).

The relation of occurrences has a row for each word: its piece, its position and its word. It is kept
by blocks of whole pieces, sorted by piece and position, and written once; in a block a position is a
whole number that leaves a gap between pieces. Phrases grow by one word at a time:

1. Count the groups of the relation: per block first, then over all blocks.
2. Semi-join the relation with the groups that are frequent. No phrase occurs more often than a part
   of it, so nothing else can be part of a longer frequent phrase.
3. Merge-join what is left with the relation of single words, by piece and next position, and write
   the result: the occurrences of phrases with one word more, sorted as they were.

A block is bounded by its words, not by a language or phrase, so no hot group meets in one task.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import shared_folder, slices, written
from routelens.sources import ScratchTables

#: Characters that end a piece, and what all text is mapped by: these to a line end, A-Z to a-z.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if byte in _ENDS else byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece that has any, A-Z lower-cased."""
    for piece in text.translate(_TABLE).split(b"\n"):
        # Of ASCII white space only blanks and tabs are left.
        words = piece.split()
        if words:
            yield words


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed, in as few bytes each as the largest needs."""
    least, most = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, 0)
    kind = next(kind for kind in ("<i1", "<i2", "<i4", "<i8")
                if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max)
    return kind[2].encode() + zstandard.compress(numbers.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<i{data[:1].decode()}").astype(np.int64)


def _packed_sorted(numbers: np.ndarray) -> bytes:
    return _packed(np.diff(numbers, prepend=0))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data))


class _Block:
    """Words of one language in the making: local numbers, -1 between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.codes = array("i")

    def add(self, words: list[bytes]) -> None:
        self.codes.extend(map(self.numbers.__getitem__, words))
        self.codes.append(-1)


#: ``words`` are sorted and compressed, one to a line, as no word holds a line end.
_BLOCKS = "lang string, words binary, counts binary, codes binary"


def _words_in(block: bytes) -> list[bytes]:
    return zstandard.decompress(block).split(b"\n")


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        making: defaultdict[str, _Block] = defaultdict(_Block)
        held = 0

        def made(langs: list[str]) -> pa.RecordBatch:
            rows = []
            for lang in langs:
                block = making.pop(lang)
                words = sorted(block.numbers)
                place = np.empty(len(words) + 1, np.int64)
                place[[block.numbers[word] for word in words]] = np.arange(len(words))
                place[-1] = -1  # of -1
                codes = place[np.frombuffer(block.codes, np.int32)]
                rows.append((lang, zstandard.compress(b"\n".join(words), 3),
                             _packed(np.bincount(codes[codes >= 0])), _packed(codes)))
            columns = [pa.array(column, kind) for column, kind in zip(
                zip(*rows, strict=True), (pa.string(), *[pa.binary()] * 3), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "counts", "codes"])

        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if not text:
                    continue
                for words in pieces_of(text):
                    making[lang].add(words)
                    held += len(words)
                    if len(making[lang].codes) >= most:
                        held -= len(making[lang].codes)
                        yield made([lang])
            if held > 8 * most:  # many languages, none of them large
                held = 0
                yield made([lang for lang in making if making[lang].codes])
        last = [lang for lang in making if making[lang].codes]
        for start in range(0, len(last), 16):
            yield made(last[start:start + 16])
    return run


def occurrence_blocks(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, words, counts, codes): the relation of single words, by blocks.

    A block holds pieces of one language with at most ``most`` words and one piece more; a piece is
    never cut. ``codes`` are the places in ``words`` of one word after the other, -1 after each piece.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    return rows.mapInArrow(_blocks(most), _BLOCKS)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's blocks, added up before the shuffle as far as memory allows."""
    counts: defaultdict[str, Counter] = defaultdict(Counter)

    def added() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, some in counts.items() for _ in some], pa.string()),
             pa.array([word for some in counts.values() for word in some], pa.binary()),
             pa.array([n for some in counts.values() for n in some.values()], pa.int64())],
            names=["lang", "word", "n"])

    for batch in batches:
        for lang, words, n in zip(*(batch.column(name).to_pylist() for name in ("lang", "words", "counts")),
                                  strict=True):
            counts[lang].update(dict(zip(_words_in(words), _unpacked(n).tolist(), strict=True)))
            if sum(map(len, counts.values())) > 200_000:
                yield added()
                counts.clear()
    yield added()


class _Frequent(NamedTuple):
    """Frequent groups in one task: sorted keys, and the number of each."""

    keys: np.ndarray
    numbers: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it is not frequent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[places] == keys, self.numbers[places], -1)


def numbered(groups: DataFrame) -> DataFrame:
    """The written rows of ``groups`` with ``number``, gapless from 0, in no special order.

    Only the number of rows of each partition comes to the driver.
    """
    # Rows of one written file are numbered by their place in it.
    stored = written(groups.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {row.part: row.n for row in
             stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    start, starts = 0, []
    for number in sorted(sizes):
        starts.append((number, start))
        start += sizes[number]
    table = groups.sparkSession.createDataFrame(starts, "__part long, __start long")
    return stored.join(F.broadcast(table), part == F.col("__part")).select(
        *groups.columns, (F.col("__start") + place).alias("number"))


_FOUND = "array<struct<key: bigint, number: bigint>>"


class _Lookup:
    """Finds frequent groups for the tasks: from a broadcast while they are few, else from each block's row.

    ``wanted`` are (block, key), distinct, of the blocks at hand: read only if the groups are many.
    """

    def __init__(self, frequent: DataFrame, key: str, most: int):
        self.frequent, self.key = frequent, key
        self.is_small = frequent.count() <= most
        self.held = None
        if self.is_small:
            table = frequent.select(key, "number").toArrow()
            numbers = table.column("number").to_numpy().astype(np.int64)
            if key == "word":
                value: object = dict(zip(table.column(key).to_pylist(), numbers.tolist(), strict=True))
            else:
                keys = table.column(key).to_numpy().astype(np.int64)
                order = np.argsort(keys)
                value = _Frequent(keys[order], numbers[order])
            self.held = frequent.sparkSession.sparkContext.broadcast(value)

    def attach(self, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
        """``blocks`` with ``found``, (key, number) pairs of the block; NULL while there is a broadcast."""
        if self.is_small:
            return blocks.withColumn("found", F.lit(None).cast(_FOUND))
        found = (wanted.join(self.frequent.select(F.col(self.key).alias("key"), "number"), "key")
                 .groupBy("block").agg(F.collect_list(F.struct("key", "number")).alias("found")))
        return blocks.join(found, "block", "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))


def _frequent_of(found: pa.Scalar, held: object) -> _Frequent:
    if not found.is_valid:
        return held.value
    items = found.values
    keys = items.field("key").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(keys)
    return _Frequent(keys[order], items.field("number").to_numpy(zero_copy_only=False).astype(np.int64)[order])


#: ``at`` and ``word``: the relation of single words. ``starts`` and ``groups``: that of frequent
#: phrases. ``keys`` and ``counts``: the groups of phrases with one word more.
_RELATION = "block long, at binary, word binary, starts binary, groups binary, keys binary, counts binary"


def _joined(at: np.ndarray, word: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int,
            n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join by position, both sides sorted: the next word stands ``length`` further.

    Starts and keys of the phrases with one word more. A key is the number of the first words' group
    times ``n_words``, plus the number of the last word.
    """
    if not len(at):
        return starts[:0], groups[:0]
    place = np.searchsorted(at, starts + length)
    place[place == len(at)] = 0
    follows = at[place] == starts + length
    return starts[follows], groups[follows] * n_words + word[place[follows]]


def _relation_row(block: int, at: np.ndarray, word: np.ndarray, starts: np.ndarray, groups: np.ndarray,
                  length: int, n_words: int) -> pa.RecordBatch:
    kinds, counts = np.unique(_joined(at, word, starts, groups, length, n_words)[1], return_counts=True)
    data = [_packed_sorted(at), _packed(word), _packed_sorted(starts), _packed(groups),
            _packed_sorted(kinds), _packed(counts)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([d], pa.binary()) for d in data]],
                                      names=["block", "at", "word", "starts", "groups", "keys", "counts"])


def _extend(length: int, n_words: int, held: object):
    """From occurrences of ``length`` words and the frequent groups of one more, the occurrences of these.

    Emits, by block, both relations without what cannot be part of a longer frequent phrase, and the
    counts of the groups after the next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                at, word = _unpacked_sorted(row["at"].as_py()), _unpacked(row["word"].as_py())
                starts, keys = _joined(at, word, _unpacked_sorted(row["starts"].as_py()),
                                       _unpacked(row["groups"].as_py()), length, n_words)
                # Semi-join with the frequent groups.
                groups = _frequent_of(row["found"], held).find(keys)
                starts, groups = starts[groups >= 0], groups[groups >= 0]
                # A word that ends no frequent phrase of this length can end no longer one.
                stays = np.isin(at, starts + length, assume_unique=True)
                yield _relation_row(row["block"].as_py(), at[stays], word[stays], starts, groups,
                                    length + 1, n_words)
    return run


def _first_relation(n_words: int, held: object):
    """The relation of the frequent single words, from the blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column("lang")[i].as_py(), _words_in(batch.column("words")[i].as_py())
                found = batch.column("found")[i]
                if found.is_valid:  # the key is the place among the block's words
                    numbers = np.full(len(words), -1, np.int64)
                    numbers[found.values.field("key").to_numpy(zero_copy_only=False)] = (
                        found.values.field("number").to_numpy(zero_copy_only=False))
                else:
                    known, start = held.value, lang.encode() + b"\n"
                    numbers = np.array([known.get(start + word, -1) for word in words], np.int64)
                codes = _unpacked(batch.column("codes")[i].as_py())
                at = np.flatnonzero(codes >= 0)
                word = numbers[codes[at]]
                at, word = at[word >= 0], word[word >= 0]
                yield _relation_row(batch.column("block")[i].as_py(), at, word, at, word, 1, n_words)
    return run


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, place, word) of all words of each block."""
    for batch in batches:
        for block, lang, data in zip(*(batch.column(name).to_pylist() for name in ("block", "lang", "words")),
                                     strict=True):
            words = _words_in(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()),
                 pa.array(range(len(words)), pa.int64()), pa.array(words, pa.binary())],
                names=["block", "lang", "place", "word"])


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of a task's blocks, added up before the shuffle as far as memory allows."""
    keys, counts, size = [], [], 0

    def added() -> pa.RecordBatch:
        kinds, place = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts or [np.empty(0)]), len(kinds)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(sums, pa.int64())],
                                          names=["key", "n"])

    for batch in batches:
        for data, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            keys.append(_unpacked_sorted(data))
            counts.append(_unpacked(n))
            size += len(keys[-1])
            if size > 1_500_000:
                yield added()
                keys, counts, size = [], [], 0
    yield added()


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key) of all groups of each block."""
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            keys = _unpacked_sorted(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block), pa.int64()),
                                              pa.array(keys, pa.int64())], names=["block", "key"])


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, most_words: int = 200_000,
                     most_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, size, f), of phrases of 1 to ``longest`` words with f >= ``least``, and (lang, n).

    ``phrase`` are the words joined by blanks, f its occurrences within pieces, n all words of the
    language. A block has ``most_words`` words. Up to ``most_broadcast`` frequent groups of a length
    are broadcast; with more, each block is joined with those of its own groups that are frequent.
    A relation is dropped once the next is written.

    NULL and empty texts have no words, NULL languages are ``und``. Repeated rows count each.
    """
    with ScratchTables(docs.sparkSession, shared_folder(docs.sparkSession)) as scratch:
        blocks = scratch.write(occurrence_blocks(docs, most_words).withColumn(
            "block", F.monotonically_increasing_id()))
        counted = written(
            blocks.select("lang", "words", "counts").mapInArrow(_word_counts, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("f")))
        sizes = written(counted.groupBy("lang").agg(F.sum("f").alias("n")))
        frequent = written(numbered(counted.where(F.col("f") >= least)))
        n_words = max(frequent.count(), 1)
        singles = frequent.select("number", "lang", F.decode("word", "UTF-8").alias("phrase"), "f")
        found = [singles.select("lang", "phrase", F.lit(1).alias("size"), "f")]

        # A line end is in no word, so language and word make one key.
        key = F.concat(F.encode("lang", "UTF-8"), F.lit(b"\n"), "word")
        lookup = _Lookup(frequent.select(key.alias("word"), "number"), "word", most_broadcast)
        if lookup.is_small:
            given = lookup.attach(blocks, blocks)
        else:
            places = blocks.select("block", "lang", "words").mapInArrow(
                _block_words, "block long, lang string, place long, word binary")
            pairs = (places.join(frequent.select("lang", "word", "number"), ["lang", "word"]).groupBy("block")
                     .agg(F.collect_list(F.struct(F.col("place").alias("key"), "number")).alias("found")))
            given = blocks.join(pairs, "block", "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))
        relation = scratch.write(given.select("block", "lang", "words", "codes", "found").mapInArrow(
            _first_relation(n_words, lookup.held), _RELATION))
        named = singles
        for length in range(1, longest):
            scratch.drop_all_but(1)
            groups = (relation.select("keys", "counts").mapInArrow(_group_counts, "key long, n long")
                      .groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
            groups = written(numbered(groups))
            first, last = F.expr(f"key div {n_words}"), F.expr(f"key % {n_words}")
            named = written(
                groups.withColumn("a", first).withColumn("b", last)
                .join(named.select(F.col("number").alias("a"), "lang", F.col("phrase").alias("before")), "a")
                .join(singles.select(F.col("number").alias("b"), F.col("phrase").alias("word")), "b")
                .select("number", "lang", F.concat_ws(" ", "before", "word").alias("phrase"), "f"))
            found.append(named.select("lang", "phrase", F.lit(length + 1).alias("size"), "f"))
            if length + 1 < longest:
                lookup = _Lookup(groups, "key", most_broadcast)
                wanted = relation.select("block", "keys").mapInArrow(_block_keys, "block long, key long")
                relation = scratch.write(
                    lookup.attach(relation.select("block", "at", "word", "starts", "groups"), wanted)
                    .mapInArrow(_extend(length, n_words, lookup.held), _RELATION))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return written(every), sizes


def _words(first: int, n: Column) -> Column:
    """Words ``first`` (from 1) to n further of the array ``words``, as a phrase."""
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Of a phrase that occurs a >= ``least`` times, each cut into l and r times found parts gives the
    score floor(1000 a n / (l r)), in whole numbers; the lowest counts, of equal ones the first. A
    phrase whose words lie inside a longer one that occurs as often is left out. Order: score, then a,
    both descending, then the phrase by its bytes. For languages, texts and ``bounds`` see
    ``frequent_phrases``.
    """
    frequent, sizes = frequent_phrases(docs, least, longest, **bounds)
    candidates = frequent.where("size > 1").withColumn("words", F.split("phrase", " ")).withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", F.explode(
        F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(1, F.col("k")).alias("left"),
                       F.array_join(F.expr("slice(words, k + 1, size - k)"), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])
    wide = {name: F.col(name).cast("decimal(19,0)") for name in ("a", "l", "r", "n")}
    # A decimal's quotient would be rounded; div cuts it off.
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    scored = (cuts.join(sizes, "lang").withColumn("score", score)
              .groupBy("lang", "phrase", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inside = candidates.where("size > 2").select("lang", "a", "words", "size", F.explode(
        F.expr("sequence(2, size - 1)")).alias("m"))
    inside = inside.select("lang", "a", "words", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i"))
    inside = (inside.select("lang", F.expr("array_join(slice(words, i, m), ' ')").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("a")))
    left = scored.join(inside, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each share of a language, then of the language: no task sorts all its phrases.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = left.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
