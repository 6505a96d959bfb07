"""Token counts at every prefix of a text, by dynamic programming over its bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from routelens.llm.bpe import BYTE_PATTERN, SIMPLE, Vocabulary, encoder_of, shared, split

#: White space other than single blanks and line ends between other characters.
_UNUSUAL = re.compile(r"[^\S \n]|\s\s|^\s|\s\Z")
_SPACE_RUN = regex.compile(r"\p{White_Space}+")
_ENDING_SPACE = regex.compile(r"\p{White_Space}*\Z")
_LAST_RUN = regex.compile(r"\p{White_Space}*\P{White_Space}*\Z")


class PrefixCounter:
    """Exact token counts with a byte-level vocabulary (given as its JSON text)."""

    def __init__(self, content: str, most: int = 150_000):
        self.vocabulary = Vocabulary(content)
        self.pattern = regex.compile(BYTE_PATTERN)
        names = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names)) or r"(?!)")
        self.first, self.later = _Chunks(self, "", most), _Chunks(self, " ", most)
        self.most = most
        self.pieces: dict[str, int] = {}

    def piece_counts(self, piece: str) -> list[int]:
        """Entry i: tokens of the first i bytes of a piece of split text.

        The encoding of a prefix is that of a shorter prefix and one token more, and only
        one token ending there agrees with the last token of what stands before it.
        """
        vocabulary = self.vocabulary
        size, agree = vocabulary.size, vocabulary.compatible
        word = vocabulary.mapped(piece)
        counts, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        for end, token in vocabulary.matcher.iter(word):
            end += 1
            if last[end] < 0:
                start = end - size[token]
                if start == 0 or agree(last[start], token):
                    last[end] = token
                    counts[end] = counts[start] + 1
        return counts

    def piece_count(self, piece: str) -> int:
        known = self.pieces.get(piece)
        if known is None:
            known = self.piece_counts(piece)[-1]
            if len(self.pieces) >= 3 * self.most:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = known
        return known

    def split_count(self, text: str) -> int:
        return sum(map(self.piece_count, split(self.pattern, text)))

    def _plain(self, text: str) -> int:
        if _UNUSUAL.search(text):
            return self.split_count(text)
        total = -self.piece_count("\n")
        for line in text.split("\n"):
            first, *later = line.split(" ")
            total += self.first[first] + sum(map(self.later.__getitem__, later))
            total += self.piece_count("\n")
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text. NULL and empty texts have none; special strings count 1."""
        text = text or ""
        if not any(name in text for name in self.vocabulary.specials):
            return self._plain(text) if text else 0
        total = place = 0
        for found in self.special.finditer(text):
            total += 1 + (self._plain(text[place:found.start()]) if found.start() > place else 0)
            place = found.end()
        return total + (self._plain(text[place:]) if place < len(text) else 0)

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Entry i: tokens of the first i characters, encoded as a text of its own.

        Inside a piece the counts are those of the piece. Three kinds of prefix are split
        otherwise than the whole text at their end: those that end in white space, inside a
        short ending such as 're, or inside a special string; there the tail is counted anew.
        """
        text = text or ""
        counts = np.zeros(len(text) + 1, np.int64)
        total = place = 0
        while True:
            found = self.special.search(text, place)
            stop = found.start() if found else len(text)
            self._segment(text[place:stop], counts[place:stop + 1], total)
            total = int(counts[stop])
            if not found:
                return counts
            segment, name = text[place:stop], found[0]
            stable = self._stable(segment)
            for end in range(1, len(name)):
                counts[stop + end] = counts[place + stable] + self.split_count(
                    segment[stable:] + name[:end])
            total += 1
            place = stop + len(name)
            counts[place] = total

    @staticmethod
    def _stable(text: str) -> int:
        """A place such that text to come cannot change how what stands before it is split."""
        end = _ENDING_SPACE.search(text).start()
        return end if end < len(text) else _LAST_RUN.search(text).start()

    def _segment(self, text: str, counts: np.ndarray, total: int) -> None:
        counts[0] = total
        start = 0
        for piece in split(self.pattern, text):  # the pieces cover the text
            of_bytes = self.piece_counts(piece)
            at = 0
            for i, char in enumerate(piece, 1):
                at += len(char.encode())
                counts[start + i] = total + of_bytes[at]
            if piece[0] == "'" and piece[1:].isalpha():
                for i in range(1, len(piece)):
                    counts[start + i] = total + self.split_count(piece[:i])
            total += of_bytes[-1]
            start += len(piece)
        for found in _SPACE_RUN.finditer(text):  # at the end of a text a run is one piece
            start, run = found.start(), found[0]
            of_bytes = self.piece_counts(run)
            at = 0
            for i, char in enumerate(run, 1):
                at += len(char.encode())
                counts[start + i] = counts[start] + of_bytes[at]

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most so many tokens."""
        return text[:_longest(self.prefix_counts(text), budget)]


class _Chunks(dict):
    """Token counts of chunks between blanks, with the blank before them."""

    def __init__(self, counter: PrefixCounter, before: str, most: int):
        self.counter, self.before, self.most = counter, before, most

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.most:
            self.clear()
        simple = SIMPLE.fullmatch(chunk)
        if simple:
            word, mark = simple.groups()
            count = self.counter.piece_count(self.before + word)
            count += self.counter.piece_count(mark) if mark else 0
        else:
            count = self.counter.split_count(self.before + chunk)
        if len(chunk) <= 64:
            self[chunk] = count
        return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text, by the vocabulary at that path.

    NULL texts count as empty. A NULL doc_id stays NULL; repeated rows each give a row. No
    shuffle.
    """
    content = shared(docs.sparkSession.sparkContext, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder_of(PrefixCounter, content.value)
        for batch in batches:
            tokens = pa.array([counter.count(text.as_py()) for text in batch.column("text")],
                              pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"),
                                              tokens], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        .alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def _longest(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens; counts may fall again."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _packed(counts: np.ndarray) -> bytes:
    """Steps from each count to the next, compressed: the first count is always 0."""
    return zlib.compress(np.diff(counts).astype("<i4").tobytes())


def _unpacked(stored: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(stored), "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def with_prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``prefix_counts``, the exact tokens of every prefix of ``text``, compressed.

    Written with its rows, it answers ``prefix_tokens`` and ``longest_prefix`` for any place and
    budget without encoding again. A NULL text counts as empty. No shuffle.
    """
    content = shared(docs.sparkSession.sparkContext, vocabulary)

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        counter = encoder_of(PrefixCounter, content.value)
        return pa.array([_packed(counter.prefix_counts(text.as_py())) for text in texts], pa.binary())

    return docs.withColumn("prefix_counts", counted("text"))


@arrow_udf(LongType())
def _tokens_at(stored: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for row, place in zip(stored, places.to_pylist(), strict=True):
        if row.is_valid and place is not None:
            counts = _unpacked(row.as_py())
            out.append(int(counts[min(max(place, 0), len(counts) - 1)]))
        else:
            out.append(None)
    return pa.array(out, pa.int64())


@arrow_udf(LongType())
def _longest_of(stored: pa.Array, budgets: pa.Array) -> pa.Array:
    out = []
    for row, budget in zip(stored, budgets.to_pylist(), strict=True):
        known = row.is_valid and budget is not None
        out.append(_longest(_unpacked(row.as_py()), max(budget, 0)) if known else None)
    return pa.array(out, pa.int64())


def prefix_tokens(prefix_counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters; of the whole text if it is shorter."""
    return _tokens_at(prefix_counts, chars.cast("long"))


def longest_prefix(prefix_counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens; a negative one counts as 0."""
    return _longest_of(prefix_counts, budget.cast("long"))


def truncate_texts(docs: DataFrame, budget: int) -> DataFrame:
    """Rows of ``with_prefix_counts`` with ``text`` cut to ``budget`` tokens, from the stored counts.

    Their ``prefix_counts`` stay those of the whole text.
    """
    chars = longest_prefix(F.col("prefix_counts"), F.lit(budget))
    return docs.withColumn("text", F.col("text").substr(F.lit(1), chars.cast("int")))
