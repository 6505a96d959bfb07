"""Alignment of two tokenizers' tokens on the bytes of a text.

Of each text, the ends of both tokenizers' tokens are summed up, and a dictionary per side leads from
an end to the token that ends there. The intersection of the two key sets, sorted, gives the places
where both end; they slice both id lists into groups, and within a slice every pair of tokens whose
bytes overlap is a link.

Neither tokenizer has a token that reaches over the border between a character that is no white space
and a blank after it, so words are encoded and aligned by themselves, each once while it is
remembered. Where one of a text's words does not give its own bytes back, the text is done as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.bpe import BYTE_PATTERN
from routelens.llm.common import held, slices, written

#: An id pair as one whole number: A's id times this, plus B's id.
_SIDE = 1 << 32
#: Texts of more characters are encoded each by itself.
_LONG = 1000
#: Characters that some tokenizer may take for white space, or for a blank.
_BLANKS = frozenset(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E,
                              *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x2581,
                              0x3000, 0xFEFF]))


class Aligned(NamedTuple):
    """Tokens of either side, groups, links (with repetitions) and the groups' text."""

    n_a: int
    n_b: int
    n_groups: int
    links: list[int]
    groups: str


NOTHING = Aligned(0, 0, 0, [], "")
#: Of a word whose bytes a side does not give back.
_LOST = Aligned(-1, -1, -1, [], "")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + i): byte for i, byte in enumerate(others)}


def _rank_encoder(content: bytes) -> Callable[[str], list[int]] | None:
    """A faster encoder for a byte-level vocabulary whose ids are the order of its merges; None for others.

    It merges by ids. Without long words, whose merges it searches one by one, it gives the same ids as the
    file's own library: that was tried with every code point.
    """
    file = json.loads(content)
    kind, vocab = file["pre_tokenizer"] or {}, file["model"]["vocab"]
    merges = [merge.split(" ") if isinstance(merge, str) else merge for merge in file["model"]["merges"]]
    plain = (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex", True), file["normalizer"])
    if plain != ("ByteLevel", False, True, None) or any(
            vocab["".join(merge)] != 256 + number for number, merge in enumerate(merges)):
        return None
    letters = _byte_letters()
    special = {token["content"] for token in file["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): number for token, number in vocab.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Numbers(dict):
    """Words by number; a new word is given the next one and noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Aligner:
    """Both tokenizers, given by their files' contents, and the words met of late.

    Of more than ``most`` words, or more than ``most_bytes`` of their text, the half used last stays
    after a call.
    """

    def __init__(self, a: bytes, b: bytes, most: int = 300_000, most_bytes: int = 48 << 20):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.ids_a = _rank_encoder(a) or self._ids_a
        self.b = SentencePieceProcessor(model_proto=b)
        letters = _byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = (bytes(letters[c] for c in token) if set(token) <= letters.keys()
                                    else token.encode())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, side))) for side in (self.bytes_a, self.bytes_b))
        # Ids as text, each made once.
        self.names_a, self.names_b = (list(map(str, range(len(side)))) for side in (self.bytes_a, self.bytes_b))
        self.most, self.most_bytes = most, most_bytes
        self.numbers = _Numbers()
        # By word number: n_a, n_b and n_groups, or -1 if a side does not give the bytes back.
        self.counts = np.empty((0, 3), np.int64)
        self.starts = np.zeros(1, np.int64)  # of each word's links, and the end of the last
        self.links = np.empty(0, np.int64)
        self.groups: list[str] = []
        self.used = np.empty(0, np.int64)
        self.calls = self.held_bytes = 0

    def _ids_a(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> Aligned | None:
        """The alignment of a blank and the text; None if a side does not give its bytes back."""
        return self._aligned([text])[0]

    def _aligned(self, texts: list[str]) -> list[Aligned | None]:
        """The alignment of each text. Those that end in no white space, and are not long, are one text together."""
        joins = [0 < len(text) <= _LONG and text[-1] not in _BLANKS for text in texts]
        together = iter(self._joined([text for text, join in zip(texts, joins, strict=True) if join]))
        return [next(together) if join else self._joined([text])[0] for text, join in zip(texts, joins, strict=True)]

    def _joined(self, texts: list[str]) -> list[Aligned | None]:
        """The texts one after the other, each after a blank, on one scale of bytes."""
        if not texts:
            return []
        whole = " ".join(texts)
        a = (self.ids_a if len(texts) > 1 else self._ids_a)(f" {whole}")
        b = self.b.encode(whole)
        ends_a, ends_b = self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum()
        borders = np.cumsum([len(text.encode()) + 1 for text in texts])
        if not (b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b])
                == f" {whole}".encode() and np.isin(borders, ends_a).all() and np.isin(borders, ends_b).all()):
            return [None] if len(texts) == 1 else [self.whole(text) for text in texts]
        # Each end leads to the token that ends there.
        index_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1), strict=True))
        index_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        to_a, to_b = list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))
        name_a, name_b = [self.names_a[i] for i in a], [self.names_b[i] for i in b]
        groups = [f"{name_a[i]}|{name_b[k]}" if j - i == 1 == m - k
                  else f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}"
                  for i, j, k, m in zip(chain([0], to_a), to_a, chain([0], to_b), to_b)]  # noqa: B905
        links = _links(a, b, ends_a, ends_b, np.array(to_a), np.array(to_b)).tolist()
        # Every text ends with a group, and a group of p and q tokens has p + q - 1 links.
        last_a, last_b = np.searchsorted(ends_a, borders) + 1, np.searchsorted(ends_b, borders) + 1
        last = np.searchsorted(np.array(common), borders) + 1
        counts = np.diff(np.array([last_a, last_b, last]), prepend=0).T.tolist()
        result, group, link = [], 0, 0
        for numbers, to_group, to_link in zip(counts, last.tolist(), (last_a + last_b - last).tolist(), strict=True):
            result.append(Aligned(*numbers, links[link:to_link], ";".join(groups[group:to_group])))
            group, link = to_group, to_link
        return result

    def _learn(self) -> None:
        """Align the words numbered last."""
        new, self.numbers.new = self.numbers.new, []
        for start in range(0, len(new), 4096):
            some = [found or _LOST for found in self._aligned(new[start:start + 4096])]
            n_a, n_b, n_groups, links, groups = zip(*some, strict=True)
            self.counts = np.concatenate([self.counts, np.array([n_a, n_b, n_groups]).T])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(list(map(len, links)))])
            self.links = np.concatenate([self.links, np.array(list(chain.from_iterable(links)), np.int64)])
            self.groups += groups
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.held_bytes += 4 * sum(map(len, new))

    def _forget(self) -> None:
        order = np.argsort(-self.used, kind="stable")[:self.most // 2]
        words = list(self.numbers)
        keep, room = [], self.most_bytes // 2
        for number in order.tolist():
            room -= 4 * len(words[number])
            if room < 0:
                break
            keep.append(number)
        kept = np.array(keep, np.int64)
        links, sizes = self._links_of(kept)
        self.links, self.starts = links, np.concatenate([[0], np.cumsum(sizes)])
        self.counts, self.used = self.counts[kept], self.used[kept]
        self.groups = [self.groups[number] for number in keep]
        self.numbers = _Numbers()
        self.numbers.update((words[number], i) for i, number in enumerate(keep))
        self.held_bytes = self.most_bytes // 2 - max(room, 0)

    def _links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of these words, one word's after the other's, and how many each has."""
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        places = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.links[places], sizes

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, str]]:
        """n_a, n_b, n_groups, the linked pairs, times of each, text of the groups, of each text."""
        self.calls += 1
        number = self.numbers.__getitem__
        cut = [np.array([number(word) for word in words_of(text)] if text else [], np.int64) for text in texts]
        self._learn()
        for text, numbers in zip(texts, cut, strict=True):
            counts = self.counts[numbers]
            if len(counts) and counts.min() < 0:
                found = self.whole(text) or NOTHING
                yield *found[:3], *np.unique(np.array(found.links, np.int64), return_counts=True), found.groups
                continue
            links, _ = self._links_of(numbers)
            self.used[numbers] = self.calls
            yield (*counts.sum(axis=0).tolist(), *np.unique(links, return_counts=True),
                   ";".join([self.groups[n] for n in numbers.tolist()]))
        if len(self.numbers) > self.most or self.held_bytes > self.most_bytes:
            self._forget()


def words_of(text: str) -> list[str]:
    """The text cut at blanks after characters that are no white space, without these blanks.

    So a blank and each word, put together, give a blank and the text.
    """
    words = text.split(" ")
    if all(words) and _BLANKS.isdisjoint([word[-1] for word in words]):
        return words
    joined = [words[0]]
    for word in words[1:]:
        before = joined[-1]
        if not before or before[-1] in _BLANKS or not word:
            joined[-1] = f"{before} {word}"  # white space goes on, or the text ends in a blank
        else:
            joined.append(word)
    return joined


def _links(a: list[int], b: list[int], ends_a: np.ndarray, ends_b: np.ndarray, to_a: np.ndarray,
           to_b: np.ndarray) -> np.ndarray:
    """The linked id pairs of each slice, expanded for all slices at once. Slices end before ``to_a``, ``to_b``.

    Within a slice no two ends are equal but the last. So every end of either side closes a stretch
    of bytes that one token of each side covers, and each pair that overlaps has one such stretch.
    """
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    sizes_a, sizes_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    total = sizes_a + sizes_b - 1
    place = np.arange(total.sum()) - np.repeat(total.cumsum() - total, total)
    # One token on a side: it is linked with all of the other side.
    at_a = np.repeat(to_a - sizes_a, total) + np.where(np.repeat(sizes_a, total) > 1, place, 0)
    at_b = np.repeat(to_b - sizes_b, total) + np.where(np.repeat(sizes_b, total) > 1, place, 0)
    several = np.repeat((sizes_a > 1) & (sizes_b > 1), total)
    if several.any():
        ends = np.union1d(ends_a, ends_b)[several]  # one end for each link, in the same order
        at_a[several] = np.searchsorted(ends_a, ends)
        at_b[several] = np.searchsorted(ends_b, ends)
    return a[at_a] * _SIDE + b[at_b]


_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int32())]))
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align_texts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs), one row for each row of ``docs``.

    ``a`` is the path of a byte-level vocabulary that sees a blank before the text, ``b`` that of a
    piece model that adds it. ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of ids; ``pairs`` holds
    the linked id pairs, as A's id times 2**32 plus B's id, with the number of their links.

    NULL and empty texts, and texts that a side does not give back byte by byte, have no tokens:
    zeros, ``''`` and no pairs. Strings of special tokens are plain text. A NULL doc_id stays NULL;
    repeated rows each give a row. Further columns are not read, and no row is shuffled.
    """
    context = docs.sparkSession.sparkContext
    contents = []
    for path in (a, b):
        with open(path, "rb") as file:
            contents.append(file.read())
    content = context.broadcast(tuple(contents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("aligner", *(hashlib.sha256(part).digest() for part in content.value))
        aligner = held(key, lambda: Aligner(*content.value))
        for batch in slices(batches, "text", 1 << 20):
            numbers, groups, pairs, times = [], [], [], []
            for n_a, n_b, n_groups, linked, n, text in aligner.texts(batch.column("text").to_pylist()):
                numbers.append((n_a, n_b, n_groups, n.sum()))
                groups.append(text)
                pairs.append(linked)
                times.append(n)
            sizes = np.cumsum([0, *map(len, pairs)])
            items = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *pairs]), pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *times]), pa.int32())],
                fields=list(_PAIRS.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *[pa.array(column, pa.int64()) for column in np.array(numbers, np.int64).reshape(-1, 4).T],
                 pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)],
                names=["doc_id", *_NUMBERS, "groups", "pairs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, f"doc_id long, {', '.join(f'{name} long' for name in _NUMBERS)}, groups string,"
             " pairs array<struct<pair: bigint, n: int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, is_best): links of each id pair in all rows; best if no pair of its B id has more.

    Pairs are added up per task before the shuffle; there are at most as many as id pairs.
    """
    links = aligned.select(F.explode("pairs").alias("p")).select("p.pair", "p.n")
    counts = written(links.groupBy("pair").agg(F.sum("n").alias("count")))
    of_b = (counts.groupBy(F.pmod("pair", F.lit(_SIDE)).alias("b")).agg(F.max("count").alias("most")))
    return counts.join(of_b, F.pmod("pair", F.lit(_SIDE)) == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def alignment_scores(docs: DataFrame, a: str, b: str, most_broadcast: int = 1_000_000,
                     copies: int = 16) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of ``docs``.

    ``n_best`` counts the links whose pair has the highest count, over all rows, of its B id, ties
    included; ``count_sum`` adds the counts of all links' pairs. Without tokens ``groups_sha256`` is
    ``''``. For the rest see ``align_texts``.

    Up to ``most_broadcast`` pairs, their counts are broadcast. With more they are shuffled, in so
    many ``copies`` that a pair found in most texts is met in several tasks.
    """
    aligned = written(align_texts(docs, a, b).select(
        "doc_id", *_NUMBERS, "pairs",
        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
        .withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(aligned))
    links = aligned.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.n")
    if counts.count() <= most_broadcast:
        joined = links.join(F.broadcast(counts), "pair")
    else:
        copied = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        joined = links.withColumn("copy", F.pmod(F.xxhash64("row"), F.lit(copies)).cast("int")).join(
            copied, ["pair", "copy"])
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return aligned.drop("pairs").join(sums, "row", "left").select(
        "doc_id", *_NUMBERS, *[F.coalesce(name, F.lit(0).cast("long")).alias(name)
                               for name in ("n_best", "count_sum")], "groups_sha256")
