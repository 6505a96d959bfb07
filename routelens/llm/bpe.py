"""BPE by backtracking over longest matches; decoding by offset tables.

A sequence of tokens is what the merges give exactly if every two neighbours are: no merge
across their border would have come before the merges that made them. So the encoder takes
the longest token at each place, checks it against its neighbour in a table of compatible
pairs, takes a shorter one if they disagree, and steps back where none is left. A place it
had to leave is never tried again, so the time is linear.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property
from itertools import groupby

import ahocorasick
import numpy as np
import regex
import tiktoken
from pyspark import SparkContext
from tokenizers import Tokenizer

from routelens.llm.common import held

#: The printable byte ranges that byte-level vocabularies write as themselves.
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
              *range(ord("®"), ord("ÿ") + 1)]
#: How the byte vocabulary splits text; white space as Unicode has it.
BYTE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Chunks that either pattern splits before their mark alone.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
#: Characters whose case, composition and class are alike in every version of Unicode in use here, and
#: the word pattern for lower-cased text of these alone.
SURE = re.compile("[!-~À-ÖØ-öø-įı-ſ–—‘’“”…]*")
SURE_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-įı-ſ–—‘’“”…]*")
SURE_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")

#: Parts of long texts, cut before white space where there is any; pieces of more characters are long.
PART = re.compile(r"(?s).{1,500000}(?=[\t-\r ]|\Z)|[^\t-\r ]+")
LONG = 200

#: Stands behind the last byte of a word; no byte is written as this character.
END = "\ue000"
_FAR = 1 << 40
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones themselves, others from 256 on."""
    chars, spare = [], 256
    for byte in range(256):
        if byte in _PRINTABLE:
            chars.append(chr(byte))
        else:
            chars.append(chr(spare))
            spare += 1
    return chars


#: Letters and numbers that the pattern's library knows and the tokenizers, of an
#: older Unicode version, do not.
_NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4
a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168
1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead
"""
_UNKNOWN = re.compile("[" + "".join(
    "-".join(chr(int(end, 16)) for end in span.split("-")) for span in _NEWER.split()) + "]")


def split(pattern: regex.Pattern, text: str) -> list[str]:
    """The pieces of a text."""
    if text.isascii() or not _UNKNOWN.search(text):
        return pattern.findall(text)
    known = _UNKNOWN.sub("\u0378", text)  # which is neither letter nor number
    return [text[found.start():found.end()] for found in pattern.finditer(known)]


class Vocabulary:
    """Tokens, merges and matching automaton of one tokenizer file, given as its JSON text."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.has_end = bool(suffix)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {**model["vocab"], **self.specials}
        size = max(self.names.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.pairs: dict[int, int] = {}
        strings: dict[int, str] = {}
        for char in byte_chars():
            strings[model["vocab"][char]] = char
            if suffix:
                strings[model["vocab"][char + suffix]] = char + END
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            if made in strings:
                raise ValueError(f"two merges make {a + b!r}")
            strings[made] = strings[left] + strings[right]
            self.rank[made], self.left[made], self.right[made] = rank, left, right
            self.pairs[left << 20 | right] = rank
        reached = {t: s for t, s in strings.items()
                   if self.rank[t] < 0 or self._agree(self.left[t], self.right[t], True)}
        self.size = [0] * size
        self.reached = reached
        for token, string in reached.items():
            self.size[token] = len(string)
        ids = {string: token for token, string in reached.items()}
        self.most = max(map(len, ids))
        # The automaton's goto steps: by character the next node and the token that ends there.
        self.goto: dict[str, tuple[dict, int]] = {}
        nodes = {"": self.goto}
        for string in sorted({s[:i] for s in ids for i in range(1, len(s) + 1)}):
            nodes[string] = {}
            nodes[string[:-1]][string[-1]] = (nodes[string], ids.get(string, -1))
        self.shorter = [-1] * size
        for string, token in ids.items():
            for end in range(len(string) - 1, 0, -1):
                if string[:end] in ids:
                    self.shorter[token] = ids[string[:end]]
                    break
        self.table: dict[int, bool] = {}
        self.chars = byte_chars()

    def _agree(self, a: int, b: int, merged: bool = False) -> bool:
        """Whether ``a`` and ``b`` can stand side by side (``merged``: below their own merge).

        Goes back in time along the right edge of ``a`` and the left edge of ``b``: a merge
        across the border must not come before the merges that end its two sides' lives.
        Of equal merges the left one comes first.
        """
        until_a = until_b = _FAR
        while True:
            rank = None if merged else self.pairs.get(a << 20 | b)
            merged = False
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                until_b, b = self.rank[b], self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 20 | b
        known = self.table.get(pair)
        if known is None:
            if len(self.table) >= 200_000:
                self.table.clear()
            known = self.table[pair] = self._agree(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of split text."""
        return self.encode_mapped(self.mapped(piece))

    def encode_mapped(self, word: str) -> list[int]:
        """Token ids of a piece whose bytes are written as the characters that stand for them."""
        if self.has_end:
            word += END
        size, shorter, table, most, n = self.size, self.shorter, self.table, self.most, len(word)
        left = bytearray(n + 1)  # places that no encoding passes
        if self.has_end:
            left[n - 1] = 1
        out: list[int] = []
        place, last, step = 0, -1, True
        while True:
            if step:  # the longest token that begins here
                node, token = self.goto, -1
                for char in word[place:place + most]:
                    if char not in node:
                        break
                    node, ends = node[char]
                    if ends >= 0:
                        token = ends
            while token >= 0:
                if not left[place + size[token]]:
                    if last < 0:
                        break
                    fits = table.get(last << 20 | token)
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            step = token >= 0
            if step:
                out.append(token)
                place += size[token]
                last = token
                if place == n:
                    return out
            else:
                left[place] = 1
                token = out.pop()
                place -= size[token]
                token = shorter[token]
                last = out[-1] if out else -1

    def mapped(self, piece: str) -> str:
        """The bytes of a piece as the characters that stand for them."""
        if piece.isascii() and piece.isalnum():
            return piece
        return "".join([self.chars[byte] for byte in piece.encode()])

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Finds every token that ends at each place of a text in one pass."""
        automaton = ahocorasick.Automaton()
        for token, string in self.reached.items():
            automaton.add_word(string, token)
        automaton.make_automaton()
        return automaton

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All token strings in one block of bytes, and where each begins."""
        return offset_table({token: name for name, token in self.names.items()})

    @cached_property
    def decimals(self) -> tuple[np.ndarray, np.ndarray]:
        return offset_table({token: str(token) for token in self.names.values()})


def offset_table(strings: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """Every string followed by a blank, end to end, and the offsets of their beginnings."""
    rows = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
    return (np.frombuffer(b"".join(rows), np.uint8),
            np.cumsum([0, *map(len, rows)]).astype(np.int64))


def spell(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray], chunk: int = 1 << 18) -> bytes:
    """The strings of ``ids`` joined by blanks, gathered from an offset table."""
    block, offsets = table
    parts = []
    for start in range(0, len(ids), chunk):
        part = ids[start:start + chunk].astype(np.int64)
        first, lengths = offsets[part], offsets[part + 1] - offsets[part]
        ends = np.cumsum(lengths)
        step = np.repeat(first - ends + lengths, lengths)
        parts.append(block[step + np.arange(ends[-1])].tobytes())
    return b"".join(parts)[:-1]


def _two_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class WordEncoder(dict):
    """Encodes texts with a vocabulary of words that drops white space and case.

    As a dict it maps chunks between white space, and the pieces they are split into, to their
    ids, two bytes each; chunks never influence each other, and a piece is a chunk like others.
    It starts anew when it holds ``most`` of them.
    """

    def __init__(self, content: str, most: int = 400_000):
        self.content, self.vocabulary = content, Vocabulary(content)
        if max(self.vocabulary.names.values()) >= 1 << 16:
            raise ValueError("ids of two bytes are too small for this vocabulary")
        self.most = most
        names = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names)) or r"(?!)")

    def __missing__(self, chunk: str) -> bytes:
        if SURE.fullmatch(chunk):
            text = chunk.lower()
            simple = SIMPLE.fullmatch(text)
            if simple:
                word, mark = simple.groups()
                ids = self._piece(word) + self._piece(mark) if mark else self._piece(word)
            else:
                ids = b"".join(map(self._piece, SURE_WORD.findall(text)))
        else:
            ids = b"".join(_two_bytes(self.vocabulary.encode_mapped(piece)) for piece in self._foreign(chunk))
        self._keep(chunk, ids)
        return ids

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.content)

    def _foreign(self, chunk: str) -> list[str]:
        """The pieces of a chunk, their bytes mapped; case, composition and classes as the file's library has them."""
        text = self.library.normalizer.normalize_str(chunk)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _piece(self, piece: str) -> bytes:
        ids = self.get(piece)
        if ids is None:
            ids = _two_bytes(self.vocabulary.encode_piece(piece))
            self._keep(piece, ids)
        return ids

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids

    def _plain(self, text: str) -> bytes:
        if any(char in text for char in _SEPARATORS):  # split() takes them for white space
            return self[text]
        return b"".join(map(self.__getitem__, text.split()))

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text. NULL and empty texts have none."""
        text = text or ""
        if not any(name in text for name in self.vocabulary.specials):
            return np.frombuffer(self._plain(text), "<u2")
        parts, place = [], 0
        for found in self.special.finditer(text):
            parts.append(self._plain(text[place:found.start()]))
            parts.append(np.array([self.vocabulary.specials[found[0]]], "<u2").tobytes())
            place = found.end()
        parts.append(self._plain(text[place:]))
        return np.frombuffer(b"".join(parts), "<u2")

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by blanks, special ones too, as UTF-8."""
        return spell(ids, self.vocabulary.token_bytes) if len(ids) else b""


class MergingEncoder(WordEncoder):
    """The same ids, faster: the words of a text are encoded in one call that merges by rank.

    The ids of this vocabulary are in the order of its merges, and a blank, which no piece holds, stands
    for the end of a word. Chunks that are long, or hold a character that is not ``SURE``, go the way of
    the base class; only these are remembered.
    """

    def __init__(self, content: str, most: int = 50_000):
        super().__init__(content, most)
        vocabulary = self.vocabulary
        bytes_of = {char: bytes([byte]) for byte, char in enumerate(vocabulary.chars)} | {END: b" "}
        made = sorted((vocabulary.rank[token], token) for token in vocabulary.reached if vocabulary.rank[token] >= 0)
        ids = [token for _, token in made]
        if not vocabulary.has_end or ids != sorted(ids) or ids[:1] <= [2 * len(vocabulary.chars) - 1]:
            raise ValueError("ids are not in the order of merges")
        ranks = {b"".join(map(bytes_of.__getitem__, string)): token for token, string in vocabulary.reached.items()}
        # A special token that no text holds: without any, each place of a text is tried for one.
        self.ranked = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks,
                                        special_tokens={"\n\n": len(vocabulary.rank)})

    def _merged(self, text: str) -> bytes | None:
        """The ids of a text of ``SURE`` characters and white space; None if it has a long piece."""
        pieces = SURE_WORD.findall(text.lower())
        if not pieces:
            return b""
        if max(map(len, pieces)) > LONG:  # whose merges would be searched one by one
            return None
        return self.ranked.encode_to_numpy(f"{' '.join(pieces)} ").astype("<u2").tobytes()

    def _plain(self, text: str) -> bytes:
        # No piece reaches over white space.
        return b"".join([self._part(part[0]) for part in PART.finditer(text)])

    def _part(self, text: str) -> bytes:
        if SURE_TEXT.fullmatch(text):
            ids = self._merged(text)
            if ids is not None:
                return ids
        elif any(char in text for char in _SEPARATORS):
            return self[text]
        parts: list[bytes] = []
        for sure, chunks in groupby(text.split(), lambda chunk: len(chunk) <= LONG and bool(SURE.fullmatch(chunk))):
            parts += [self._merged(" ".join(chunks))] if sure else map(self.__getitem__, chunks)
        return b"".join(parts)


def shared(spark_context: SparkContext, path: str):
    """The content of a vocabulary file, sent to every executor once."""
    with open(path, encoding="utf-8") as file:
        return spark_context.broadcast(file.read())


def encoder_of(kind, content: str):
    """One encoder of a kind and vocabulary in each Python worker."""
    return held((kind, hash(content)), lambda: kind(content))
