"""Alignment against the tokenizers' whole encodings and all pairs of tokens."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from routelens.llm import queries
from routelens.llm.alignment import Aligner, align_texts, alignment_scores, words_of

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, n_a long, pairs string, row long, pair long"
PARTS = ["a", "the", " ", "  ", "\n", "\t", "\u00a0", "é", "😀", "'re", "'", "!", "\u2581", "\u3000", "\x1c",
         "\x85", "12", "<|endoftext|>", "<s>", "<0x41>", "\u200b", "\ufeff", "\u0301", "日本", "\r\n", "ing", "-"]


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible}
    for x in range(256):
        if x not in visible:
            letters[chr(256 + len(letters) - len(visible))] = x
    def spelled(text):
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b
    return spelled


def brute(spelled, text):
    """n_a, n_b, groups, links: every A token with every B token."""
    if not text:
        return 0, 0, [], []
    ids_a, bytes_a, ids_b, bytes_b = spelled(text)
    if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
        return 0, 0, [], []
    ends_a = [sum(map(len, bytes_a[:i + 1])) for i in range(len(ids_a))]
    ends_b = [sum(map(len, bytes_b[:i + 1])) for i in range(len(ids_b))]
    links = [(x, y) for x, end, part in zip(ids_a, ends_a, bytes_a, strict=True)
             for y, other, piece in zip(ids_b, ends_b, bytes_b, strict=True)
             if end - len(part) < other and other - len(piece) < end]
    groups, start = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append("|".join(",".join(str(x) for x, at in zip(ids, ends, strict=True) if start < at <= end)
                               for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        start = end
    return len(ids_a), len(ids_b), groups, links


def texts():
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(250)]
    rows += [(300 + i, " ".join(rnd.choice(["Größe", "unbelievable", "words,", "of", "straße."]) for _ in range(50)))
             for i in range(20)]
    return [*rows, (400, None), (401, ""), (402, " "), (403, "a "), (404, "  "), (405, "x" * 900), (None, "of words,"),
            rows[4], rows[4], (406, "\u2581"), (407, "end of it\u2581 more")]


@pytest.mark.parametrize("bounds", [{}, {"most_broadcast": 0}])
def test_against_all_pairs(spark, tokenizers, bounds):
    rows = texts()
    docs = spark.createDataFrame([(*row, "en", 1, "p", 2, 3) for row in rows], DOCS).repartition(3)
    aligned = [(doc, *brute(tokenizers, text)) for doc, text in rows]
    counts = collections.Counter(link for *_, links in aligned for link in links)
    highest = collections.Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    want = [(doc, n_a, n_b, len(groups), len(links), sum(counts[link] == highest[link[1]] for link in links),
             sum(counts[link] for link in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, groups, links in aligned]
    assert sum(1 for row in want if row[1]) > 150
    got = alignment_scores(docs, A, B, **bounds)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_groups_and_pairs(spark, tokenizers):
    rows = [(1, "unbelievable Größe, 日本"), (2, None)]
    got = {r.doc_id: r for r in align_texts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    n_a, n_b, groups, links = brute(tokenizers, rows[0][1])
    assert (got[1].n_a, got[1].n_b, got[1].groups) == (n_a, n_b, ";".join(groups)) and "," in got[1].groups
    assert {(p.pair >> 32, p.pair % 2**32): p.n for p in got[1].pairs} == collections.Counter(links)
    assert tuple(got[2]) == (2, 0, 0, 0, 0, "", [])


def test_words_cut_and_forgotten(tokenizers):
    """Words give the same as whole texts, also where hardly any word is remembered."""
    contents = [open(path, "rb").read() for path in (A, B)]  # noqa: SIM115
    rnd = random.Random(9)
    for most, most_bytes in ((300_000, 48 << 20), (20, 48 << 20), (300_000, 200)):
        aligner = Aligner(*contents, most, most_bytes)
        for _ in range(12):
            some = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(40)]
            for text, (n_a, n_b, n_groups, pairs, times, groups) in zip(some, aligner.texts(some), strict=True):
                assert not text or " ".join(words_of(text)) == text
                want = brute(tokenizers, text)
                assert (n_a, n_b, n_groups, groups) == (*want[:2], len(want[2]), ";".join(want[2]))
                assert {(p >> 32, p % 2**32): n for p, n in zip(pairs.tolist(), times.tolist(), strict=True)
                        } == collections.Counter(want[3])
        assert len(aligner.numbers) <= most and aligner.held_bytes <= most_bytes


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_alignment(spark, str(tmp_path)).count() == 0
