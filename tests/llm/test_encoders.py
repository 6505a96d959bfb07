"""Both word encoders against the vocabulary's own library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from routelens.llm.bpe import LONG, MergingEncoder, WordEncoder
from routelens.llm.common import BATCHES, bound_batches

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoders():
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    return Tokenizer.from_str(content), MergingEncoder(content), WordEncoder(content)


def _compare(encoders, texts):
    library, *ours = encoders
    for text, expected in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        for encoder in ours:
            assert encoder.ids(text).tolist() == expected.ids, text[:80]


@pytest.mark.parametrize("first, last", [(0, 0x3000), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10900, 0x11000),
                                         (0x12400, 0x12700), (0x16E00, 0x17000), (0x1DF00, 0x1E700)])
def test_every_code_point(encoders, first, last):
    _compare(encoders, [f"a{chr(c)}! {chr(c)}B" for c in range(first, last)])


def test_marks_in_pairs(encoders):
    marks = [0x300, 0x301, 0x323, 0x345, 0x7FD, 0x898, 0x89F, 0x1ABF, 0x1ACE, 0x1133B, 0x1E130]
    _compare(encoders, [f"e{chr(a)}{chr(b)} {chr(b)}{chr(a)}" for a in marks for b in marks])


def test_mixed_and_long_texts(encoders):
    letters = "abcdeTHSN's'll're ..,!?09é É ſŉ Ÿ…—’ñ́̇ İΣς漢字\x1c\x85​ \n\t"
    pick = random.Random(5)
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    texts += ["", " \n ", "<|endoftext|>A b<|startoftext|>", "ab" * LONG, f"é {'q' * (LONG + 1)} 漢 tail",
              "x" * 600_000, "word é, " * 90_000, "\x1c! " * 200_000]
    _compare(encoders, texts)


def test_batches_are_bounded_unless_chosen(spark):
    name, other = BATCHES
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        spark.conf.set(name, BATCHES[name][0])
        spark.conf.set(other, "3m")
        bound_batches(spark)
        assert (spark.conf.get(name), spark.conf.get(other)) == (BATCHES[name][1], "3m")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
