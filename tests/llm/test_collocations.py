"""Phrase mining against counting all phrases, with broadcast groups and without, and with tiny blocks."""

import collections
import random
import re

import pytest

from routelens.llm import queries
from routelens.llm.collocations import collocations, frequent_phrases

DOCS = "doc_id long, text string, lang string, n long, rank long, words string, block string"


def texts():
    rnd = random.Random(3)
    word = ["New", "york", "the", "of", "é", "x\u00a0y", "it's", "Zu", "q\x1cz", "😀"]
    rows = []
    for i in range(40):
        parts = [rnd.choice(word) for _ in range(rnd.randint(0, 60))]
        text = "".join(p + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b", "!?"]) for p in parts)
        rows.append((i, text, rnd.choice(["en", "de", None, "", "a\nb"])))
    rows += [(50, None, "en"), (51, "", "en"), (52, " \t. ", None), (53, "lang " * 3000, "en"),
             (54, "A-Z " * 40 + "End", None), (None, "new york new york", "en"), rows[3], rows[3]]
    return rows


def expected(rows, least, longest, top):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w))
              for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]}
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
                  for lang, some in found.items()
                  for rank, (score, a, phrase, l, r) in enumerate(sorted(some)[:top], 1))


@pytest.mark.parametrize("bounds, least, top", [
    ({}, 3, 2000), ({}, 6, 5), ({"most_broadcast": 0}, 6, 2000), ({"most_words": 7, "most_broadcast": 30}, 3, 2000)])
def test_against_all_phrases(spark, bounds, least, top):
    rows = texts()
    docs = spark.createDataFrame([(*row, 7, 7, "w", "b") for row in rows], DOCS).repartition(3)
    want = expected(rows, least, 5, top)
    assert len(want) > 10
    got = collocations(docs, least=least, top=top, **bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


def test_frequent_phrases(spark):
    docs = spark.createDataFrame([("a b a b. a b", None)], "text string, lang string")
    phrases, sizes = frequent_phrases(docs, least=2, longest=3)
    assert sorted(map(tuple, phrases.collect())) == [
        ("und", "a", 1, 3), ("und", "a b", 2, 3), ("und", "b", 1, 3)]
    assert list(map(tuple, sizes.collect())) == [("und", 6)]


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2**63 long before a language has so many words; the division is tried by itself."""
    row = spark.sql("SELECT div(cast(1000 AS decimal(4,0)) * cast(9999999999999 AS decimal(19,0))"
                    " * cast(99999999999999 AS decimal(19,0)), cast(9999999999999 AS decimal(19,0))"
                    " * cast(99999999999 AS decimal(19,0))) AS score").first()
    assert row.score == 1000 * 9999999999999 * 99999999999999 // (9999999999999 * 99999999999)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_collocations(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string").write.parquet(
        f"{tmp_path}/blank/documents.parquet")
    assert queries.op12_collocations(spark, f"{tmp_path}/blank").count() == 0
