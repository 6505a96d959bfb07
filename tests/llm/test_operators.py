"""Every operator against brute force, on a small table with all the awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from routelens.llm import queries
from routelens.llm.common import read_table
from routelens.llm.components import connected_components
from routelens.llm.language import Scorer as LanguageScorer
from routelens.llm.language import learn_languages
from routelens.llm.encoding import decode_ids, encode_texts
from routelens.llm.minhash import BAND, band_keys, near_duplicates, super_min_hash
from routelens.llm.quality import quality_rules, without_frequent_lines
from routelens.llm.token_counts import (
    PrefixCounter,
    longest_prefix,
    prefix_tokens,
    truncate_texts,
    with_prefix_counts,
)
from routelens.llm.toxicity import PASSAGE, Scorer, _fit

SPACE = " \t\n\r\x0b\x0c"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int, id long"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(5)
    by_lang = {"en": "the of and thing house water tree walk".split(),
               "de": "der die das und über straße größe haus".split()}
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        words = [rnd.choice(by_lang[lang]) + rnd.choice(["", "er", "en", "s"]) for _ in range(70)]
        if i % 5 == 0:
            words[10:10] = ["idiot", "moron"]
        rows.append((i, " ".join(words[:35]) + ".\n" + " ".join(words[35:]), lang, f"s{i % 2}"))
    base = rows[7][1]
    rows += [(100 + i, base, "en", "s0") for i in range(5)]  # copies
    rows += [(110 + i, f"{base} end{i}", "en", "s0") for i in range(25)]  # near copies
    rows += [(200 + i, f"text {i}\n  A common Line of the LAST kind \t\nx", "en", "s1") for i in range(4)]
    rows += [(300, "", "en", "s0"), (301, None, "en", None), (302, " \n\t ", None, "s0"),
             (303, "123 !!", "de", "s0"), (304, "two words", "en", None), (7, base, "en", "s0"),
             (305, "Größe ÀÉ İ Σ <|endoftext|> 12 \x1c it's\r\n\n  x", "de", "s1"),
             (306, "lang " * 3000, "en", "s0"), (307, "a" * 5000, None, "s0")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*row, 1, 9, "k") for row in rows], DOCS).repartition(3).write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (9, None, None)],
                          LABELS).write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    vectors = [(i, list(map(float, base[i % 20] + rng.normal(size=8) * 0.12)), i % 2) for i in range(120)]
    vectors += [(200 + i, vectors[3][1], 1) for i in range(4)]
    vectors += [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [], 1),
                (304, [float("nan")] * 8, 1), (305, vectors[0][1], None), (3, vectors[3][1], 1)]
    spark.createDataFrame([(*v, 1) for v in vectors], VECTORS).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("embeddings", VECTORS),
                         ("pages", "page_id long, url string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def by_id(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


def lower(text):
    return text.encode().lower().decode()


def words(text):
    return lower(text or "").encode().split()


def components(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_line_dedup(spark, folder, rows):
    holders = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(SPACE))].add(doc)
    got = by_id(queries.op1_line_dedup(spark, folder))
    dropped = 0
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        keys = [lower(line.strip(SPACE)) for line in lines]
        kept = [line for line, key in zip(lines, keys, strict=True)
                if len(key) < 20 or len(holders[key]) < 3 or doc == max(holders[key])]
        dropped += len(lines) - len(kept)
        assert (got[doc].n_lines, got[doc].n_dropped) == (len(lines), len(lines) - len(kept))
        assert got[doc].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert dropped > 30


def test_minhash(spark, folder, rows):
    sets = {}
    for doc, text, *_ in rows:
        w = words(text)
        sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(sets, linked)
    expected = {doc: (len(sets[doc]), root[doc], root[doc] == doc) for doc in sets}
    docs = read_table(spark, folder, "documents")
    # Without rounds of leaders, all pairs that shared shingles allow are compared at once.
    for result in (queries.op2_minhash(spark, folder), near_duplicates(docs, rounds=0)):
        got = result.collect()
        assert len(got) == len(rows)
        for row in got:
            assert (row.n_shingles, row.component_id, row.kept) == expected[row.doc_id]


def test_minhash_recall():
    rng = np.random.default_rng(6)
    both, of_one = rng.integers(0, 2**63, (2, 200, 300), np.uint64)
    sets = [np.concatenate([x, y[i * 50:(i + 1) * 50]]) for x, y in zip(both, of_one, strict=True)
            for i in (0, 1)]  # pairs with 300 of 400 in common
    signatures = super_min_hash(np.concatenate(sets), np.repeat(np.arange(400), 350), 400)
    same = signatures[::2] == signatures[1::2]
    assert abs(same.mean() - 0.75) < 0.01
    keys = band_keys(signatures)
    assert ((keys[::2] == keys[1::2]) == same.reshape(200, -1, BAND).all(axis=2)).all()
    # As rare a miss at 0.75 as that of 32 bands of 4.
    assert (1 - 0.75**BAND) ** keys.shape[1] <= (1 - 0.75**4) ** 32


def test_bpe_and_counts(spark, folder, rows):
    word, byte = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    digests, counts = (by_id(q(spark, folder)) for q in (queries.op3_bpe, queries.op6_token_counts))
    for doc, text, *_ in rows:
        ids = word.encode(text or "", add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        assert tuple(digests[doc])[1:] == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())
        n = len(byte.encode(text or "", add_special_tokens=False).ids)
        assert tuple(counts[doc])[1:] == (len((text or "").encode()), n, n > 1024)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 305")
    row = decode_ids(encode_texts(docs, WORDS), WORDS).first()
    assert row.decoded == word.decode(row.ids, skip_special_tokens=False)


def test_prefix_counts():
    with open(BYTES, encoding="utf-8") as file:
        counter = PrefixCounter(file.read())
    library = Tokenizer.from_file(BYTES)
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["the", "ing", " ", "\n", "'re", "'", "é", "😀", "  ", "!", "<|endoftext|>"])
                       for _ in range(8))
        exact = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == exact
        cut = counter.truncate(text, 3)
        assert len(cut) == max(i for i, n in enumerate(exact) if n <= 3)


def test_stored_prefix_counts(spark, rows, tmp_path):
    made = [(doc, text) for doc, text, *_ in rows if doc in (3, 7, 201, 300, 301, 302, 305)]
    docs = spark.createDataFrame([*made, (None, "é😀 it's\n")], "doc_id long, text string")
    with_prefix_counts(docs, BYTES).write.parquet(f"{tmp_path}/counts")
    library = Tokenizer.from_file(BYTES)
    stored = spark.read.parquet(f"{tmp_path}/counts")
    cut = [row.text for row in truncate_texts(stored, 5).collect()]
    asked = stored.select("text", *[prefix_tokens(F.col("prefix_counts"), F.lit(n)).alias(f"at{n}")
                                    for n in (0, 3, 60, 10**6)],
                          longest_prefix(F.col("prefix_counts"), F.lit(5)).alias("longest")).collect()
    assert len(asked) == len(made) + 1
    for row, short in zip(asked, cut, strict=True):
        text = row.text or ""
        exact = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert [row.at0, row.at3, row.at60, row[f"at{10**6}"]] == [
            exact[min(n, len(text))] for n in (0, 3, 60, 10**6)]
        assert row.longest == max(i for i, n in enumerate(exact) if n <= 5)
        assert (short or "") == text[:row.longest]


def test_language(spark, folder, rows):
    got = by_id(queries.op4_language(spark, folder))
    for doc, text, lang, _ in rows:
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert 0 <= got[doc].score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert got[doc].lang_pred == "und" and got[doc].rejected
        elif doc < 60:
            assert got[doc].lang_pred == lang and not got[doc].rejected


def test_embeddings(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    unit = {}
    for i, v in enumerate(vectors):
        x = np.array([] if not v.embedding or None in v.embedding else v.embedding, float)
        if len(x) and np.isfinite(x).all() and x.any() and v.label is not None:
            unit[i] = x / np.linalg.norm(x)
    links = [(i, j) for i in unit for j in unit
             if i != j and vectors[i].label == vectors[j].label and unit[i] @ unit[j] >= 0.93]
    n = collections.Counter(i for i, _ in links)
    root = components({v.vec_id for v in vectors}, [(vectors[i].vec_id, vectors[j].vec_id) for i, j in links])
    expected = sorted((v.vec_id, n[i], root[v.vec_id], root[v.vec_id] == v.vec_id)
                      for i, v in enumerate(vectors))
    assert len(links) > 100
    assert sorted(map(tuple, queries.op5_embeddings(spark, folder).collect())) == expected


def test_language_model(spark, folder, rows):
    counts = collections.Counter()
    for doc, text, *_ in rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update([*words(text), b""])
    total, kinds = sum(counts.values()), len(counts)
    got = by_id(queries.op7_lm(spark, folder))
    model = base = 0.0
    for doc, text, *_ in rows:
        tokens = [*words(text), b""]
        score = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        assert math.isclose(got[doc].base_score, score, rel_tol=1e-9)
        assert (got[doc].n_tokens, got[doc].n_known, got[doc].train_tokens) == (
            len(tokens), sum(w in counts for w in tokens), total)
        model, base = model + got[doc].score, base + score
    assert model > base


def test_toxicity(spark, folder, tmp_path):
    got = by_id(queries.op8_toxicity(spark, folder))
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.3) for row in got.values())
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        text = rnd.choices(plain, k=60)
        for _ in range(3 if i % 4 == 0 else 0):
            text.insert(rnd.randrange(60), rnd.choice(["Idiot,", "moron"]))
        docs.append((i, " ".join(text), "en", "s", 1, 1, "k"))
        labels.append((i, 1, int(i % 4 == 0)))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    held = [row for row in queries.op8_toxicity(spark, str(tmp_path)).collect() if row.held_out]
    assert len(held) > 100
    assert sum(row.predicted == (row.doc_id % 4 == 0) for row in held) >= 0.98 * len(held)


def test_toxicity_keeps_rare_words(spark):
    counted = [("", "w0", 9, 9)] + [(f"w{i}", "slur", 1, 0) for i in range(7)] + [(f"w{i}", f"w{i + 1}", 9, 9) for i in range(50)]
    model = _fit(spark.createDataFrame(counted, "v string, w string, toxic long, plain long"), 8)
    assert model.single[model.words.index("slur")] > model.fresh + 1


def test_packing(spark, folder, rows):
    library = Tokenizer.from_file(WORDS)
    ids = {doc: np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
           for doc, text, *_ in rows}
    times = collections.Counter(doc for doc, *_ in rows)
    pieces = queries.op9_packing(spark, folder).collect()
    covered, rooms = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert (zlib.crc32(part.tobytes()), len(ids[p.doc_id])) == (p.ids_crc32, p.doc_tokens)
        covered.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
        rooms[p.sequence_id].append((p.offset, p.length))
    assert covered == {(d, i): times[d] for d in ids for i in range(len(ids[d]))}
    for held in rooms.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end and length > 0
            end += length
        assert end & (end - 1) == 0 and end <= 2048


def test_quality(spark, folder, rows):
    got = by_id(queries.op10_quality(spark, folder))
    for doc, text, *_ in rows:
        text, w = text or "", (text or "").encode().split()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        row = got[doc]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words,
                row.base_failed) == (
            len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeated), failed)
        assert row.kept == (not failed and 100 * (len(w) - row.n_removed_words) >= 30 * len(w))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = by_id(without_frequent_lines(docs, least=20))
    assert left[115].text == texts()[7][1].split("\n")[1] + " end5"  # its first line is everywhere


def test_frequent_lines_in_small_and_large_hosts(spark):
    """The same group of documents is judged alike in a host of any size, and copies are documents."""
    footer = "all rights are reserved by the owners of this page " * 6
    def group(first, n, host, same):
        return [(first + i, "\n".join([" ".join(f"w{0 if same else i}x{j}" for j in range(20)), footer]), host)
                for i in range(n)]
    rows = [*group(0, 21, "small", False), *group(100, 20, "few", False), *group(200, 30, "copies", True),
            *group(300, 21, "large", False)]
    rows += [(1000 + i, " ".join(f"u{i}y{j}" for j in range(60)), "large") for i in range(6000)]
    rows += [(None, footer, "few")] * 5 + [rows[21]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = quality_rules(docs).groupBy(F.expr("coalesce(doc_id, -100) div 100").alias("group")).agg(
        F.max("n_removed_words").alias("most"), F.min("n_removed_words").alias("least"),
        F.max(F.col("kept").cast("int")).alias("kept")).collect()
    by_group = {row.group: (row.least, row.most) for row in got}
    assert by_group[0] == by_group[3] == (60, 60)
    assert by_group[2] == (80, 80)  # of copies the other line is found as often
    assert by_group[1] == (0, 0) and all(by_group[g] == (0, 0) for g in by_group if g >= 10)


def test_toxicity_pairs_are_counted_in_parts(spark, monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from routelens.llm import toxicity
    texts = ["a b a b", "b a", None, "", "c d e", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 0, 1, 1, 1]), pa.array(texts)], names=["toxic", "text"])
    sums = []
    for most in (200_000, 0):
        monkeypatch.setattr(toxicity, "MOST_PAIRS", most)
        counts = Counter()
        for part in toxicity._count_pairs(iter([batch, batch])):
            for row in part.to_pylist():
                counts[row["v"], row["w"], "toxic"] += row["toxic"]
                counts[row["v"], row["w"], "plain"] += row["plain"]
        sums.append(+counts)
    assert sums[0] == sums[1] and sums[0]["a", "b", "toxic"] == 4 and sums[0]["b", "a", "plain"] == 2


def test_word_after_an_unseen_word(spark):
    counted = [("", "w0", 9, 9), ("", "bad", 90, 1), *[(f"w{i}", f"w{i + 1}", 9, 9) for i in range(50)]]
    model = _fit(spark.createDataFrame(counted, "v string, w string, toxic long, plain long"), 8)
    scorer = Scorer(model)
    assert scorer.rest[len(model.words) + 1] == 0
    unseen = len(model.words)  # and the place of the beginning of a text
    alone = model.single[unseen] + model.rest[unseen] + model.single[model.words.index("bad")]
    assert math.isclose(scorer.features("neverseen bad")[0] * PASSAGE, alone)
    assert scorer.features("bad")[0] * PASSAGE != model.single[model.words.index("bad")]


def test_language_scorer_is_bounded(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    model = learn_languages(docs, F.lit(True))
    scorer, plain = LanguageScorer(model, 1000), LanguageScorer(model)
    texts_ = [f"house{i} straße{i} tree" for i in range(3000)] + ["x" * 5_000_000, "the house"]
    for some in (texts_[:1500], texts_[1500:]):
        got, want = scorer.score(some), plain.score(some)
        assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all()
    assert all(len(chunk) <= 64 for chunk in scorer.places)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (7, 7)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(map(tuple, found.collect())) == {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == columns
    assert {300, 301, 302, 303} & {r.doc_id for r in kept.collect()} == set()
    near = corpus_pipeline.dedup_near(spark, docs, folder)
    assert near.columns == columns and near.where("doc_id BETWEEN 100 AND 134").count() == 0
    lines = corpus_pipeline.dedup_lines(spark, docs, folder)
    assert lines.columns == columns and lines.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() > 0 and "sequence_id" in packed.columns


def test_pipeline_keeps_one_row_of_an_id(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct().count()
    near = corpus_pipeline.dedup_near(spark, docs, folder)
    assert near.where("doc_id = 7").count() == 1 and near.count() == kept
    made = [(1, None, "a"), (1, "some words", "b"), (1, "some words", "b"), (1, " ", "c"),
            (None, "no id", "d"), (None, "no id", "d"), (2, None, "e")]
    odd = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.dedup_near(spark, odd, folder).collect()), key=str)
    assert got == [(1, "some words", "b"), (2, None, "e"), (None, "no id", "d"), (None, "no id", "d")]
