"""Groups of near copies, and documents that share a passage, against brute force."""

import random

import pytest

from routelens.llm.minhash import near_duplicates


def groups(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and"]
    rows = []

    def add(text):
        rows.append((len(rows) + 1, " ".join(text)))

    for _ in range(2):  # copies of one text with one to nine words replaced, often by the same ones
        text = rnd.sample(words, rnd.randint(120, 150))
        for _ in range(120):
            copy = list(text)
            for place in rnd.sample(range(len(copy)), rnd.randint(1, 9)):
                copy[place] = rnd.choice(common + words[:20])
            add(copy)
    passage = rnd.sample(words, 80)  # a passage that is just too little, or enough, of a text
    for _ in range(120):
        add(passage + rnd.sample(words, rnd.choice([8, 12, 13, 14, 30, 60])))
    chain = rnd.sample(words, 400)  # each text is linked with the next ones alone
    for i in range(0, 300, 10):
        add(chain[i:i + 100])
    for _ in range(30):  # one to three places changed in a text shorter than the window
        add(rnd.sample(words[:6], 3))
    rnd.shuffle(rows)
    return rows + [(1, rows[7][1]), (9001, None), (9002, "")]


@pytest.mark.parametrize("seed,rounds", [(1, 0), (2, 1)])
def test_groups(spark, seed, rounds):
    rows = groups(seed)
    sets = []
    for doc, text in rows:
        w = (text or "").split()
        sets.append((doc, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {doc: doc for doc, _ in rows}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if x and 100 * len(x & y) >= 75 * len(x | y)]
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert 100 < len(set(root.values())) < len(rows) - 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, rounds=rounds).collect()
    assert sorted((row.doc_id, row.n_shingles) for row in got) == sorted((doc, len(x)) for doc, x in sets)
    assert not [row for row in got if row.component_id != root[row.doc_id]]
    assert all(row.kept == (root[row.doc_id] == row.doc_id) for row in got)
