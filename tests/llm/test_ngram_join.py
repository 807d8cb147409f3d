import random
import re

import numpy as np
import pytest

from isofield.llm import ngram_join
from isofield.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(FOLD))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in docs}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sorted((i, len(s), label[i]) for i, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "Ab,c"]
    passage = [rng.choice(words) for _ in range(40)]
    docs, base = [], []
    for k in range(12):
        base.append([rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 60, 200]))])
    for k in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w += passage
        sep = rng.choice([" ", "\n", "\t "])
        docs.append((k * 3 + 5, sep.join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return docs + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1, "one"), (1005, "  é"), (1006, "x " * 20000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_hot_ngrams_go_straight_to_their_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SETS", 4)
    docs = corpus(3)
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_a_large_group_of_near_copies_without_a_common_source(spark):
    rng = random.Random(9)
    base = [f"t{k}" for k in range(160)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (0, "A b c d e f", 3), (None, "a b c d e f", 4)], "doc_id long, text string, key int")
    rows = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(twice).collect() if r.doc_id is not None)
    assert rows == [(False, 0, 2, 0), (False, 1, 2, 0), (False, 1, 2, 0)]
    left = ngram_join.representatives(twice.where("doc_id is not null"))
    assert left.columns == ["doc_id", "text", "key"] and [r.doc_id for r in left.collect()] == [0]


@pytest.mark.parametrize("docs", [[(1, "one two")], [(1, "a"), (2, "b c d e"), (3, "B c d e")], [(1, "x " * 1_050_000), (2, "one two"), (3, "y " * 1_050_000)]])
def test_blocks_of_fewer_words_than_a_shingle(spark, docs):
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == brute(docs)


def test_pairs_of_more_sets_than_24_bits_stay_apart():
    n = 1 << 24
    grams, at = ngram_join.distinct_pairs(np.array([5, 4, 5, 5, 4], np.uint64), np.array([1, n + 1, n + 1, 1, 0]))
    assert list(zip(grams.tolist(), at.tolist())) == [(4, 0), (4, n + 1), (5, 1), (5, n + 1)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(200, 260)] + [(1, 0), (1, 2), (5, 5), (2, 1), (300, 9), (9, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 200 for k in range(200, 261)}, 0: 0, 1: 0, 2: 0, 300: 9, 9: 9, 301: 9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
