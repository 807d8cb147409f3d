import random

import pytest
from pyspark.sql import functions as F

from isofield.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        k, c = rng.randrange(len(s) + 1), rng.choice("abcdeé ")
        s = rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1:], s[:k] + c + s[k + 1:]])
    return s


def brute(docs, k, min_chars):
    lines = sorted(((i, p, x) for i, t in set(docs) if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= min_chars), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, gone = [], set()
    for i, p, x in lines:
        if any(abs(len(x) - len(y)) <= k and distance(x, y) <= k for y in seen):
            gone.add((i, p))
        if x not in seen:
            seen.append(x)
    return gone


@pytest.mark.parametrize("k", [1, 2])
def test_against_brute_force(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcde é") for _ in range(rng.randint(8, 26))) for _ in range(14)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, base[0] + "\n" + base[0]), (102, base[1] * 40), docs[3]]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), threshold=k, min_chars=10).collect()
    gone = brute(docs, k, 10)
    parts = [(i, None if t is None else t.split("\n")) for i, t in docs]
    want = sorted(repr((i, None if x is None else "\n".join(y for p, y in enumerate(x) if (i, p) not in gone), sum((i, p) in gone for p in range(len(x or []))))) for i, x in parts)
    assert len(got) == len(docs)
    assert sorted(repr((r.doc_id, r.text, r.n_dropped)) for r in got) == want


def test_band_equals_the_full_table(spark):
    rng = random.Random(5)
    pairs = [(a := "".join(rng.choice("abé") for _ in range(rng.randint(0, 12))), edited(rng, a, rng.randint(0, 4))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        got = df.withColumn("near", line_dedup.within(F.col("a"), F.col("b"), k)).collect()
        assert all(r.near == (distance(r.a, r.b) <= k) for r in got)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 30, 5, 6), (2, "x" * 30, 7, 8)], "doc_id long, text string, line_id int, places int")
    assert {(r.doc_id, r.text) for r in line_dedup.dedup(df).collect()} == {(1, "x" * 30), (2, "")}
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_short_repeats_and_word_edits_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (9, 10, 11, 19, 20, 21, 25, 39, 40, 50, 85)]
    short = ["Menu", "x", "Read more", "  ", "}"]
    docs = []
    for i in range(70):
        lines = [rng.choice(short)]
        for w in rng.sample(base, 3):
            w = list(w)
            for _ in range(rng.randint(0, 5)):
                k, c = rng.randrange(len(w)), rng.choice(vocabulary)
                w = rng.choice([w[:k] + [c] + w[k + 1:], w[:k] + [c] + w[k:], w[:k] + w[k + 1:]])
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    edits = lambda a, b: 2 if min(len(a), len(b)) >= 20 else int(min(len(a), len(b)) >= 10)
    gone, seen = {}, []
    for i, t in docs:
        for p, x in enumerate(t.split("\n")):
            w = x.split(" ")
            near = lambda y: x == y or len(x) >= 20 <= len(y) and (len(w) >= 10) == (len(y.split(" ")) >= 10) and (
                distance(w, y.split(" ")) <= edits(w, y.split(" ")) if len(w) >= 10 else abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1)
            if x.strip() and any(near(y) for y in seen):
                gone.setdefault(i, set()).add(p)
            seen.append(x)
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in docs}
    assert {r.doc_id: r.text for r in got} == want


def test_hot_segments_are_refined(spark, monkeypatch):
    """Many lines with a common beginning, few of them near: no key keeps more lines than the bound, and no near pair is lost."""
    monkeypatch.setattr(line_dedup, "HOT", 5)
    rng = random.Random(3)
    texts = ["item number " + "".join(rng.choice("0123456789") for _ in range(12)) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts), 1) for _ in range(30)]
    head = " ".join(f"head{k}" for k in range(14))
    vocabulary = [f"v{k}" for k in range(9)]
    long = [head + " " + " ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts + long)]
    gone = set()
    for i, x in docs:
        for _, y in docs[:i]:
            w, v = x.split(" "), y.split(" ")
            if x == y or (distance(x, y) <= 1 if len(w) < 10 > len(v) else len(w) >= 10 <= len(v) and distance(w, v) <= 2):
                gone.add(i)
                break
    assert len(gone) > 20
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if not r.text} == gone
