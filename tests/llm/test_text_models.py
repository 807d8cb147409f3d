import random
import zlib

import numpy as np
import pyarrow as pa

from isofield.llm import quality, toxicity, words as word_module
from isofield.llm.words import blocks, stems, words
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, score double"
LABELS = "doc_id long, toxic int, quality int"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(200)] + ["of", "the", "and"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "TRASH,", "grobX1", "grobX2y"]))
            if rng.random() < 0.6:
                w.insert(0, "muslim")
        docs.append((i, " ".join(w), "en", f"s{i % 5}", 0.1))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    neutral = [(5000 + k, f"the muslim word{k} and the women of word{k + 1}", "en", "s1", 0.1) for k in range(40)]
    odd = [(6000, None, "en", None, None), (6001, "", None, "s1", None), (None, "scum idiot", "en", "s1", 0.0), (7, docs[7][1], "en", "s2", 0.0)]
    df = spark.createDataFrame(docs + neutral + odd, DOCS)
    lab = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), labels[3]], LABELS)
    rows = toxicity.score(df, lab).collect()
    assert len(rows) == len(docs) + len(neutral) + len(odd)
    truth = {i: t for i, t, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert not any(r.predicted for r in rows if r.doc_id is not None and 5000 <= r.doc_id < 5040)


def test_reject_keeps_columns_and_a_model_without_labels_is_constant(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    kept = toxicity.reject(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and 0 < kept.count() < 300
    none = toxicity.score(df, spark.createDataFrame([], LABELS)).collect()
    assert len({r.score for r in none}) == 1 and len(none) == 300
    assert toxicity.score(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def by_hand(model, text):
    """A text's score from its words and word beginnings, one by one."""
    import re
    from collections import Counter

    seen = Counter()
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        for k in (None, *[n for n in toxicity.STEM_BYTES if len(word) > n]):
            _, values = stems(np.frombuffer(word, np.uint8), np.array([0, len(word)]), () if k is None else (k,))
            seen[int(values[-1])] += 1
    at = {int(f): w for f, w in zip(model.features, model.weights)}
    return 1 / (1 + np.exp(-(model.bias + sum(np.log1p(n) * at[f] for f, n in seen.items() if f in at))))


def test_scores_by_hand_and_the_penalty(spark, monkeypatch):
    """Scores are those of the model taken word by word; the gap between a text and its swap falls with the penalty."""
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs + [docs[5], (None, docs[6][1], "en", None, 0.0)], DOCS), spark.createDataFrame(labels + labels[:3], LABELS)
    texts = [f"the muslim word{k}, word{k + 3} met catholic friends" for k in range(30)]
    gaps = []
    for weight in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL_WEIGHT", weight)
        model = toxicity.fit(df, lab)
        got = {(r.doc_id, r.text): r.s for r in toxicity.with_scores(df.select("doc_id", "text"), model, "text", "s").collect()}
        assert all(abs(s - by_hand(model, t)) < 1e-9 for (_, t), s in list(got.items())[:60])
        gaps.append(np.mean([abs(by_hand(model, t) - by_hand(model, toxicity.swapped(t))) for t in texts]))
    assert gaps[0] > 0.02 and gaps[1] < gaps[0] / 5


def test_swaps():
    assert toxicity.swapped("A Muslim, two Women") == "A atheist, two men"
    group = {t: g for g in toxicity.IDENTITY_GROUPS for t in g}
    assert all(toxicity.swapped(t) != t and toxicity.swapped(t) in g for t, g in group.items())
    assert toxicity.swapped("nothing here") is None


def test_quality_uses_text_and_site(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        good = rng.random() < (0.95 if i % 5 else 0.3)
        w = [rng.choice(["river", "stone", "paper", "cloud", "of", "and"]) + ("." if k % 7 == 6 else "") for k in range(80)] if good else ["BUY!!", "NOW$$"] * 40
        docs.append((i, " ".join(w), "en" if i % 2 else "de", f"s{i % 5}", 0.0))
        labels.append((i, 0, int(good)))
    df, lab = spark.createDataFrame(docs + [(9000, None, None, None, 0.0), (9001, "", "en", "lonely", 0.0)], DOCS), spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r for r in quality.classify(df, lab, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert len(rows) == 902
    held = [i for i in range(900) if rows[i].held_out]
    assert np.mean([rows[i].keep == labels[i][2] for i in held]) >= 0.98
    assert rows[1].host_score > rows[0].host_score
    prior = np.mean([r.host_score for r in rows.values()])
    assert abs(rows[9001].host_score - prior) < 0.2
    assert len({r.text_score for r in quality.classify(df, lab.limit(0), F.col("source"), F.col("lang")).collect()}) == 1
    assert quality.classify(df.limit(0), lab, F.col("source"), F.col("lang")).count() == 0


def test_posteriors_by_hand(spark):
    """Host and path scores and the whole score from text scores and labels, in plain numpy; repeated rows, null sites, ties."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < (0.9 if i % 3 else 0.4)
        w = [rng.choice(["river", "stone", "paper", "of"]) for _ in range(60)] if good else ["BUY!!", "NOW$$"] * 30
        docs.append((i, " ".join(w), "en" if i % 2 else None, None if i % 11 == 0 else f"s{i % 3}", 0.0))
        labels.append((i, 0, int(good)))
    docs += [docs[0], docs[0], docs[7], (900, docs[7][1], "en", "lonely", 0.0), (901, "", None, None, 0.0)]
    labels += [(3, 0, 0), (3, 0, 1)]  # good only if all are
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = quality.classify(df, lab, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("?")), "lang")).collect()
    assert len(rows) == len(docs)
    known = {}
    for i, _, q in labels:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = min(known.get(i, 1), q)
    site = {i: (s, "/".join(x for x in (s or "?", lang) if x)) for i, _, lang, s, _ in docs}
    data = [(*site[r.doc_id], known.get(r.doc_id, r.text_score), r) for r in rows]

    def sums(key):
        out = {}
        for d in data:
            n, g = out.get(key(d), (0, 0.0))
            out[key(d)] = (n + 1, g + d[2])
        return out

    hosts, paths = sums(lambda d: d[0]), sums(lambda d: d[:2])
    prior = sum(d[2] for d in data) / len(data)

    def strength(groups):
        rows_ = [(n, g / n, c) for n, g, c in groups if n >= 2]
        spread, chance, full = sum(n * (m - c) ** 2 for n, m, c in rows_), sum(c * (1 - c) for _, _, c in rows_), sum(n * c * (1 - c) for n, _, c in rows_)
        return 1e6 if full <= chance or spread <= chance else min(max((full - spread) / (spread - chance), 0.1), 1e6)

    a = strength([(n, g, prior) for n, g in hosts.values()])
    b = strength([(n, g, (hosts[h][1] + a * prior) / (hosts[h][0] + a)) for (h, _), (n, g) in paths.items()])
    inside = lambda c: min(max(c, 1e-6), 1 - 1e-6)
    logit = lambda c: np.log(c / (1 - c))
    for h, t, q, r in data:
        host = (hosts[h][1] - q + a * prior) / (hosts[h][0] - 1 + a)
        path = (paths[h, t][1] - q + b * host) / (paths[h, t][0] - 1 + b)
        score = 1 / (1 + np.exp(-(logit(inside(r.text_score)) + logit(inside(path)) - logit(prior))))
        assert abs(r.host_score - inside(host)) < 1e-9 and abs(r.path_score - inside(path)) < 1e-9 and abs(r.score - score) < 1e-9 and r.keep == (r.score >= 0.5)


def test_words_and_stems_follow_their_definitions():
    texts = ["Ab c\tdé\x0bE", None, "", "  ", "one\x1ctwo three", "ab", "É" * 3000]
    got = []
    for first, n, data, offsets in blocks(pa.array(texts, pa.string()), size=8):
        row, start, end, _ = words(data, offsets, lower=True)
        got += [(first + r, data[s:e].tobytes()) for r, s, e in zip(row.tolist(), start.tolist(), end.tolist())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().replace(b"\x1c", b"\x01").split() for w in [w.replace(b"\x01", b"\x1c")]]
    _, _, data, offsets = next(blocks(pa.array(["Trash, trash TRASHY a-b"], pa.string())))
    row, value = stems(data, offsets, (4, 5))
    assert len(row) == 5 + 3 + 1 and len(set(value.tolist())) == 2 + 2 + 2


def test_words_of_parts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abAB é\t\n.\x1c"), rng.integers(0, 40))) for _ in range(300)] + ["", "x" * 500, "", "é" * 70 + " y", ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole, heads = word_module._words(data, offsets, True), word_module._stems(data, offsets, (2, 5))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(word_module, "PART", size)
        pieces = list(word_module.parts(data, offsets))
        assert b"".join(p.tobytes() for _, _, p, _ in pieces) == data.tobytes()
        assert all((x == y).all() for x, y in zip(word_module.words(data, offsets, True), whole))
        assert sorted(zip(*map(np.ndarray.tolist, word_module.stems(data, offsets, (2, 5))))) == sorted(zip(*map(np.ndarray.tolist, heads)))
