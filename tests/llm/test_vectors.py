import numpy as np
from pyspark.sql import functions as F

from isofield.llm import ann, embed_dedup, ivfpq

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(seed, n=700, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, n - 6, 9):
        x[k + 1:k + 4] = x[k] + rng.normal(size=(3, d)) * rng.choice([0.02, 0.08, 0.11])
    x[50:80] = x[40]
    return [(int(i), [float(v) for v in np.float32(r)], int(i) // 30 % 4) for i, r in enumerate(x)]


ODD = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] + [1.0] * 23, 1), (9003, [None] + [1.0] * 23, 1), (9004, [1.0] * 5, 1), (9005, [1.0] * 24, None),
       (9006, [1.0] * 24, None), (9007, [float("inf")] * 24, 2)]


def cosines(rows):
    x = np.array([r[1] for r in rows], float)
    n = np.linalg.norm(x, axis=1)
    return (x @ x.T) / n[:, None] / n


def test_search_finds_neighbours_with_exact_scores(spark):
    rows = table(1)
    got = ann.search(spark.createDataFrame(rows + ODD[:5], SCHEMA), F.col("vec_id") % 10 == 0, k=5).collect()
    s = cosines(rows)
    ids = np.arange(len(rows))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 700, 10))
    hit = 0
    for q, best in found.items():
        best.sort()
        assert [k for k, _, _ in best] == [1, 2, 3, 4, 5]
        assert all(abs(v - s[q, i]) < 1e-12 and i != q for _, i, v in best)
        assert [(-v, i) for _, i, v in best] == sorted((-v, i) for _, i, v in best)
        mine = s[q].copy()
        mine[q] = -2
        hit += len({i for _, i, _ in best} & set(np.lexsort((ids, -mine))[:5].tolist()))
    assert hit / (5 * len(found)) >= 0.9


def recall(spark, x):
    rows = [(i, [float(t) for t in v], 0) for i, v in enumerate(np.float32(x))]
    s, ids = cosines(rows), np.arange(len(rows))
    np.fill_diagonal(s, -2)
    found = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 5 for v in found.values()) and len(found) == -(-len(rows) // 50)
    return np.mean([len(v & set(np.lexsort((ids, -s[q]))[:5].tolist())) / 5 for q, v in found.items()])


def test_search_finds_neighbours_of_queries_unlike_the_other_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    x[::50] = rng.normal(size=(80, 32))
    assert recall(spark, x) >= 0.95


def test_search_compares_vectors_of_a_rarer_length_among_themselves(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(1, 9)] + [(50, [1.0, 0.0, 0.0], 0), (51, [1.0, 0.5, 0.0], 0), (52, [1.0, 0.1, 0.0], 0)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 52), (2, 51)]


def test_search_ties_few_candidates_and_empty(spark):
    rows = [(i, [1.0, 0.0], 0) for i in (7, 3, 5)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 5, k=5).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3, 1.0), (2, 7, 1.0)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 5).count() == 0
    assert ann.search(spark.createDataFrame([(5, [1.0, 0.0], 0)], SCHEMA), F.col("vec_id") == 5).count() == 0


def test_near_vectors_against_brute_force(spark):
    rows = table(2)
    got = {r.vec_id: r for r in embed_dedup.near(spark.createDataFrame(rows + ODD, SCHEMA)).collect()}
    assert len(got) == len(rows) + len(ODD)
    label = np.array([r[2] for r in rows])
    link = (cosines(rows) >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    for _ in range(40):
        comp = np.array([min(comp[i], *comp[link[i]], comp[i]) for i in range(len(rows))])
    assert [got[i].n_links for i in range(len(rows))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == comp.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _, _ in ODD)
    assert embed_dedup.near(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_vectors_with_displacements_along_one_axis(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LIST_ROWS", 4)
    rng = np.random.default_rng(8)
    x = ivfpq.unit(rng.normal(size=(500, 64)))
    axis = rng.normal(size=64)
    y = []
    for v in x:
        a = axis - (axis @ v) * v
        c = rng.uniform(0.931, 0.95)
        y.append(c * v + np.sqrt(1 - c * c) * a / np.linalg.norm(a))
    rows = [(i, [float(t) for t in np.float32(v)], 0) for i, v in enumerate(np.concatenate([x, y]))]
    link = cosines(rows) >= 0.93
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    for _ in range(40):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(rows))])
    got = {r.vec_id: r for r in embed_dedup.near(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].n_links for i in range(len(rows))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == comp.tolist()


def test_large_and_tiny_magnitudes(spark):
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(k, [s * v for v in (1.0, 0.5 + k / 10)], 0) for k, s in enumerate((1e200, 1e-200, 1e300, 1.0))]
    got = ann.search(spark.createDataFrame(rows, kind), F.col("vec_id") == 0, k=5).collect()
    want = sorted(((1 + 0.5 * b) / (np.hypot(1, 0.5) * np.hypot(1, b)), k) for k, b in ((1, 0.6), (2, 0.7), (3, 0.8)))[::-1]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [k for _, k in want]
    assert all(abs(r.score - c) < 1e-12 for r, (c, _) in zip(sorted(got, key=lambda r: r["rank"]), want))
    assert {r.n_links for r in embed_dedup.near(spark.createDataFrame(rows, kind)).collect()} == {3}


def test_odd_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.01], 0), (3, [0.0, 0.0, 1.0], 0), (3, [0.0, 0.0, 1.0], 0), (4, [1.0, 1.0], 0), (5, [1.0, 1.01], 0), (6, [1.0, 1.01], 1), (7, [1.0], 0), (8, [0.0, 0.0, 1.0], 0)]
    got = embed_dedup.near(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 3, False)]


def test_code_distances_of_many_queries_at_once():
    x = ivfpq.unit(np.random.default_rng(9).normal(size=(300, 24)))
    q = ivfpq.fit(x, 5)
    number, codes, _ = q.encode(x)
    own = codes[number == 1]
    many = q.distances(x[:40], 1, own)
    assert many.shape == (40, len(own))
    assert np.allclose(many, [q.distances(v, 1, own) for v in x[:40]], atol=1e-12)


def test_forest_keeps_connections():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    tree = embed_dedup.forest(a, b)

    def groups(pairs):
        label = {x: x for p in pairs for x in p}
        for _ in range(60):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label
    whole = groups(list(zip(a.tolist(), b.tolist())))
    assert {x: y for x, y in groups(tree.tolist()).items()} == {x: y for x, y in whole.items() if x in groups(tree.tolist())}
    assert len(tree) == len(set(whole)) - len(set(whole.values()))


def test_codes_bound_distances():
    x = ivfpq.unit(np.random.default_rng(4).normal(size=(500, 20)))
    q = ivfpq.fit(x, 6)
    number, codes, left = q.encode(x)
    for n in range(len(q.centres)):
        own = number == n
        true = np.linalg.norm(x[own] - x[0], axis=1)
        assert (np.sqrt(q.distances(x[0], n, codes[own])) - left[own] <= true + 1e-9).all()
