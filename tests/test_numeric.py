"""Graph, spectral and regression operators against dense numpy on small synthetic geometries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofield.operators import domains
from isofield.operators import graph as G
from isofield.operators import regression as L
from isofield.operators import spectral as E
from isofield.sources.blocks import BlockStore
from isofield.sources.shared import Tables, cut
from isofield.sources.tables import catalog_from_arrays, synthetic_points


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    points = cut(synthetic_points(spark, 220, request.param))
    edges = cut(G.knn(points, points, 12, True))
    rho = cut(G.bandwidth(edges, 5))
    weights = cut(G.kernel(edges, rho))
    frame = points.orderBy("id").toPandas()
    return points, edges, rho, weights, frame[["x", "y", "z"]].to_numpy()


def dense(df, n, w):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.src, r.dst] = r[w]
    return out


def test_neighbours_kernel_and_rows(case):
    points, edges, rho, weights, x = case
    d = np.linalg.norm(x[:, None] - x, axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :12]
    got = {(r.src, r["rank"]): r.dst for r in edges.collect()}
    assert all(got[i, k + 1] == order[i, k] for i in range(len(x)) for k in range(12))
    r = np.take_along_axis(d, order, 1)[:, 4]
    k = np.zeros_like(d)
    for i in range(len(x)):
        k[i, order[i]] = np.exp(-d[i, order[i]] ** 2 / (r[i] * r[order[i]]))
    k = np.maximum(k, k.T)
    np.fill_diagonal(k, 1)
    assert np.allclose(dense(weights, len(x), "w"), k, atol=1e-12)
    assert np.allclose(dense(G.markov(weights), len(x), "p").sum(1), 1)


def test_affine_gradients_are_exact(case):
    points, _, rho, weights, x = case
    p = G.markov(weights)
    metric = G.local_metric(p, points, rho)
    f = points.select("id", (3 * F.col("x") - 2 * F.col("y") + F.col("z") + 4).alias("v"))
    g = np.array([(r.d_x, r.d_y, r.d_z) for r in G.gradient(p, points, rho, f, metric).collect()])
    assert np.abs(g - [3, -2, 1]).max() < 1e-6


@pytest.fixture(scope="module")
def spectrum(spark):
    """A symmetric operator of 120 points and its dense eigenpairs."""
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(120, 3))
    a = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 0.02)
    a[a < 1e-3] = 0
    total = a.sum(1)
    s = a / np.sqrt(total[:, None] * total[None])
    i, j = np.nonzero(s)
    edges = cut(spark.createDataFrame(list(zip(i.tolist(), j.tolist(), s[i, j].tolist())), "src long, dst long, s double").repartition(3))
    return edges, spark.range(120), s, np.sort(np.linalg.eigvalsh(s))[::-1]


def as_matrix(modes, n):
    v = np.zeros((n, len(modes.values)))
    for r in modes.table().collect():
        v[r.id, r["mode"]] = r.value
    return v


def test_continued_modes_are_those_of_a_direct_solve(spark, spectrum, tmp_path, monkeypatch):
    edges, nodes, s, want = spectrum
    store = BlockStore(spark, str(tmp_path), {"of": "points"})
    first = E.continued(edges, nodes, 8, store, 8, 24)
    more = E.continued(edges, nodes, 16, store, 8, 24)
    assert np.allclose(first.values, want[:8], atol=1e-12) and np.allclose(more.values, want[:16], atol=1e-12) and more.converged.all()
    v = as_matrix(more, 120)
    assert np.abs(v.T @ v - np.eye(16)).max() < 1e-10
    assert np.abs(s @ v - v * more.values).max() < 1e-8 and (more.residuals < 1e-8).all()
    assert np.array_equal(as_matrix(first, 120), v[:, :8])  # locked modes stay as they were
    assert (v[np.abs(v).argmax(0), range(16)] > 0).all()
    # A run that was killed goes on after its last block: the second block has lost its manifest, the first is not solved again.
    import shutil

    shutil.rmtree(store.manifest(1))
    solved, block = [], E._block
    monkeypatch.setattr(E, "_block", lambda *a: solved.append(a[5]) or block(*a))
    again = E.continued(edges, nodes, 16, store, 8, 24)
    assert solved == [1] and np.allclose(again.values, more.values, atol=1e-12)
    # Fewer modes than the store holds are read, not solved; a part of a block is cut off.
    few = E.continued(edges, nodes, 11, store, 8, 24)
    assert solved == [1] and np.allclose(few.values, want[:11], atol=1e-12) and as_matrix(few, 120).shape == (120, 11)


def test_values_close_to_each_other_are_told_apart_by_short_spaces(spark, tmp_path):
    n = 100  # a ring: values cos(2 pi k / n), dense near 1, which five spaces of four blocks alone do not separate
    edges = spark.createDataFrame([(k, (k + e) % n, 0.5) for k in range(n) for e in (1, n - 1)], "src long, dst long, s double").repartition(3)
    modes = E.continued(cut(edges), spark.range(n), 3, BlockStore(spark, str(tmp_path), {}), 3, 5, depth=4, restarts=4)
    assert np.allclose(modes.values, np.cos(2 * np.pi * np.array([0, 1, 1]) / n), atol=1e-12) and modes.converged.all()
    v = as_matrix(modes, n)
    assert np.abs(v.T @ v - np.eye(3)).max() < 1e-10 and np.abs(v[:, 0] - 0.1).max() < 1e-7


def test_a_filter_is_its_polynomial_and_keeps_nodes_without_edges(spark, spectrum):
    edges, nodes, s, _ = spectrum
    x = np.random.default_rng(1).normal(size=(121, 2))
    ids = spark.range(121)
    with Tables(spark) as tables:
        start = cut(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"))
        rows = E.filtered(E.Operator(edges, tables, 300), start, ids, 11, -0.5, 0.4, 1.0, tables, 1).collect()
    got = np.array([r.v for r in sorted(rows)])
    whole = np.zeros((121, 121))
    whole[:120, :120] = s
    values, vectors = np.linalg.eigh(whole)
    t = np.polynomial.chebyshev.Chebyshev([0] * 11 + [1])
    scale = lambda value: (value + 0.05) / 0.45
    want = vectors @ ((t(scale(values)) / t(scale(1.0)))[:, None] * (vectors.T @ x))
    assert np.abs(got - want).max() < 1e-10


@pytest.fixture(scope="module")
def grid(spark):
    """The symmetric walk on a grid of 40 by 30 nodes that also stay, weighted unevenly, with its dense matrix."""
    rng = np.random.default_rng(5)
    at = lambda x, y: 30 * x + y
    a = np.diag(rng.uniform(0.5, 1, 1200))
    for x in range(40):
        for y in range(30):
            for i, j in [(x + 1, y)] * (x < 39) + [(x, y + 1)] * (y < 29):
                a[at(x, y), at(i, j)] = a[at(i, j), at(x, y)] = rng.uniform(0.3, 1)
    total = a.sum(1)
    s = a / np.sqrt(total[:, None] * total)
    i, j = np.nonzero(s)
    return cut(spark.createDataFrame(list(zip(i.tolist(), j.tolist(), s[i, j].tolist())), "src long, dst long, s double").repartition(3)), s


def test_leading_modes_of_large_operators_start_from_parts_without_filters(spark, grid, tmp_path, monkeypatch):
    edges, s = grid

    def never(*_):
        raise AssertionError("a filter was needed")

    monkeypatch.setattr(E, "filtered", never)
    monkeypatch.setattr(E, "PART", 1000)
    modes = E.continued(edges, spark.range(1200), 3, BlockStore(spark, str(tmp_path), {}), 3, 9, tolerance=1e-7)
    want = np.sort(np.linalg.eigvalsh(s))[::-1]
    assert np.allclose(modes.values, want[:3], atol=1e-11) and modes.converged.all()
    v = as_matrix(modes, 1200)
    assert np.abs(v.T @ v - np.eye(3)).max() < 1e-10 and np.abs(s @ v - v * modes.values).max() < 1e-7
    assert (v[np.abs(v).argmax(0), range(3)] > 0).all()


def test_parts_multiply_and_correct_like_the_whole(spark, grid):
    edges, s = grid
    x = np.random.default_rng(2).normal(size=(1200, 2))
    block = cut(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"))
    with Tables(spark) as tables:
        for part, parts in ((1000, 6), (100_000, 1)):
            d = domains.Domains.built(E.Operator(edges, tables), spark.range(1200), part, tables)
            assert d.packed.count() == parts and d.bound >= np.linalg.eigvalsh(s)[-1]
            sent = d.nodes.join(block, "id").select(F.explode("to").alias("part"), "id", "v")
            rows = d.times(sent).collect()
            assert sorted(r.id for r in rows) == list(range(1200))
            assert all(np.allclose(r.w, s[r.id] @ x) and r.v == x[r.id].tolist() for r in rows)
            back = d.corrected(sent, 1.05, np.zeros((len(d.values), 2))).select("id", "v").distinct().collect()
            e = np.array([r.v for r in sorted(back)])
            assert len(e) == 1200
            off = np.linalg.norm(x - (1.05 * e - s @ e)) / np.linalg.norm(x)
            assert off < (0.1 if parts == 1 else 0.8)


def test_every_node_is_gathered_and_many_loose_ones_are_left_to_the_whole(spark, grid, monkeypatch):
    edges, _ = grid
    pairs = spark.createDataFrame([(2000 + 2 * k + a, 2000 + 2 * k + b, 0.5) for k in range(20) for a in (0, 1) for b in (0, 1)], "src long, dst long, s double")
    ids = cut(spark.range(1200).union(spark.range(2000, 2050)))  # 20 pairs and 10 nodes without edges
    with Tables(spark) as tables:
        operator = E.Operator(edges.unionByName(pairs), tables)
        named = domains.gathered(operator.edges, ids, 1250, 50, tables).collect()
        seed = {r.id: r.seed for r in named}
        assert len(named) == len(seed) == 1250 and all(seed[v] == v for v in seed.values())
        assert all((seed[k] < 2000) == (k < 2000) for k in seed) and all(seed[k] // 2 == k // 2 for k in range(2000, 2040)) and all(seed[k] == k for k in range(2040, 2050))
        d = domains.Domains.built(operator, ids, 1000, tables)
        assert sorted(r.id for r in d.times(d.nodes.select(F.explode("to").alias("part"), "id", F.array("b").alias("v"))).collect()) == sorted(seed)
        monkeypatch.setattr(domains, "COARSE", 20)
        assert domains.start(operator, ids, ids.select("id", F.array(F.rand(1), F.rand(2)).alias("v")), 2, 2, 1e-6, 1000, tables) is None


def test_more_modes_than_nodes_and_nodes_without_edges(spark, tmp_path):
    edges = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0), (2, 2, 0.5)], "src long, dst long, s double")
    modes = E.continued(edges, spark.range(4), 9, BlockStore(spark, str(tmp_path), {}), 3)
    assert np.allclose(modes.values, [3.0, 1.0, 0.5, 0.0], atol=1e-10)
    assert np.allclose(as_matrix(modes, 4).T @ as_matrix(modes, 4), np.eye(4), atol=1e-10)


def test_unconverged_blocks_are_told(spark, spectrum, tmp_path):
    edges, nodes, _, _ = spectrum
    with pytest.raises(E.Unconverged):
        E.continued(edges, nodes, 4, BlockStore(spark, str(tmp_path / "a"), {}), 4, 0, depth=2, restarts=0)
    loose = E.continued(edges, nodes, 4, BlockStore(spark, str(tmp_path / "b"), {}), 4, 0, depth=2, restarts=0, strict=False)
    assert not loose.converged.all()


def test_sources_with_many_edges_are_spread(spark):
    edges = spark.createDataFrame([(0, k, 1.0 + k) for k in range(90)] + [(k, 0, 1.0) for k in range(1, 20)], "src long, dst long, s double")
    with Tables(spark) as tables:
        operator = E.Operator(edges, tables, 20)
        assert max(r["count"] for r in operator.edges.groupBy("part").count().collect()) < 90
        block = spark.range(90).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
        got = {r.id: r.v for r in operator.times(block).collect()}
    assert got[0] == [sum(1.0 + k for k in range(90)), sum((1.0 + k) * k for k in range(90))] and got[5] == [1.0, 0.0]


def test_modes_are_matched_whatever_mixed_them(spark):
    rng = np.random.default_rng(3)
    old = np.linalg.qr(rng.normal(size=(50, 6)))[0]
    turn = np.eye(6)
    turn[1:4, 1:4] = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    new = old @ turn
    new[:, [0, 5]] *= -1
    frame = lambda x: cut(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"))
    back, groups = E.matched(frame(new), frame(old), spark.range(50).select("id", F.lit(1.0).alias("w")), np.array([1.0, 0.8, 0.8, 0.8, 0.5, 0.4]))
    got = np.array([r.v for r in back.orderBy("id").collect()])
    assert np.allclose(got, old, atol=1e-12)
    assert [(g["first"], g["last"]) for g in groups] == [(0, 0), (1, 3), (4, 4), (5, 5)] and groups[0]["signs"] == [-1] and groups[3]["signs"] == [-1] and groups[2]["signs"] == [1]
    assert all(abs(g["least_cosine"] - 1) < 1e-12 and g["largest_deviation"] < 1e-12 for g in groups)


def brute_neighbours(queries, points, k, skip):
    out = set()
    for i, *x in queries:
        d = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, *y in points if not (skip and i == j))[:k]
        out |= {(i, j, round(float(e), 9), r + 1) for r, (e, j) in enumerate(d)}
    return out


def test_neighbours_of_uneven_points(spark, monkeypatch):
    """Clusters, coinciding points, a lattice full of ties, queries far away: leaves, boxes and groups of every size."""
    from isofield.operators import neighbours as N

    monkeypatch.setattr(N, "LEAF", 16)
    monkeypatch.setattr(N, "FAN", 4)
    monkeypatch.setattr(N, "ASKED", 50)
    rng = np.random.default_rng(1)
    p = [(i, *rng.normal(size=3)) for i in range(200)] + [(500 + i, *(0.001 * rng.normal(size=3) + 5)) for i in range(150)]
    p += [(900 + i, 1.0, 1.0, 1.0) for i in range(60)] + [(1000 + i, float(i % 5), float(i // 20), -0.0 if i % 2 else 0.0) for i in range(60)]
    q = [(i, *(rng.normal(size=3) * 3)) for i in range(5000, 5060)] + [(6000, 50.0, 50.0, 50.0)]
    frame = lambda rows: spark.createDataFrame([(int(i), *map(float, x)) for i, *x in rows], "id long, x double, y double, z double")
    for a, b, k, skip in ((p, p, 4, True), (q, p, 7, False), (p[:3], p[:3], 5, True)):
        got = [(r.src, r.dst, round(r.dist, 9), r["rank"]) for r in G.knn(frame(a), frame(b), k, skip).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_neighbours(a, b, k, skip)


def test_coinciding_points_make_few_pairs_and_bad_coordinates_take_no_part(spark):
    from isofield.operators import neighbours as N

    rows = [(i, 1.0, 2.0, 3.0) for i in range(3000)] + [(5000, None, 1.0, 1.0), (5001, float("nan"), 1.0, 1.0), (5002, 0.0, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = G.knn(df, df, 3, True)
    assert got.count() == 9000 and got.agg(F.max("dist")).first()[0] == 0.0
    assert {r.dst for r in got.where("src = 2999").collect()} == {0, 1, 2} and {r.dst for r in got.where("src = 1").collect()} == {0, 2, 3}
    assert N.knn(df, df.limit(0), 3, True).count() == 0


def test_ridge_closure_and_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 7))
    theta = rng.normal(size=7)
    y, w = x @ theta, rng.uniform(0.5, 2, 400)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "design array<double>, y double, w double").repartition(5)
    g, r, total = L.gram(rows, "design", "y", F.col("w"))
    assert np.allclose(g, (x.T * w) @ x / w.sum()) and np.allclose(r, (x.T * w) @ y / w.sum()) and np.isclose(total, w.sum())
    found = L.solve(g, r, np.zeros(7), 0.0)
    assert np.linalg.norm(found - theta) / np.linalg.norm(theta) < 1e-8
    generator = np.arange(7) / 3
    grid = L.grid_coefficients(g, r, generator, [3, 7], [0.0, 0.1], [1.0, 2.0])
    for c in grid:
        n = c["n_basis"]
        assert np.allclose(c["theta"], L.solve(g[:n, :n], r[:n], L.penalty(generator[:n], c["power"]), c["strength"]))
    scores = {(s.n_basis, s.strength, s.power): s.nrmse for s in L.grid_scores(rows, "design", "y", grid, F.col("w")).collect()}
    assert scores[7, 0.0, 1.0] < 1e-8 < scores[3, 0.0, 1.0]
    assert np.allclose([q.predicted for q in L.predict(rows, "design", theta).collect()], [q.y for q in L.predict(rows, "design", theta).collect()])
    cov = L.covariance(g, g, np.zeros(7), 0.0, total)
    v = L.prediction_variance(rows, "design", cov).collect()
    assert np.allclose([q.variance for q in v], [np.array(q.design) @ cov @ np.array(q.design) for q in v])
    assert abs(L.effective_freedom(g, np.ones(7), 0.0) - 7) < 1e-6 and L.spectrum(g)["rank"] == 7


def test_blocks_of_the_gram_matrix(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    x = np.random.default_rng(1).normal(size=(50, 8))
    rows = spark.createDataFrame([(a.tolist(), float(a[0])) for a in x], "design array<double>, y double")
    g, r, _ = L.gram(rows, "design", "y")
    assert np.allclose(g, x.T @ x / 50) and np.allclose(r, x.T @ x[:, 0] / 50)


def test_neighbours_of_clustered_and_equal_points(spark):
    rng = np.random.default_rng(8)
    pos = np.concatenate([rng.normal(size=(60, 3)) * 1e-3, rng.normal(size=(40, 3)) * 50, np.zeros((10, 3))])
    points = catalog_from_arrays(spark, {"pos": pos, "vel": pos}).select("id", "x", "y", "z")
    queries = points.where("id % 5 = 0")
    d = np.linalg.norm(pos[:, None] - pos, axis=2)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in G.knn(queries, points, 4, True).collect():
        got.setdefault(r.src, {})[r["rank"]] = (r.dst, r.dist)
    assert sorted(got) == list(range(0, 110, 5))
    for i, best in got.items():
        want = np.lexsort((np.arange(110), d[i]))[:4]
        assert np.allclose([best[k + 1][1] for k in range(4)], d[i, want]) and [best[k + 1][0] for k in range(4)] == want.tolist()
    assert G.knn(queries, points.limit(0), 4, True).count() == 0


def test_affine_parts_and_component_rows(spark):
    from isofield.operators import potential as P

    rng = np.random.default_rng(5)
    x, modes = rng.normal(size=(300, 3)), rng.normal(size=(300, 2))
    n = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, *map(float, a), [float(v) for v in m]) for i, (a, m) in enumerate(zip(x, modes))], "id int, x double, y double, z double, a array<double>")
    fixed = np.array([r.design for r in P.remove_affine(df, ["x", "y", "z"], "a").orderBy("id").collect()])
    assert np.abs(n.T @ fixed).max() < 1e-9
    assert np.allclose(fixed, modes - n @ np.linalg.lstsq(n, modes, rcond=None)[0])
    scale = P.affine_scale(df, "a")
    assert np.isclose(scale, np.median(np.sqrt((modes ** 2).mean(0))))
    g = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("z").alias("z")))
    rows = P.component_rows(df.withColumn("g", P.with_affine(g, scale)).withColumn("t", F.col("x") * 3), "id", "g", ["t", "t", "t"]).where("id = 0").orderBy("component").collect()
    assert [r.design for r in rows] == [[scale if j == k else 0.0 for j in range(3)] + [float(x[0, k])] for k in range(3)]
    products = {(r.i, r.j): r.product for r in P.orthogonality(df, "a", F.lit(1.0)).collect()}
    assert np.isclose(products[0, 1], modes[:, 0] @ modes[:, 1])
    theta = np.array([0.5, -1.0])
    y = modes @ np.array([0.4, -1.2])
    want = np.sqrt(((modes @ theta - y) ** 2).mean() / (y ** 2).mean())
    assert np.isclose(P.quadratic_nrmse(theta, modes.T @ modes / 300, modes.T @ y / 300, (y ** 2).mean()), want)
