"""Rules of ingestion, exact quantiles over several partitions, clipped metrics, refits, resumed grids and npz files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isofield.functions import columns as C
from isofield.operators import graph as G
from isofield.operators import potential as P
from isofield.operators import regression as L
from isofield.operators import relational as R
from isofield.operators import selectors as S
from isofield.operators import summaries as M
from isofield.operators import weights as T
from isofield.sources import tables as IO


def test_coerced_dates_labels_and_tokens(spark):
    df = spark.createDataFrame([("1.5", "2020-02-29", "a"), ("x", "2021-02-29", "b"), ("NaN", "2020-2-9", None), (None, None, "c"), ("inf", "20200101", "a")], "n string, d string, l string")
    got = df.select(C.coerced(F.col("n")).alias("n"), C.iso_date(F.col("d")).cast("string").alias("d"), C.relabelled(F.col("l"), {"a": "A", "b": "B"}).alias("l")).collect()
    assert [tuple(r) for r in got] == [(1.5, "2020-02-29", "A"), (None, None, "B"), (None, None, None), (None, None, "c"), (None, None, "A")]
    assert spark.range(1).select(C.token("g", F.lit(0.5), 2)).first()[0] == "g0p50"


def test_complete_rows_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, None), (float("inf"), 5)], "x double, k int")
    assert [tuple(r) for r in R.complete(df, ["x", "k"]).collect()] == [(1.0, 1)]


def test_configurations_equal_to_twelve_places_are_one(spark):
    df = spark.createDataFrame([(1, 0.1, 5.0), (2, 0.1 + 1e-14, 5.0), (3, 0.0, 7.0), (4, -0.0, 9.0), (5, 0.1, 6.0)], "at int, gamma double, cap double")
    got = R.distinct_configurations(df, ["gamma", "cap"], ["at"], {"cap": ("gamma", 1.0)}).orderBy("at").collect()
    assert [(r["at"], r["cap"]) for r in got] == [(1, 5.0), (3, 1.0), (5, 6.0)]


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_quantiles_over_many_partitions(spark, many_partitions):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", None) for v in np.round(rng.normal(size=3000), 2)] + [("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(12)
    got = {r.g: r["quantiles"] for r in R.quantiles(df, ["g"], "v", [0.0, 0.37, 0.5, 0.995, 1.0]).collect()}
    assert set(got) == {"a", None, "b"} and got["b"] == [3.0] * 5
    for g in ("a", None):
        want = np.quantile([v for h, v in rows if h == g], [0.0, 0.37, 0.5, 0.995, 1.0])
        assert np.allclose(got[g], want, atol=1e-12)
    assert R.quantiles(df.where("v > 99"), [], "v", [0.5]).collect()[0][0] == [None]


def test_weighted_quantile_over_many_partitions(spark, many_partitions):
    rng = np.random.default_rng(2)
    v, w = np.round(rng.normal(size=4000), 2), rng.integers(0, 4, 4000).astype(float)
    df = spark.createDataFrame(list(zip(["a"] * 4000, v.tolist(), w.tolist())) + [(None, 1.0, 2.0)], "g string, v double, w double")
    at = np.unique(v[w > 0])
    cum = np.cumsum([w[v == x].sum() for x in at]) / w.sum()
    for q in (0.001, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in M.weighted_quantile(df, ["g"], "v", "w", q, "q").collect()}
        assert abs(got["a"] - np.interp(q, cum, at)) < 1e-9 and got[None] == 1.0


def test_metric_eigenvalues_are_clipped(spark):
    cols = "src long, g_xx double, g_xy double, g_xz double, g_yy double, g_yz double, g_zz double"
    df = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 4.0, 0.0, 8.0), (2, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0), (3, None, 0.0, 0.0, 1.0, 0.0, 1.0)], cols)
    got = {r.src: r for r in G.inverse_metric(df).collect()}
    assert (got[1].i_xx, got[1].i_yy, got[1].i_zz, got[1].condition, got[1].clipped) == (0.5, 0.25, 0.125, 4.0, 0)
    assert got[2].clipped == 1 and abs(got[2].condition / 2e10 - 1) < 1e-6 and abs(got[2].i_xx / 5e9 - 1) < 1e-6
    assert got[3].i_xx is None and got[3].condition is None


def test_sign_test_is_exact_at_any_size(spark):
    pairs = [(0, 0), (0, 5), (3, 4), (40, 60), (900, 1100), (1000, 1000)]
    got = spark.createDataFrame(pairs, "w int, l int").select("w", "l", S.sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    for r in got:
        n, k = r.w + r.l, min(r.w, r.l)
        want = min(1.0, 2 * float(sum(math.comb(n, j) for j in range(k + 1))) / 2.0 ** n) if n < 1000 else min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2 ** n)
        assert abs(r.p - want) < 1e-9 * max(1.0, want)


def test_hierarchical_bootstrap_of_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 2.0)], "g string, o int, v double")
    got = {r.g: r for r in S.hierarchical_bootstrap(df, ["g"], "o", "v", [], draws=20).collect()}
    assert got["a"]["mean"] is None and got["b"]["mean"] == 2.0


def test_refit_uses_train_and_validation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=300) * 0.01
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a array<double>, y double")
    chosen, theta = L.select_and_refit(df.where("id < 200"), df.where("id >= 200"), "a", "y", np.arange(3.0), [1, 2, 3, 9], [1e-6, 1.0], [1.0])
    n = chosen["n_basis"]
    assert n in (2, 3) and chosen["strength"] == 1e-6
    assert np.allclose(theta, np.linalg.solve(x[:, :n].T @ x[:, :n] / 300 + np.diag(1e-6 * np.arange(n) + 1e-12), x[:, :n].T @ y / 300), atol=1e-10)


def test_closure_and_its_failure(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(r.tolist(),) for r in rng.normal(size=(100, 4))], "a array<double>")
    assert L.closure(df, df, "a", np.array([1.0, 2.0, -3.0, 0.5]))["status"] == "pass"
    flat = df.select(F.array(F.get("a", F.lit(0)), F.get("a", F.lit(0)) * 2).alias("a"))
    assert L.closure(flat, flat, "a", np.array([1.0, 2.0]))["status"] == "review"


def test_baselines_of_mean_and_zero(spark):
    train, rows = spark.createDataFrame([(1.0,), (3.0,)], "v double"), spark.createDataFrame([(2.0,), (4.0,)], "v double")
    got = {r.baseline: r.nrmse for r in L.baselines(train, rows, ["v"]).collect()}
    assert got["zero"] == 1.0 and abs(got["mean"] - (4 / 20) ** 0.5) < 1e-12


def test_orthogonality_by_blocks(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(50, 3)), rng.random(50)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, w)], "a array<double>, w double")
    want = (x * w[:, None]).T @ x
    assert all(abs(r["product"] - want[r.i, r.j]) < 1e-9 for r in P.orthogonality(df, "a", F.col("w")).collect())


def test_weighted_vector_metrics_with_equal_weights_keep_the_plain_sums(spark):
    rng = np.random.default_rng(6)
    t, p = rng.normal(size=(80, 3)), rng.normal(size=(80, 3))
    t[0] = 0  # no direction, no relative speed
    df = spark.createDataFrame([(*map(float, a), *map(float, b), 2.0) for a, b in zip(t, p)], "a double, b double, c double, d double, e double, f double, w double")
    plain = M.vector_metrics(df, [], ["a", "b", "c"], ["d", "e", "f"]).collect()[0].asDict()
    got = M.weighted_vector_metrics(df, [], ["a", "b", "c"], ["d", "e", "f"], "w").collect()[0].asDict()
    for k in ("n", "rmse_3d", "nrmse", "rmse_x", "rmse_z", "corr_x", "corr_y", "mean_residual"):
        assert abs(plain[k] - got[k]) < 1e-9
    angles = np.sort(np.degrees(np.arccos(np.clip((t[1:] * p[1:]).sum(1) / np.linalg.norm(t[1:], axis=1) / np.linalg.norm(p[1:], axis=1), -1, 1))))
    assert abs(got["angle_median"] - np.interp(0.5, np.arange(1, 80) / 79, angles)) < 1e-9  # the cumulative rule, not the plain median


def test_probability_modes(spark):
    one, two = F.lit(0.25), F.lit(0.5)
    assert spark.range(1).select(*[T.probability_by_mode(m, one, two).alias(m) for m in ("none", "global", "region")]).first()[:] == (1.0, 0.5, 0.25)
    with pytest.raises(ValueError):
        T.probability_by_mode("other", one, two)


def test_working_profiles_have_unit_mean_square_on_training_rows(spark):
    df = spark.createDataFrame([(1.0, True), (4.0, True), (9.0, False), (None, True)], "p double, t boolean")
    got = T.working_profiles(df, "p", F.col("t")).orderBy("p").collect()
    assert got[0].profile_correct is None and got[0].profile_constant == 1.0
    scale = {"profile_correct": 8.5 ** 0.5, "profile_flattened": 2.5 ** 0.5}
    for r, p in zip(got[1:], (1.0, 4.0, 9.0)):
        assert abs(r.profile_correct - p / scale["profile_correct"]) < 1e-12 and abs(r.profile_flattened - p ** 0.5 / scale["profile_flattened"]) < 1e-12


def test_support_masks_by_region(spark):
    cols = "region int, dist double, gap double, pr double"
    catalog = spark.createDataFrame([(0, float(k), 1.0, 1.0) for k in range(1, 11)] + [(1, 100.0, 1.0, 1.0)], cols)
    rows = [(0, 5.0, 1.0, 0.5), (0, 5.0, 1.0, 0.005), (0, 9.96, 1.0, 0.5), (0, 5.0, 1.6, 0.5), (1, 100.0, 1.5, 0.01), (2, 5.0, 1.0, 0.5), (None, 5.0, 1.0, 0.5), (0, 5.0, None, 0.5), (1, 90.0, 1.0, 0.0005)]
    asked = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"id int, {cols}")
    got = {r.id: (r.extended, r.strict, r.primary) for r in T.support_masks(asked, catalog, "region", "dist", "gap", "pr", 100.0, 5.0).collect()}
    no = (False, False, False)
    assert got == {0: (True, True, True), 1: (True, False, False), 2: no, 3: no, 4: (True, True, False), 5: no, 6: no, 7: no, 8: no}


def test_search_stays_within_its_bounds():
    bowl = lambda p: ((p[0] - 3) ** 2 + 4 * (p[1] + 1) ** 2, np.array([2 * (p[0] - 3), 8 * (p[1] + 1)]))
    point, value = T.bounded_newton(bowl, (0.0, 0.0), ((-5.0, 5.0), (-5.0, 5.0)), 300)
    assert np.allclose(point, [3, -1], atol=1e-5) and value < 1e-9
    point, _ = T.bounded_newton(bowl, (2.0, 2.0), ((-2.0, 2.0), (0.0, 2.0)), 300)
    assert np.allclose(point, [2, 0], atol=1e-6)
    bent = lambda p: (100 * (p[1] - p[0] ** 2) ** 2 + (1 - p[0]) ** 2, np.array([-400 * p[0] * (p[1] - p[0] ** 2) - 2 * (1 - p[0]), 200 * (p[1] - p[0] ** 2)]))
    assert np.allclose(T.bounded_newton(bent, (-1.2, 1.0), ((-5.0, 5.0), (-5.0, 5.0)), 500)[0], [1, 1], atol=1e-4)


def likelihood(m, limit, knee, slope, bright=-24.0, faint=-15.0):
    """The whole sum, row by row."""
    grid = np.linspace(bright, faint, 4096)
    shape = lambda v: np.log(0.4 * np.log(10)) + (slope + 1) * 0.4 * (knee - v) * np.log(10) - 10 ** (0.4 * (knee - v))
    density = np.exp(shape(grid))
    area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(grid))])
    return float((np.log(np.interp(np.minimum(limit, faint), grid, area)) - shape(m)).sum())


def test_luminosity_fit_is_the_least_of_the_whole_likelihood(spark):
    rng = np.random.default_rng(8)
    m = -24 + 8 * rng.random(3000)
    limit = m + rng.random(3000) * 3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, limit)] + [(None, -16.0), (-17.0, float("nan"))], "m double, lim double")
    knee, slope, loss = T.fit_luminosity(df, "m", "lim", -24.0, -15.0)
    assert -24 <= knee <= -18 and -2.5 <= slope <= 0.5 and abs(loss - likelihood(m, limit, knee, slope)) < 1e-3
    for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
        inside = -24 <= knee + a <= -18 and -2.5 <= slope + b <= 0.5
        assert not inside or loss <= likelihood(m, limit, knee + a, slope + b) + 1e-3


def test_truncation_is_checked(spark):
    frame = lambda rows: spark.createDataFrame(rows, "m double, lim double")
    with pytest.raises(ValueError, match="brighter"):
        T.fit_luminosity(frame([(-25.0, -16.0), (-20.0, -16.0)]), "m", "lim", -24.0, -15.0)
    with pytest.raises(ValueError, match="fainter"):
        T.fit_luminosity(frame([(-15.9, -16.0), (-20.0, -16.0)]), "m", "lim", -24.0, -15.0)
    with pytest.raises(ValueError, match="fainter"):  # beyond the faint end, whatever its limit
        T.fit_luminosity(frame([(-14.5, -14.0), (-20.0, -16.0)]), "m", "lim", -24.0, -15.0)
    with pytest.raises(ValueError, match="no rows"):
        T.fit_luminosity(frame([]), "m", "lim", -24.0, -15.0)


def test_dispersion_about_the_local_mean(spark):
    edges = spark.createDataFrame([(1, 10, 0.0), (1, 11, 0.0)], "src long, dst long, dist double")
    values = spark.createDataFrame([(10, 1e6 + 1.0, 0.0, 1.0), (11, 1e6 + 5.0, 0.0, 3.0)], "id long, vx double, vy double, mass double")
    got = G.bulk_field(edges, values, 1.0, ["vx", "vy"], "mass", True).collect()[0]
    assert abs(got.vx - (1e6 + 4)) < 1e-6 and abs(got.dispersion - 3 ** 0.5) < 1e-9


def test_resume_builds_what_is_missing(spark, tmp_path):
    place, asked = str(tmp_path / "blocks"), []

    def build(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.select("k", (F.col("k") * 10).alias("v"))

    grid = lambda n: spark.range(n).select(F.col("id").cast("int").alias("k"))
    IO.resume(spark, place, grid(2), ["k"], build)
    got = IO.resume(spark, place, grid(4), ["k"], build)
    assert asked == [[0, 1], [2, 3]] and sorted((r.k, r.v) for r in got.collect()) == [(k, 10 * k) for k in range(4)]
    assert IO.resume(spark, place, grid(4), ["k"], build).count() == 4 and len(asked) == 2


def test_half_a_block_is_built_again(spark, tmp_path):
    import glob
    import os

    place, asked = str(tmp_path / "blocks"), []

    def build(missing):
        asked.append(sorted((r.k, r.g) for r in missing.collect()))
        return missing.select("k", "g", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("v")).where("k <> 2").withColumn("v", F.col("v") * 10)

    grid = spark.range(4).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("g"))
    want = sorted((k, f"g{k % 2}", 10 * v) for k in (0, 1, 3) for v in range(1, k + 2))
    rows = lambda df: sorted((r.k, r.g, r.v) for r in df.collect())
    assert rows(IO.resume(spark, place, grid, ["k", "g"], build)) == want
    # A job that died while it moved its files: some are there, but no manifest tells of them; another block lost a file.
    for f in glob.glob(f"{place}/data/k=3/g=g1/*.parquet"):
        os.remove(f)
    spark.createDataFrame([(77,)], "v int").write.mode("append").parquet(f"{place}/data/k=3/g=g1")
    spark.createDataFrame([(99,)], "v int").write.mode("append").parquet(f"{place}/data/k=9/g=g1")
    got = IO.resume(spark, place, grid, ["k", "g"], build, order=["k", "g", "v"])
    assert asked == [[(0, "g0"), (1, "g1"), (2, "g0"), (3, "g1")], [(3, "g1")]] and rows(got) == want
    assert [r.v for r in got.orderBy("candidate_id").collect()] == [w[2] for w in want] and [r[0] for r in got.select("candidate_id").orderBy("candidate_id").collect()] == list(range(7))
    wider = grid.unionByName(spark.createDataFrame([(9, "g1")], "k int, g string"))
    assert rows(IO.resume(spark, place, wider, ["k", "g"], build)) == sorted(want + [(9, "g1", 10 * v) for v in range(1, 11)]) and asked[-1] == [(9, "g1")]


def test_blocks_are_read_alone_and_broken_ones_are_absent(spark, tmp_path):
    from isofield.sources.blocks import BlockStore

    store = BlockStore(spark, str(tmp_path), {"a": 1})
    for k in range(4):
        store.write(k, spark.range(20).select("id", F.array(F.col("id") * 1.0 + k).alias("v")), width=1)
    assert [m["width"] for m in store.completed()] == [1] * 4
    two = store.read(1, 2)
    plan = two._jdf.queryExecution().toString()
    assert two.count() == 40 and {r.block for r in two.select("block").distinct().collect()} == {1, 2} and "block=000003" not in plan
    assert all("block=000001" in f or "block=000002" in f for f in two.inputFiles())
    import glob
    import os

    os.remove(glob.glob(f"{store.data(2)}/*.parquet")[0])
    assert len(store.completed()) == 2 and BlockStore(spark, str(tmp_path), {"a": 2}).completed() == []


def test_json_has_null_for_what_is_no_number(spark, tmp_path):
    import json

    df = spark.sql("select 1 k, double('NaN') a, array(1.0D, double('Infinity'), null) b, named_struct('x', float('-Infinity'), 'y', 'NaN') c, map('m', double('NaN'), 'n', 2.0D) d")
    IO.write_new(df, str(tmp_path / "j"), "json")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert json.loads(text, parse_constant=lambda c: pytest.fail(c)) == {"k": 1, "a": None, "b": [1.0, None, None], "c": {"x": None, "y": "NaN"}, "d": {"m": None, "n": 2.0}}


def test_npz_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", pos=np.arange(6.0).reshape(2, 3), ids=np.array([7, 2 ** 60]), m=np.array([1.0, np.nan]))
    np.savez(tmp_path / "b.npz", pos=np.ones((1, 3)), ids=np.array([9]), m=np.array([3.0]))
    got = IO.read_npz(spark, [str(tmp_path / "a.npz"), str(tmp_path / "b.npz")], {"ids": "id", "pos": "pos", "m": "m"}).orderBy("id").collect()
    assert [r.id for r in got] == [7, 9, 2 ** 60] and got[0].pos_2 == 2.0 and got[1].m == 3.0
    with pytest.raises(Exception, match="has no"):
        IO.read_npz(spark, str(tmp_path / "b.npz"), {"vel": "vel"}).collect()
