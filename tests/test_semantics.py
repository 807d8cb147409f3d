"""Rules that a copy of an operator easily gets wrong: missing values, ties, deviations, quantiles, splits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isofield.functions import columns as C
from isofield.operators import relational as R
from isofield.operators import selectors as S
from isofield.operators import summaries as M
from isofield.operators import weights as T
from isofield.sources import tables as IO

NAN = float("nan")


def test_summary_skips_nan_and_has_no_deviation_of_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", NAN), ("b", 2.0), ("b", 4.0), ("b", float("inf")), ("c", None), ("c", NAN)], "g string, v double")
    got = {r.g: r for r in M.finite_summary(df, ["g"], "v").collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"]["std"], got["a"]["sem"]) == (1, 1.0, 0.0, 0.0)
    assert (got["b"].n, got["b"]["mean"], got["b"]["median"]) == (2, 3.0, 3.0) and abs(got["b"]["std"] - 2 ** 0.5) < 1e-12
    assert got["c"].n == 0 and got["c"]["mean"] is None and got["c"]["std"] is None


def test_argmin_ties_and_null_scores(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.0), ("a", 1, None), ("b", 1, None)], "g string, n int, s double")
    assert sorted((r.g, r.n) for r in R.argmin(df, ["g"], "s", ["n"]).collect()) == [("a", 2), ("b", 1)]


def test_first_known_value_differs_from_the_first_row(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 7.0, None), ("a", 3, 8.0, 6)], "g string, k int, x double, y int")
    assert R.first_known(df, ["g"], ["k"]).collect()[0].asDict() == {"g": "a", "x": 7.0, "y": 5}


@pytest.mark.parametrize("least, want", [(0, 4), (6, 6)])
def test_plateau_with_and_without_a_floor(spark, least, want):
    curve = spark.createDataFrame([("a", n, v) for n, v in ((2, 1.0), (4, 0.5), (6, 0.499), (8, 0.498), (10, 0.497), (12, 0.6))], "g string, n int, v double")
    assert S.plateau(curve, ["g"], "n", "v", least=least).collect()[0].plateau == want


def test_losses_count_as_small_gains_and_short_curves_have_no_plateau(spark):
    curve = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.5), ("a", 3, 2.0), ("b", 1, 1.0), ("b", 2, 0.999)], "g string, n int, v double")
    assert {r.g: r.plateau for r in S.plateau(curve, ["g"], "n", "v").collect()} == {"a": 1, "b": None}


def test_one_standard_error_searches_the_whole_grid(spark):
    curve = spark.createDataFrame([("a", 1, 1.05, 0.1), ("a", 2, 1.0, 0.06), ("a", 3, 1.0, 0.5)], "g string, n int, m double, s double")
    r = S.one_standard_error(curve, ["g"], "n", "m", "s").collect()[0]
    assert (r.best, r.one_se) == (2, 1)


def test_capacity_with_a_plateau_floor(spark):
    scores = spark.createDataFrame([("a", n, s, 1 / n + 0.001 * s) for n in (1, 2, 4, 100, 101, 102, 103) for s in (1, 2, 3)], "g string, n int, seed int, v double")
    r = S.capacity_decision(scores, ["g"], "n", "v", least=50).collect()[0]
    assert (r.best, r.plateau, r.largest, r.practical) == (103, 100, 103, 100)


def test_weighted_quantile_interpolates_and_clamps(spark):
    df = spark.createDataFrame([("a", v, 1.0) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0, 2.0), ("b", 9.0, 0.0)], "g string, v double, w double")
    at = lambda q: {r.g: r.q for r in M.weighted_quantile(df, ["g"], "v", "w", q, "q").collect()}
    assert at(0.5) == {"a": 2.0, "b": 5.0} and at(0.1)["a"] == 1.0 and abs(at(0.6)["a"] - 2.4) < 1e-12


def test_last_bin_is_closed_and_small_bins_go(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(20)], "x double, y double")
    assert sum(r.n for r in M.quantile_bins(df, "x", "y", 4).collect()) == 20
    assert M.quantile_bins(df, "x", "y", 10).count() == 0


def test_splits_round_half_to_even(spark):
    df = spark.range(25).withColumn("g", F.lit(1))
    for groups in (None, ["g"]):
        got = {r.split: r["count"] for r in T.split(df, "id", 5, 0.7, 0.1, groups).groupBy("split").count().collect()}
        assert got == {"train": round(17.5), "validation": round(2.5), "test": 25 - round(17.5) - round(2.5)}


def test_weights_have_mean_one_and_power_zero_gives_ones(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([1e-6, 0.01, 0.2, 0.5, 1.0])], "id int, p double")
    w = [r.weight for r in T.inverse_weights(df, "p").orderBy("id").collect()]
    assert abs(np.mean(w) - 1) < 1e-12 and w[0] == max(w) and w[0] / w[-1] <= 50.0 + 1e-9
    assert {r.weight for r in T.inverse_weights(df, "p", power=0).collect()} == {1.0}


def test_noise_is_seeded_and_zero_noise_runs_once(spark):
    df = spark.createDataFrame([(k, 1.0, 1.0) for k in range(4000)], "id int, v double, profile double")
    rows = T.add_noise(df, "id", "v", "profile", 0.5, 2.0, [1, 2]).collect()
    gap = np.array([r.noisy - r.v for r in rows])
    assert len(rows) == 8000 and abs(gap.std() - 1.0) < 0.05 and abs(gap.mean()) < 0.05
    assert T.add_noise(df, "id", "v", "profile", 0.0, 2.0, [1, 2]).count() == 4000


def test_luminosity_fit_recovers_its_parameters(spark):
    rng = np.random.default_rng(3)
    grid = np.linspace(-24, -15, 6000)
    x = 0.4 * (-20.4 - grid)
    density = np.exp((-1.1 + 1) * x * np.log(10) - 10 ** x)
    cdf = np.cumsum(density) / density.sum()
    m = np.interp(rng.random(6000), cdf, grid)
    limit = rng.uniform(-19.5, -15.5, 6000)
    keep = m <= limit
    df = spark.createDataFrame(pd.DataFrame({"m": m[keep], "lim": limit[keep]}))
    knee, slope, loss = T.fit_luminosity(df, "m", "lim", -24.0, -15.0)
    assert loss <= T.fit_luminosity(df, "m", "lim", -24.0, -15.0, start=(-20.4, -1.1), rounds=0)[2]
    assert abs(knee + 20.4) < 0.3 and abs(slope + 1.1) < 0.3


def test_sign_test_is_exact(spark):
    from math import comb

    pairs = [(w, l) for w in range(0, 9) for l in range(0, 9)]
    got = spark.createDataFrame(pairs, "w int, l int").withColumn("p", S.sign_test(F.col("w"), F.col("l"))).collect()
    for r in got:
        n = r.w + r.l
        assert abs(r.p - min(1.0, 2 * sum(comb(n, j) for j in range(min(r.w, r.l) + 1)) / 2 ** n)) < 1e-12


def number(seed, draw, id_):
    """columns.random_number() by hand."""
    x = (id_ * C.ID_FACTOR + draw * C.DRAW_FACTOR + seed * C.SEED_FACTOR) % 2 ** 31
    for shift, factor in zip((15, 12), C.MIX_FACTORS):
        x = (x ^ (x >> shift)) * factor % 2 ** 31
    return x ^ (x >> 15)


def test_random_numbers_are_even_and_apart(spark):
    got = np.array([[r.a, r.b] for r in spark.range(4000).select(C.random_number(3, F.col("id") % 40, (F.col("id") / 40).cast("long")).alias("a"), C.random_number(4, F.col("id") % 40, (F.col("id") / 40).cast("long")).alias("b")).collect()]) / 2.0 ** 31
    assert abs(got.mean() - 0.5) < 0.02 and abs(got.std() - 12 ** -0.5) < 0.01 and abs(np.corrcoef(got.T)[0, 1]) < 0.05
    grid = got[:, 0].reshape(100, 40)
    assert np.abs(np.corrcoef(grid[:, :10].T) - np.eye(10)).max() < 0.4 and grid.ravel()[0] * 2 ** 31 == number(3, 0, 0)


def test_bootstrap_draws_with_replacement(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.0]
    df = spark.createDataFrame([("a", v, k) for k, v in enumerate(values)] + [("b", NAN, 0), ("b", None, 1), (None, 5.0, 0)], "g string, v double, k int")
    a, b = ({r.g: r for r in S.bootstrap_mean(d, ["g"], "v", ["k"], 300, 4).collect()} for d in (df, df.repartition(5)))
    assert a == b and a["b"].n == 0 and a["b"].mean is None and a[None].low == a[None].high == 5.0
    x = sorted(values)
    means = [np.mean([x[number(4, d, i) % 6] for i in range(6)]) for d in range(1, 301)]
    assert np.allclose([a["a"].low, a["a"].high, a["a"].mean], [*np.quantile(means, [0.025, 0.975]), np.mean(x)]) and 0.5 < np.std(means) / (np.std(x) / 6 ** 0.5) < 1.5


def test_ranks_within_groups_of_any_size(spark):
    rows = [(None if k % 7 == 0 else k % 3 if k % 2 else 0, (k * 37) % 101, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, v int, k int").repartition(7)
    got = {r.k: (r["rank"], r.size) for r in R.ranked_within(df, ["g"], ["v", "k"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, k) for h, v, k in rows if h == g)
        assert all(got[k] == (i, len(own)) for i, (_, k) in enumerate(own))


def test_variants_that_are_easily_mixed_up(spark):
    from isofield.operators import regression as L
    from isofield.operators import spectral as E

    # Octants: population or sample deviation, and least rows of a region.
    df = spark.createDataFrame([("m", k % 4, float(k % 4)) for k in range(24)] + [("m", 5, 9.0)], "m string, r int, v double")
    a, b = (M.octant_summary(df, ["m"], "r", F.avg("v"), least, whole).first() for least, whole in ((1, True), (5, False)))
    assert abs(a["std"] - np.std([0, 1, 2, 3, 9])) < 1e-12 and a.missing == "4,6,7" and abs(b["std"] - np.std([0, 1, 2, 3], ddof=1)) < 1e-12 and b.missing == "4,5,6,7" and b.worst == 3.0
    # Penalties: zero modes go free under a power, or are penalised by the ridge constant without one.
    g = np.array([0.0, 0.25, 4.0])
    assert L.penalty(g, 0.5, 1e-6).tolist() == [0.0, 0.5, 2.0] and L.penalty(g, 0.5, 1e-6, False).tolist() == [1e-6, 0.25, 4.0]
    # Generators: over their own median without zero modes, or over a fixed scale.
    values = np.array([1.0, 0.9, 0.6, 0.2])
    assert np.allclose(E.generator(values), np.array([0, 0.1, 0.4, 0.8]) / 0.4) and np.allclose(E.generator(values, 0.2), [0, 0.5, 2.0, 4.0])
    # Gram matrices are over the sum of weights, so weights of another scale change nothing.
    rows = spark.createDataFrame([([1.0, float(k)], 2.0 * k, 1.0 + k % 3) for k in range(9)], "x array<double>, y double, w double")
    one, two = (L.gram(rows, "x", "y", c) for c in (F.col("w"), 10 * F.col("w")))
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1]) and one[0][0, 0] == 1.0 and abs(two[2] - 10 * one[2]) < 1e-9
    # Calibration lines have a free intercept, or none.
    c = M.calibration(spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 5.0)], "g int, t double, p double"), ["g"], "t", "p").first()
    assert (round(c.slope, 12), round(c.intercept, 12), round(c.origin_slope, 12)) == (2.0, 1.0, 2.6)


def test_several_targets_share_a_factor_and_least_squares_need_no_gram(spark):
    from isofield.operators import regression as L

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1.0, 1e-4, 1.0]
    y, w = x @ rng.normal(size=(3, 2)) * [1.0, 100.0] + 0.01 * rng.normal(size=(200, 2)), rng.uniform(0.5, 2, 200)
    rows = spark.createDataFrame([(a.tolist(), *map(float, b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, a double, b double, w double").repartition(6)
    got = L.least_squares(rows, "x", ["a", "b"], F.col("w"))
    want = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w)[:, None], rcond=None)[0]
    assert got["rank"] == 3 and np.allclose(got["theta"], want, rtol=1e-8)
    same = L.least_squares(rows.withColumn("x", F.concat("x", F.slice("x", 1, 1))), "x", ["a"], F.col("w"))
    assert same["rank"] == 3 and abs(same["theta"][0, 0] - same["theta"][3, 0]) < 1e-10 and abs(same["theta"][0, 0] * 2 - want[0, 0]) < 1e-8
    grid = L.vector_coefficients(rows, "x", ["a", "b"], np.array([0.0, 1.0, 2.0]), [1, 3], [0.1], [1.0], F.col("w"), 0.0)
    gram = x.T @ (x * w[:, None]) / w.sum()
    assert np.allclose(grid[1]["theta"], np.linalg.solve(gram + 0.1 * np.diag([0.0, 1.0, 2.0]), x.T @ (y * w[:, None]) / w.sum()))
    scores = {r.n_basis: r.nrmse for r in L.vector_scores(rows, "x", ["a", "b"], grid, F.col("w")).collect()}
    assert abs(scores[3] - np.sqrt((w[:, None] * (x @ grid[1]["theta"] - y) ** 2).sum() / (w[:, None] * y ** 2).sum())) < 1e-10
    with pytest.raises(ValueError):
        L.least_squares(rows.limit(0), "x", ["a"])


def test_split_rules_of_small_groups(spark):
    df = spark.createDataFrame([(k, 3) for k in range(3)] + [(k, 10) for k in range(10, 20)], "id long, g int")
    got = {(r.g, r.split): r["count"] for r in T.split(df, "id", 1, 0.9, 0.4, ["g"]).groupBy("g", "split").count().collect()}
    # Three rows: training rounds to all of them, validation keeps one of its own; ten: 9 and 4 would leave none for the test.
    assert got == {(3, "train"): 3, (10, "train"): 9, (10, "validation"): 1}
    assert {r.split: r["count"] for r in T.split(df.where("g = 10"), "id", 1, 0.7, 0.4, ["g"]).groupBy("split").count().collect()} == {"train": 7, "validation": 2, "test": 1}
    with pytest.raises(ValueError):
        T.split(df.where("id <> 0"), "id", 1, 0.5, 0.2, ["g"])


def test_point_bootstrap_leaves_out_bad_rows(spark):
    rows = [(k, 1.0 + k % 5, 0.5 * k % 3, 1.0) for k in range(300)]
    df = spark.createDataFrame([*rows, (900, NAN, 1.0, 1.0), (901, None, 1.0, 1.0)], "id long, x double, y double, z double").withColumns({"p": F.col("x") * 0.9, "q": F.col("x") * 0.5})
    a, b = (S.point_bootstrap(d, "id", ["x", "y", "z"], ["p", "y", "z"], ["q", "y", "z"], ["x", "y", "z"], draws=50).first() for d in (df, df.where("id < 900").repartition(4)))
    assert np.allclose(list(a), list(b)) and a.share_a_better_3d == 1.0 and a.delta_3d_low <= a.delta_3d_mean <= a.delta_3d_high < 0


def test_unique_keys_and_exact_pivots(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "k int, c string, v double")
    with pytest.raises(ValueError):
        R.one_to_one(df, df, ["k"])
    with pytest.raises(ValueError):
        R.pivot_exact(df, ["k"], "c", ["a"], "v")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("g,v\na,1.5\nb,NaN\nc,\n")
    assert [(r.g, r.v) for r in IO.read_csv(spark, str(tmp_path / "a.csv"), "g string, v double").orderBy("g").collect()] == [("a", 1.5), ("b", None), ("c", None)]
    (tmp_path / "d.txt").write_text("# key : value : more\nnot a pair\n#  n: 12\n")
    assert {r.key: r.value for r in IO.read_description(spark, str(tmp_path / "d.txt")).collect()} == {"key": "value : more", "n": "12"}
    assert IO.first_existing(spark, [str(tmp_path / "x"), str(tmp_path / "a.csv")]).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        IO.first_existing(spark, [str(tmp_path / "x")])
    df = spark.range(3)
    for kind in ("csv", "json", "parquet"):
        IO.write_new(df, str(tmp_path / kind), kind)
        with pytest.raises(Exception):
            IO.write_new(df, str(tmp_path / kind), kind)
    calls = []
    build = lambda: calls.append(1) or spark.range(5)
    for s in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert IO.build_or_load(spark, str(tmp_path / "cache"), s, build).count() == 5
    assert len(calls) == 2
    assert IO.parse_list("1, 2.5,") == [1.0, 2.5] and IO.parse_bool("Yes") and IO.parse_seed_pairs("1:2,3:4") == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        IO.require(df, ["id", "zz"])


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert R.digest(df).collect() == R.digest(df.repartition(7)).collect() != R.digest(df.where("id < 99")).collect()


@pytest.mark.parametrize("advisory", ["64m", "1m"])
def test_numbers_of_wide_rows_over_many_partitions(spark, tmp_path, advisory):
    """Every number once, in order, whatever the partitions of the sort and of the adaptive plan."""
    from isofield.operators.relational import numbered
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        n = 200_000
        df = spark.range(n).select(F.xxhash64("id").alias("x"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 3).alias("wide"), F.lit(7).alias("part__"))
        path = str(tmp_path / "numbered")
        numbered(df, ["x", "id"], "number").write.parquet(path)
        got = spark.read.parquet(path)
        row = got.agg(F.count(F.lit(1)), F.countDistinct("number"), F.min("number"), F.max("number")).first()
        assert tuple(row) == (n, n, 0, n - 1) and got.columns == [*df.columns, "number"]
        assert got.select("x", "number").orderBy("number").toPandas()["x"].is_monotonic_increasing
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
