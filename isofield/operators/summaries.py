"""Summaries of finite values, weighted statistics, and scores of predicted scalars and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isofield.functions.columns import direction_error, dot, finite, norm
from isofield.operators.relational import cumulative, quantiles


def spread(x: Column) -> Column:
    """Sample deviation of finite values, 0 for one value, null for none."""
    v = finite(x)
    return F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))


def finite_summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, mean, std, sem, min, median and max of the finite values of each group."""
    v = finite(F.col(value))
    return df.groupBy(*groups).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), spread(F.col(value)).alias("std"),
        F.try_divide(spread(F.col(value)), F.sqrt(F.count(v))).alias("sem"), F.min(v).alias("min"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"))


def nested_summary(df: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """Means within each inner group, then their summary with equal weights."""
    return finite_summary(df.groupBy(*outer, inner).agg(F.avg(finite(F.col(value))).alias(value)), outer, value)


def weighted_mean(x: Column, w: Column) -> Column:
    """Null when the weights do not add up to something positive."""
    return F.when(F.sum(w) > 0, F.try_divide(F.sum(w * x), F.sum(w)))


def effective_size(w: Column) -> Column:
    return F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))


def nrmse(truth: Column, predicted: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else w
    return F.sqrt(F.try_divide(F.sum(w * (predicted - truth) ** 2), F.sum(w * truth * truth)))


def weighted_quantile(df: DataFrame, groups: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """Linear interpolation of values over the cumulative share of weight, clamped at both ends.

    Values that are equal are one step. Rows without positive weight do not count.
    """
    rows = df.where((F.col(weight) > 0) & finite(F.col(value)).isNotNull()).select(*groups, value, weight)
    steps = cumulative(rows, groups, value, F.col(weight)).withColumns({"cum__": F.col("upto__") / F.col("total__"), "c0__": F.when(F.col("last__").isNotNull(), F.col("before__") / F.col("total__"))})
    hit = steps.where((F.col("cum__") >= q) & (F.col("c0__").isNull() | (F.col("c0__") < q)))
    inner = F.col("last__") + (F.col(value) - F.col("last__")) * F.try_divide(F.lit(q) - F.col("c0__"), F.col("cum__") - F.col("c0__"))
    return hit.groupBy(*groups).agg(F.min(F.coalesce(inner, F.col(value))).alias(name))


def beside(tables: list[DataFrame], groups: list[str]) -> DataFrame:
    """Tables of one row a group side by side; the first one's groups stay, null groups included."""
    out = tables[0]
    for k, t in enumerate(tables[1:]):
        t = t.withColumnsRenamed({g: f"{g}__{k}" for g in groups})
        on = F.lit(True)
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"{g}__{k}"))
        out = out.join(t, on, "left").drop(*[f"{g}__{k}" for g in groups])
    return out


def weighted_vector_metrics(df: DataFrame, groups: list[str], truth: list[str], predicted: list[str], weight: str) -> DataFrame:
    """vector_metrics with row weights, negative ones as 0; quantiles are read off the cumulative weight of the finite values."""
    rows = df.withColumn("w__", F.greatest(F.col(weight).cast("double"), F.lit(0.0)))
    t, p, w = [F.col(c) for c in truth], [F.col(c) for c in predicted], F.col("w__")
    gap = [b - a for a, b in zip(t, p)]
    mean = lambda x: weighted_mean(x, w)
    corr = lambda a, b: F.try_divide(mean(a * b) - mean(a) * mean(b), F.sqrt((mean(a * a) - mean(a) ** 2) * (mean(b * b) - mean(b) ** 2)))
    residual = [mean(g) for g in gap]
    sums = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(mean(dot(gap, gap))).alias("rmse_3d"), nrmse_of(dot(gap, gap), dot(t, t), w).alias("nrmse"),
        *[F.sqrt(mean(g * g)).alias(f"rmse_{k}") for g, k in zip(gap, "xyz")], *[corr(a, b).alias(f"corr_{k}") for a, b, k in zip(t, p, "xyz")],
        *[r.alias(f"residual_{k}") for r, k in zip(residual, "xyz")], F.sqrt(dot(residual, residual)).alias("mean_residual"))
    parts = rows.select(*groups, w, direction_error(t, p).alias("angle__"), F.abs(F.try_divide(norm(p) - norm(t), norm(t))).alias("speed__"))
    q = lambda v, share, name: weighted_quantile(parts, groups, v, "w__", share, name)
    return beside([sums, q("angle__", 0.5, "angle_median"), q("angle__", 0.9, "angle_p90"), q("speed__", 0.5, "speed_error_median")], groups)


def nrmse_of(error_square: Column, truth_square: Column, w: Column) -> Column:
    return F.sqrt(F.try_divide(F.sum(w * error_square), F.sum(w * truth_square)))


def vector_calibration(df: DataFrame, groups: list[str], truth: list[str], predicted: list[str], weight: Column | None = None) -> DataFrame:
    """Slope, intercept and slope through the origin of every component, and the gain of the whole vector through the origin."""
    w = F.lit(1.0) if weight is None else weight
    t, p = [F.col(c) for c in truth], [F.col(c) for c in predicted]
    mean = lambda x: weighted_mean(x, w)
    slope = [F.try_divide(mean(a * b) - mean(a) * mean(b), mean(a * a) - mean(a) ** 2) for a, b in zip(t, p)]
    return df.groupBy(*groups).agg(
        *[s.alias(f"slope_{k}") for s, k in zip(slope, "xyz")], *[(mean(b) - s * mean(a)).alias(f"intercept_{k}") for s, a, b, k in zip(slope, t, p, "xyz")],
        *[F.try_divide(F.sum(w * a * b), F.sum(w * a * a)).alias(f"origin_slope_{k}") for a, b, k in zip(t, p, "xyz")],
        F.try_divide(F.sum(w * dot(t, p)), F.sum(w * dot(t, t))).alias("gain"))


def direction_summary(df: DataFrame, groups: list[str], position: list[str], truth: list[str], predicted: list[str]) -> DataFrame:
    """Median and 90 % quantile of the angle between vectors, and how much larger predicted sizes and radial parts are (root mean squares)."""
    x, t, p = ([F.col(c) for c in cs] for cs in (position, truth, predicted))
    rt, rp = F.try_divide(dot(x, t), norm(x)), F.try_divide(dot(x, p), norm(x))
    sums = df.groupBy(*groups).agg(F.sqrt(F.try_divide(F.sum(dot(p, p)), F.sum(dot(t, t)))).alias("size_ratio"), F.sqrt(F.try_divide(F.sum(rp * rp), F.sum(rt * rt))).alias("radial_ratio"))
    angles = quantiles(df.select(*groups, direction_error(t, p).alias("angle__")), groups, "angle__", [0.5, 0.9])
    return beside([sums, angles], groups).withColumns({"angle_median": F.get("quantiles", F.lit(0)), "angle_p90": F.get("quantiles", F.lit(1))}).drop("quantiles")


def candidate_metrics(df: DataFrame, groups: list[str], position: list[str], truth: list[str], candidates: dict[str, list[str]]) -> DataFrame:
    """radial_metrics of many predictions of the same rows, one row for each candidate; its name is in column candidate."""
    each = F.array(*[F.struct(F.lit(k).alias("candidate"), *[F.col(c).alias(f"p{i}__") for i, c in enumerate(cs)]) for k, cs in candidates.items()])
    rows = df.select(*groups, *position, *truth, F.inline(each))
    return radial_metrics(rows, [*groups, "candidate"], position, truth, ["p0__", "p1__", "p2__"])


def vector_metrics(df: DataFrame, groups: list[str], truth: list[str], predicted: list[str]) -> DataFrame:
    """Errors of predicted vectors: size, by component, in direction, in speed, and the mean residual."""
    t, p = [F.col(c) for c in truth], [F.col(c) for c in predicted]
    gap = [b - a for a, b in zip(t, p)]
    mean = [F.avg(g) for g in gap]
    sums = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(dot(gap, gap))).alias("rmse_3d"), F.sqrt(F.try_divide(F.sum(dot(gap, gap)), F.sum(dot(t, t)))).alias("nrmse"),
        *[F.sqrt(F.avg(g * g)).alias(f"rmse_{k}") for g, k in zip(gap, "xyz")], *[F.corr(a, b).alias(f"corr_{k}") for a, b, k in zip(t, p, "xyz")],
        F.sqrt(dot(mean, mean)).alias("mean_residual"))
    # Quantiles from a range sort, as a group may be all points.
    angles = quantiles(df.select(*groups, direction_error(t, p).alias("angle__")), groups, "angle__", [0.5, 0.9], "angles__")
    speeds = quantiles(df.select(*groups, F.abs(F.try_divide(norm(p) - norm(t), norm(t))).alias("speed__")), groups, "speed__", [0.5], "speeds__")
    both = beside([sums, angles, speeds], groups).withColumns({"angle_median": F.get("angles__", F.lit(0)), "angle_p90": F.get("angles__", F.lit(1)), "speed_error_median": F.get("speeds__", F.lit(0))})
    names = [c for c in sums.columns if c != "mean_residual"]
    return both.select(*names, "angle_median", "angle_p90", "speed_error_median", "mean_residual")


def radial_metrics(df: DataFrame, groups: list[str], position: list[str], truth: list[str], predicted: list[str]) -> DataFrame:
    """The same errors split along and across the line of sight; each part is measured against its own truth."""
    x, t, p = ([F.col(c) for c in cs] for cs in (position, truth, predicted))
    rt, rp = F.try_divide(dot(x, t), norm(x)), F.try_divide(dot(x, p), norm(x))
    gap = [b - a for a, b in zip(t, p)]
    all_sq, truth_sq, radial_sq = dot(gap, gap), dot(t, t), (rp - rt) ** 2
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.try_divide(F.sum(radial_sq), F.sum(rt * rt))).alias("nrmse_radial"),
        F.sqrt(F.try_divide(F.sum(all_sq - radial_sq), F.sum(truth_sq - rt * rt))).alias("nrmse_tangential"),
        F.sqrt(F.try_divide(F.sum(all_sq), F.sum(truth_sq))).alias("nrmse_3d"), F.corr(rt, rp).alias("radial_corr"), F.avg(rp - rt).alias("radial_bias"))


def calibration(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Slope and intercept of predicted against true values, and the slope through the origin."""
    t, p = F.col(truth), F.col(predicted)
    return df.groupBy(*groups).agg(F.regr_slope(p, t).alias("slope"), F.regr_intercept(p, t).alias("intercept"),
                                   F.try_divide(F.sum(t * p), F.sum(t * t)).alias("origin_slope"))


def coverage(truth: Column, predicted: Column, variance: Column, z: float) -> Column:
    """Share of values within z deviations of their prediction."""
    return F.avg((F.abs(truth - predicted) <= F.lit(z) * F.sqrt(F.greatest(variance, F.lit(0.0)))).cast("double"))


def quantile_bins(df: DataFrame, by: str, value: str, bins: int, least: int = 5) -> DataFrame:
    """Means over quantile bins of a column; bins are right-open but the last, and small ones are left out."""
    edges = quantiles(df.select(by), [], by, [k / bins for k in range(bins + 1)], "edges").select(F.array_distinct("edges").alias("edges"))
    inside = df.crossJoin(F.broadcast(edges))
    last = F.size("edges") - 2
    bin_ = F.least(F.size(F.filter("edges", lambda e: e <= F.col(by))) - 1, last)
    return inside.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(by).alias("centre"), F.avg(value).alias("mean")).where(F.col("n") >= least)


def octant_summary(df: DataFrame, groups: list[str], region: str, value: Column, least: int = 1, population: bool = True) -> DataFrame:
    """Mean, deviation, worst, best and range over eight regions, and the regions that are missing."""
    per = df.groupBy(*groups, region).agg(value.alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    std = F.stddev_pop("v") if population else F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    return per.groupBy(*groups).agg(
        F.avg("v").alias("mean"), std.alias("std"), F.max("v").alias("worst"), F.min("v").alias("best"), (F.max("v") - F.min("v")).alias("range"),
        F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(7)), F.collect_set(F.col(region).cast("int")))), ",").alias("missing"))


def subset_scores(df: DataFrame, masks: dict[str, Column], score: Column, least: int) -> DataFrame:
    """A score for each subset that has enough rows."""
    tagged = df.withColumn("subset", F.explode(F.filter(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(k)) for k, m in masks.items()]), lambda x: x.isNotNull())))
    return tagged.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), score.alias("score")).where(F.col("n") >= least)
