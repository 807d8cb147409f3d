"""Choice of a basis size from score curves, agreement of choices, paired comparisons and intervals."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.functions.columns import dot, finite, norm, random_number, random_numbers
from isofield.operators.relational import quantiles, ranked_within
from isofield.operators.summaries import finite_summary
from isofield.sources.shared import cut


def relative_improvement(curve: DataFrame, groups: list[str], size: str, score: str, floor: float = 0.0) -> DataFrame:
    """Gain of each step over the step before, in parts of the score before; null for the first."""
    w = Window.partitionBy(*groups).orderBy(size)
    before = F.lag(score).over(w)
    base = F.greatest(F.abs(before), F.lit(floor)) if floor else before
    return curve.withColumn("previous_size", F.lag(size).over(w)).withColumn("improvement", F.try_divide(before - F.col(score), base))


def plateau(curve: DataFrame, groups: list[str], size: str, score: str, tolerance: float = 0.02, steps: int = 2, least: int = 0, floor: float = 0.0) -> DataFrame:
    """Smallest size at or above least whose next steps all gain less than tolerance; losses count as such. Null if none."""
    w = Window.partitionBy(*groups).orderBy(size)
    gains = relative_improvement(curve.where(finite(F.col(score)).isNotNull() & (F.col(size) >= least)), groups, size, score, floor)
    flat = F.lit(True)
    for k in range(1, steps + 1):
        flat = flat & F.coalesce(F.lead("improvement", k).over(w) < tolerance, F.lit(False))
    found = gains.withColumn("flat__", flat).groupBy(*groups).agg(F.min(F.when(F.col("flat__"), F.col(size))).alias("plateau"))
    return curve.select(*groups).distinct().join(found, groups, "left") if groups else found


def one_standard_error(curve: DataFrame, groups: list[str], size: str, mean: str, sem: str, slack: float = 0.0) -> DataFrame:
    """The best size, the bound of its mean plus its error, and the smallest size within the bound."""
    best = curve.where(finite(F.col(mean)).isNotNull()).groupBy(*groups).agg(
        F.min_by(F.struct(F.col(size).alias("best"), F.col(mean).alias("m"), F.col(sem).alias("s")), F.struct(mean, size)).alias("b")) \
        .select(*groups, F.col("b.best").alias("best"), (F.col("b.m") + F.coalesce(F.col("b.s"), F.lit(0.0)) + F.lit(slack)).alias("bound"))
    within = curve.join(best, groups).where(F.col(mean) <= F.col("bound"))
    return within.groupBy(*groups).agg(F.first("best").alias("best"), F.first("bound").alias("bound"), F.min(size).alias("one_se"))


def capacity_decision(scores: DataFrame, groups: list[str], size: str, score: str, tolerance: float = 0.02, steps: int = 2, least: int = 0) -> DataFrame:
    """From scores by seed: best, one-standard-error, plateau and practical size of each group, and whether it stops short of the largest.

    The practical size is the larger of the one-standard-error size and the plateau, or the former where there is no plateau.
    """
    scores = scores.select(*groups, F.col(size).alias("size__"), F.col(score).alias("score__"))
    size = "size__"
    curve = finite_summary(scores, [*groups, size], "score__").where("mean is not null").select(*groups, size, "mean", "sem")
    w = Window.partitionBy(*groups).orderBy(size)
    flat = F.col(size) >= least
    gains = relative_improvement(curve.where(F.col(size) >= least), groups, size, "mean") if least else relative_improvement(curve, groups, size, "mean")
    for k in range(1, steps + 1):
        flat = flat & F.coalesce(F.lead("improvement", k).over(w) < tolerance, F.lit(False))
    if least:  # the plateau has a floor, the one-standard-error rule has none
        gains = gains.unionByName(curve.where(F.col(size) < least), allowMissingColumns=True)
    # A group has one row for each size of the grid, so its curve fits in a row.
    per = gains.withColumn("flat__", flat).groupBy(*groups).agg(
        F.min_by(F.struct(F.col(size).alias("best"), "mean", "sem"), F.struct("mean", size)).alias("b"), F.min(F.when(F.col("flat__"), F.col(size))).alias("plateau"),
        F.max(size).alias("largest"), F.collect_list(F.struct(F.col(size).alias("size"), "mean")).alias("curve"))
    bound = F.col("b.mean") + F.coalesce("b.sem", F.lit(0.0))
    per = per.withColumn("bound", bound).withColumn("one_se", F.array_min(F.transform(F.filter("curve", lambda c: c["mean"] <= F.col("bound")), lambda c: c["size"])))
    practical = F.greatest(F.col("one_se"), F.coalesce("plateau", "one_se"))
    return per.select(*groups, F.col("b.best").alias("best"), "one_se", "plateau", practical.alias("practical"), "largest",
                      (F.col("plateau").isNotNull() & (practical < F.col("largest"))).alias("converged"))


def at_largest(choices: DataFrame, groups: list[str], seed: str, chosen: str, largest: int) -> DataFrame:
    """Share of choices that are the largest size: within each seed, then over seeds."""
    inner = choices.groupBy(*groups, seed).agg(F.avg((F.col(chosen) == largest).cast("double")).alias("share"))
    return inner.groupBy(*groups).agg(F.avg("share").alias("share_at_largest"), F.count(F.lit(1)).alias("seeds"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], same: list[str], size: str) -> DataFrame:
    """How often two selectors choose alike, and the mean gap of their sizes."""
    x, y = a.alias("a"), b.alias("b")
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return x.join(y, keys).agg(F.count(F.lit(1)).alias("compared"), F.count_if(alike).alias("same"), F.avg(F.col(f"a.{size}") - F.col(f"b.{size}")).alias("mean_size_gap"))


def empirical_cdf(df: DataFrame, groups: list[str], value: str, tie: str) -> DataFrame:
    """Rank over count; ties get steps of their own."""
    w = Window.partitionBy(*groups).orderBy(value, tie)
    return df.withColumn("cdf", F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy(*groups)))


def cumulative_trapezoid(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(x)
    area = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("step__", F.coalesce(area, F.lit(0.0))).withColumn("integral", F.sum("step__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step__")


def paired(df: DataFrame, keys: list[str], label: str, a: str, b: str, values: list[str]) -> DataFrame:
    """a minus b of every value on rows that match in keys."""
    left, right = df.where(F.col(label) == a).alias("a"), df.where(F.col(label) == b).alias("b")
    return left.join(right, keys).select(*keys, *[(F.col(f"a.{v}") - F.col(f"b.{v}")).alias(f"delta_{v}") for v in values])


def sign_counts(df: DataFrame, groups: list[str], delta: str) -> DataFrame:
    d = finite(F.col(delta))
    return df.groupBy(*groups).agg(F.count_if(d < 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d > 0).alias("losses"),
                                   F.avg(d).alias("mean_delta"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_delta"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p-value of a fair coin, at any number of tosses: binomial terms are built one from the other by their logarithms."""
    n, k = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    state = lambda log, total: F.struct(log.alias("log"), total.alias("total"))
    start = state(-n.cast("double") * F.log(F.lit(2.0)), F.lit(0.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, lambda s, j: state(s["log"] + F.coalesce(F.log((n - j).cast("double")), F.lit(0.0)) - F.log((j + 1).cast("double")), s["total"] + F.exp(s["log"])))
    return F.least(F.lit(1.0), 2 * tail["total"])


def _draws(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def _interval(means: DataFrame, groups: list[str], value: str, level: float) -> DataFrame:
    """(groups, low, high, share_negative) of a column of draws."""
    ends = quantiles(means, groups, value, [(1 - level) / 2, (1 + level) / 2], "ends__")
    share = means.groupBy(*groups).agg(F.avg((F.col(value) < 0).cast("double")).alias("share_negative"))
    at = lambda k: F.get("ends__", F.lit(k))
    return _same(share, ends, groups).select(*[F.col(f"a.{g}") for g in groups], at(0).alias("low"), at(1).alias("high"), "a.share_negative")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join as a and b on keys that may be null."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, how)


def bootstrap_mean(df: DataFrame, groups: list[str], value: str, ties: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(groups, n, mean, low, high, share_negative): interval of the mean of each group's finite values, drawn with replacement.

    Draw b takes, for each place i below n, the value whose rank by (value, ties) is random_number(seed, b, i) modulo n. A
    draw is the sum of n rows that meet their values by group and rank, so no group is one task's and any engine can
    repeat it; it costs draws * n rows, as resampling does. Groups without a finite value have nulls and n = 0.
    """
    rows = df.select(*groups, finite(F.col(value).cast("double")).alias("value__"), *ties)
    ranked = cut(ranked_within(rows.where("value__ is not null"), groups, ["value__", *ties], "rank__", "size__").select(*groups, "rank__", "size__", "value__"))
    sizes = ranked.groupBy(*groups).agg(F.max("size__").alias("n"), F.avg("value__").alias("mean"))
    drawn = sizes.select(*groups, "n", _draws(1, draws).alias("draw__")).select(*groups, "n", "draw__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("place__")) \
        .select(*groups, "draw__", F.pmod(random_number(seed, F.col("draw__"), F.col("place__")), F.col("n")).alias("rank__"))
    means = cut(_same(drawn.groupBy(*groups, "rank__", "draw__").agg(F.count(F.lit(1)).alias("times__")), ranked, [*groups, "rank__"])
                .select(*[F.col(f"a.{g}") for g in groups], "a.draw__", "a.times__", "b.value__")
                .groupBy(*groups, "draw__").agg((F.sum(F.col("times__") * F.col("value__")) / F.sum("times__")).alias("mean__")))
    found = _same(sizes, _interval(means, groups, "mean__", level), groups).select(*[F.col(f"a.{g}") for g in groups], "a.n", "a.mean", "b.low", "b.high", "b.share_negative")
    everyone = df.select(*groups).distinct()
    return _same(everyone, found, groups, "left").select(*[F.col(f"a.{g}") for g in groups], F.coalesce("b.n", F.lit(0)).alias("n"), "b.mean", "b.low", "b.high", "b.share_negative")


def hierarchical_bootstrap(df: DataFrame, groups: list[str], outer: str, value: str, ties: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(groups, mean, low, high): interval of the mean of outer means; outer groups are drawn, then values within each drawn one.

    Draw b takes as its i-th outer group the one whose rank is random_number(seed, b, i) modulo their number, and as that
    one's j-th value the one whose rank is random_number(seed + 1 + i, b, j) modulo its size. As in bootstrap_mean(), the
    drawn rows meet their values by rank. Null and non-finite values are left out; a group without any has nulls.
    """
    rows = df.select(*groups, F.col(outer).alias("outer__"), finite(F.col(value).cast("double")).alias("value__"), *ties).where("value__ is not null and outer__ is not null")
    inner = [*groups, "outer__"]
    ranked = cut(ranked_within(rows, inner, ["value__", *ties], "rank__", "size__").select(*inner, "rank__", "size__", "value__"))
    sizes = ranked.groupBy(*inner).agg(F.max("size__").alias("size__"), F.avg("value__").alias("own__"))
    outers = cut(ranked_within(sizes, groups, ["outer__"], "turn__", "turns__"))
    means = outers.groupBy(*groups).agg(F.avg("own__").alias("mean"), F.max("turns__").alias("turns__"))
    chosen = means.select(*groups, "turns__", _draws(1, draws).alias("draw__")).select(*groups, "turns__", "draw__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns__") - 1)).alias("place__")) \
        .select(*groups, "draw__", "place__", F.pmod(random_number(seed, F.col("draw__"), F.col("place__")), F.col("turns__")).alias("turn__"))
    asked = _same(chosen, outers, [*groups, "turn__"]).select(*[F.col(f"a.{g}") for g in groups], "a.draw__", "a.place__", "b.outer__", "b.size__")
    drawn = asked.select(*inner, "draw__", "place__", "size__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size__") - 1)).alias("spot__")) \
        .select(*inner, "draw__", "place__", F.pmod(random_number(F.lit(seed + 1) + F.col("place__"), F.col("draw__"), F.col("spot__")), F.col("size__")).alias("rank__"))
    values = _same(drawn, ranked, [*inner, "rank__"]).select(*[F.col(f"a.{g}") for g in groups], "a.draw__", "a.place__", "b.value__")
    each = cut(values.groupBy(*groups, "draw__", "place__").agg(F.avg("value__").alias("m__")).groupBy(*groups, "draw__").agg(F.avg("m__").alias("mean__")))
    found = _same(means, _interval(each, groups, "mean__", level), groups).select(*[F.col(f"a.{g}") for g in groups], "a.mean", "b.low", "b.high")
    everyone = df.select(*groups).distinct() if groups else df.limit(1).select(F.lit(1).alias("one__")).drop("one__")
    return _same(everyone, found, groups, "left").select(*[F.col(f"a.{g}") for g in groups], "b.mean", "b.low", "b.high")


#: Edges of the Poisson distribution with mean one, as shares of 2**31: a number above k of them stands for k draws or more.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 31)) for k in range(9))


def point_bootstrap(df: DataFrame, id_col: str, truth: list[str], a: list[str], b: list[str], sight: list[str], weight: Column | None = None, draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row of intervals of nrmse(a) - nrmse(b), of whole vectors and of their parts along sight, when points are drawn anew.

    Columns delta_<part>_mean, _low, _high and share_a_better_<part> for the parts 3d and radial. How often draw d takes a
    point is Poisson with mean one, fixed by seed, d and id (random_number()), which stands for drawing with replacement
    where there are many points. Each row carries its counts of all draws as one vector; what is summed over rows is one
    vector of six sums for each draw, first in tasks, then over tasks. Null or non-finite entries leave a point out.
    """
    good = df
    for c in [*truth, *a, *b, *sight]:
        good = good.where(finite(F.col(c)).isNotNull())
    w = F.lit(1.0) if weight is None else weight
    length = norm([F.col(c) for c in sight])
    along = lambda v: F.try_divide(dot([F.col(c) for c in v], [F.col(c) for c in sight]), length)
    off = lambda p: sum(((F.col(x) - F.col(t)) ** 2 for x, t in zip(p, truth)), F.lit(0.0))
    terms = [off(a), off(b), sum((F.col(t) ** 2 for t in truth), F.lit(0.0)), (along(a) - along(truth)) ** 2, (along(b) - along(truth)) ** 2, along(truth) ** 2]
    stats = good.select(F.col(id_col).cast("long").alias("id__"), F.transform(F.array(*terms), lambda t: F.coalesce(t * w, F.lit(0.0))).alias("t__"))
    times = lambda u: sum((F.when(u >= edge, 1.0).otherwise(0.0) for edge in POISSON), F.lit(0.0))
    counts = F.transform(random_numbers(seed, F.sequence(F.lit(1), F.lit(draws)), F.col("id__")), times)
    # One after the other: counts of all draws times the first term, times the second, ...
    flat = F.flatten(F.transform("t__", lambda t: F.transform("k__", lambda k: k * t)))
    counted = stats.select("t__", F.explode(F.array(counts)).alias("k__"))  # one row each: keeps the counts from being made again for each term
    sums = counted.select(array_to_vector(flat).alias("v")).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("v")).where("n > 0").select(vector_to_array("v").alias("v"))
    at = lambda k: F.get("v", F.lit(k * draws) + F.col("d"))
    root = lambda k, t: F.sqrt(F.try_divide(at(k), at(t)))
    gaps = cut(sums.select("v", _draws(0, draws - 1).alias("d")).select((root(0, 2) - root(1, 2)).alias("d3d"), (root(3, 5) - root(4, 5)).alias("radial")))
    out = None
    for name, column in (("3d", "d3d"), ("radial", "radial")):
        found = _interval(gaps, [], column, level).crossJoin(gaps.agg(F.avg(column).alias("mean")))
        found = found.select(F.col("mean").alias(f"delta_{name}_mean"), F.col("low").alias(f"delta_{name}_low"), F.col("high").alias(f"delta_{name}_high"), F.col("share_negative").alias(f"share_a_better_{name}"))
        out = found if out is None else out.crossJoin(F.broadcast(found))
    return out
