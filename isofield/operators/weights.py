"""Selection probabilities, inverse weights, splits and noise profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isofield.functions.columns import clip, finite, interpolate, order_hash
from isofield.operators.relational import numbered, quantiles, ranked_within
from isofield.operators.summaries import effective_size


def limit_magnitude(apparent_limit: Column, distance: Column, hubble: float = 1.0) -> Column:
    """Absolute magnitude at the limit of an apparent one; distances in Mpc over the Hubble parameter."""
    return apparent_limit - F.lit(5.0) * F.log10(distance / F.lit(hubble)) - F.lit(25.0)


def selection_probability(limit: Column, grid: list[float], cdf: list[float]) -> Column:
    """Share of the luminosity function brighter than a limit: 0 at its bright end, 1 at its faint end."""
    return clip(interpolate(limit, grid, cdf), 0.0, 1.0)


def mean_probability(distance: Column, limits: list[float], grid: list[float], cdf: list[float], hubble: float = 1.0) -> Column:
    """Mean of the selection probabilities that a distance has under each regional limit."""
    curves = [selection_probability(limit_magnitude(F.lit(float(m)), distance, hubble), grid, cdf) for m in limits]
    return sum(curves[1:], curves[0]) / F.lit(float(len(curves)))


def probability_by_mode(mode: str, regional: Column, everywhere: Column) -> Column:
    """The selection probability that a model assumes: 1 ("none"), one curve for all ("global") or the region's ("region")."""
    known = {"none": F.lit(1.0), "global": everywhere, "region": regional}
    if mode not in known:
        raise ValueError(f"mode {mode} is none of {sorted(known)}")
    return known[mode]


def weight_report(df: DataFrame, probability: str, weight: str) -> DataFrame:
    """One row: least and median probability, largest weight over the mean, effective size and its share of the rows."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.min(probability).alias("probability_min"), (F.max(weight) / F.avg(weight)).alias("weight_max"),
                  effective_size(F.col(weight)).alias("effective"))
    return sums.crossJoin(F.broadcast(quantiles(df.select(probability), [], probability, [0.5]))).select(
        "n", "probability_min", F.get("quantiles", F.lit(0)).alias("probability_median"), "weight_max", "effective", F.try_divide("effective", "n").alias("effective_share"))


def inverse_weights(df: DataFrame, probability: str, power: float = 1.0, floor: float = 1e-3, most: float = 50.0, quantile: float = 0.995) -> DataFrame:
    """df with weight = min(p ** -power, cap) over its mean; the cap is the smaller of most and a quantile. Power 0 gives ones.

    The two scalars come from two aggregates of one row.
    """
    if power == 0:
        return df.withColumn("weight", F.lit(1.0))
    raw = df.withColumn("raw__", F.pow(F.greatest(F.col(probability), F.lit(floor)), F.lit(-power)))
    cap = quantiles(raw.select("raw__"), [], "raw__", [quantile]).select(F.least(F.lit(most), F.get("quantiles", F.lit(0))).alias("cap__"))
    capped = raw.crossJoin(F.broadcast(cap)).withColumn("capped__", F.least("raw__", "cap__"))
    mean = raw.crossJoin(F.broadcast(cap)).agg(F.avg(F.least("raw__", "cap__")).alias("mean__"))
    return capped.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("capped__") / F.col("mean__")).drop("raw__", "cap__", "capped__", "mean__")


def split(df: DataFrame, id_col: str, seed: int, train: float, validation: float, groups: list[str] | None = None) -> DataFrame:
    """df with a split by hash order; sizes are rounded half to even, within each group where groups are named.

    Ranks come from a range sort, so that no task sees all rows of the table or of a group. With groups, a group of fewer
    than three rows is an error, and where training and validation would take all rows of a group, validation gives way
    so that one row is left for the test (but keeps one row itself).
    """
    keyed = df.withColumn("order__", order_hash(F.col(id_col), seed))
    if groups:
        if df.groupBy(*groups).count().where("count < 3").limit(1).count():
            raise ValueError(f"a group of {groups} has fewer than three rows")
        ranked = ranked_within(keyed, groups, ["order__", id_col], "rank__", "n__")
    else:
        total = df.agg(F.count(F.lit(1)).alias("n__"))
        ranked = numbered(keyed, ["order__", id_col], "rank__").crossJoin(F.broadcast(total))
    a = F.bround(F.lit(train) * F.col("n__")).cast("long")
    b = F.bround(F.lit(validation) * F.col("n__")).cast("long")
    if groups:
        b = F.when(a + b >= F.col("n__"), F.greatest(F.lit(1), F.col("n__") - a - 1)).otherwise(b)
    name = F.when(F.col("rank__") < a, "train").when(F.col("rank__") < a + b, "validation").otherwise("test")
    return ranked.withColumn("split", name).drop("order__", "n__", "rank__")


def error_profile(df: DataFrame, radius: str, reference: float, contrast: float, power: float, train: Column) -> DataFrame:
    """df with profile = 1 + (contrast - 1) clip(r / reference, 0, 1) ** power, scaled to unit mean square on training rows."""
    raw = F.lit(1.0) + F.lit(contrast - 1) * F.pow(clip(F.col(radius) / F.lit(reference), 0.0, 1.0), F.lit(power))
    with_raw = df.withColumn("raw__", raw)
    scale = with_raw.agg(F.sqrt(F.avg(F.when(train, F.col("raw__") ** 2))).alias("scale__"))
    return with_raw.crossJoin(F.broadcast(scale)).withColumn("profile", F.col("raw__") / F.col("scale__")).drop("raw__", "scale__")


def working_profiles(df: DataFrame, profile: str, train: Column, flatness: float = 0.5) -> DataFrame:
    """df with what three models take for a profile: profile_correct, profile_flattened (its power) and profile_constant.

    Each has unit mean square on the training rows; one aggregate of one row gives all scales.
    """
    raw = {"profile_correct": F.col(profile), "profile_flattened": F.pow(F.col(profile), F.lit(flatness)), "profile_constant": F.lit(1.0)}
    scales = df.agg(*[F.sqrt(F.avg(F.when(train, r * r))).alias(f"{n}__") for n, r in raw.items()])
    scaled = df.crossJoin(F.broadcast(scales)).withColumns({n: F.try_divide(r, F.col(f"{n}__")) for n, r in raw.items()})
    return scaled.drop(*[f"{n}__" for n in raw])


def support_masks(queries: DataFrame, catalog: DataFrame, region: str, distance: str, spacing: str, probability: str, radius: float, bandwidth: float,
                  least: tuple[float, float] = (1e-3, 1e-2), factor: float = 1.5) -> DataFrame:
    """queries with extended, strict and primary: where the catalog supports an estimate.

    A query needs a selection probability (the first of least for extended, the second for strict), a spacing up to factor
    times the catalog's 95 % quantile and a distance up to the 99.5 % quantile of its region. Primary ones are strict and
    at least a bandwidth inside the radius. A query of a region that the catalog lacks, or with a null, has no support.
    """
    limits = quantiles(catalog, [region], distance, [0.995], "limit__")
    reach = quantiles(catalog.select(spacing), [], spacing, [0.95], "reach__")
    known = queries.join(limits, region, "left").crossJoin(F.broadcast(reach))
    near = (F.col(spacing) <= F.lit(factor) * F.get("reach__", F.lit(0))) & (F.col(distance) <= F.get("limit__", F.lit(0)))
    masks = {"extended": near & (F.col(probability) >= least[0]), "strict": near & (F.col(probability) >= least[1])}
    masks["primary"] = masks["strict"] & (F.col(distance) <= radius - bandwidth)
    return known.withColumns({n: F.coalesce(m, F.lit(False)) for n, m in masks.items()}).drop("limit__", "reach__")


def add_noise(df: DataFrame, id_col: str, value: str, profile: str, fraction: float, rms: float, seeds: list[int]) -> DataFrame:
    """df once for each seed with noisy = value + fraction * rms * profile * N(0, 1), the draw fixed by seed and id.

    A fraction of 0 gives the values once, unchanged, under the first seed.
    """
    if fraction == 0:
        return df.withColumn("realisation", F.lit(seeds[0])).withColumn("noisy", F.col(value))
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), "realisation", id_col), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    return df.withColumn("realisation", F.explode(F.array(*map(F.lit, seeds)))).withColumn("noisy", F.col(value) + F.lit(fraction * rms) * F.col(profile) * normal)


#: Fixed values of the luminosity fit: knees and slopes to start from, and the bounds of both.
STARTS = ((-22.1, -1.1), (-21.5, -0.8), (-22.7, -1.4))
BOUNDS = ((-24.0, -18.0), (-2.5, 0.5))


def bounded_newton(loss, start: tuple[float, ...], bounds: tuple[tuple[float, float], ...], rounds: int, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """(point, loss) of a quasi-Newton search within bounds; loss(p) gives a value and its gradient.

    The inverse curvature is updated from steps and gradients (BFGS). Parameters that stand at a bound and would leave it
    are held; steps are cut back to the bounds and halved until the value falls enough.
    """
    low, high = np.array(bounds, float).T
    at = np.clip(np.array(start, float), low, high)
    value, slope = loss(at)
    curve, scale = np.eye(len(at)), True
    for _ in range(rounds):
        held = ((at <= low) & (slope > 0)) | ((at >= high) & (slope < 0))
        free = ~held
        if not free.any() or np.abs(slope[free]).max() <= 1e-9 * max(1.0, abs(value)):
            break
        way = np.zeros_like(at)
        way[free] = -curve[np.ix_(free, free)] @ slope[free]
        if way @ slope >= 0:
            way = np.where(free, -slope, 0.0)
        if scale:
            way /= max(1.0, np.abs(way).max() / 0.1)
        step, before = 1.0, value
        while step > 1e-12:
            to = np.clip(at + step * way, low, high)
            new, turned = loss(to)
            if np.isfinite(new) and new <= value + 1e-4 * (slope @ (to - at)):
                break
            step /= 2
        else:
            break
        moved, bent = to - at, turned - slope
        at, value, slope, scale = to, new, turned, False
        if moved @ bent > 1e-14 * np.linalg.norm(moved) * np.linalg.norm(bent):
            r = 1 / (moved @ bent)
            left = np.eye(len(at)) - r * np.outer(moved, bent)
            curve = left @ curve @ left.T + r * np.outer(moved, moved)
        if before - value <= tolerance * max(1.0, abs(value)):
            break
    return at, value


def fit_luminosity(df: DataFrame, magnitude: str, limit: str, bright: float, faint: float, start: tuple[float, float] | None = None,
                   rounds: int = 200, points: int = 4096, bounds: tuple[tuple[float, float], ...] = BOUNDS) -> tuple[float, float, float]:
    """(knee, slope, negative log likelihood) of a truncated luminosity function; the best of three bounded searches.

    Every row has its own limit, the smaller of `limit` and faint, so the rows of several regions are fitted together. A
    row brighter than bright (by over 1e-8) or fainter than its limit (by over 1e-7) is an error, as is a table without
    rows; rows with a null or non-finite magnitude or limit are left out.

    The normaliser is a trapezoid table of `points` magnitudes, read between its points by each row's own place. What the
    likelihood and its gradient need of the rows is their number, two sums of magnitudes, and for each cell of the table
    the number, mean and spread of the places in it, so a fit costs one pass however long the searches: the log of the
    normaliser within a cell is taken about the mean place to second order. start names a single start in place of three.
    """
    grid = np.linspace(bright, faint, points)
    width = (faint - bright) / (points - 1)
    rows = df.select(finite(F.col(magnitude)).alias("m"), finite(F.col(limit)).alias("l")).where("m is not null and l is not null").withColumn("l", F.least("l", F.lit(float(faint))))
    place = (F.col("l") - bright) / width
    cell = F.greatest(F.lit(0), F.least(F.lit(points - 2), F.floor(place)))
    cells = rows.select("m", "l", cell.cast("int").alias("cell"), (place - cell).alias("part")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("part").alias("mean"), F.var_pop("part").alias("spread"), F.sum("m").alias("sum"), F.sum(F.pow(F.lit(10.0), F.lit(-0.4) * (F.col("m") - bright))).alias("flux"),
        F.min("m").alias("least"), F.max(F.col("m") - F.col("l")).alias("over")).toPandas().sort_values("cell")
    if not len(cells):
        raise ValueError("no rows to fit")
    if cells["least"].min() < bright - 1e-8:
        raise ValueError(f"a magnitude is brighter than {bright}")
    if cells["over"].max() > 1e-7:
        raise ValueError("a magnitude is fainter than its limit")
    at, n, part, spread = (cells[c].to_numpy() for c in ("cell", "n", "mean", "spread"))
    total, sum_m, flux = n.sum(), cells["sum"].sum(), cells["flux"].sum()
    log10 = np.log(10.0)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        knee, slope = p
        x = 0.4 * (knee - grid)
        shape = (slope + 1) * x * log10 - 10 ** x
        top = shape.max()
        density = np.exp(shape - top)
        by = np.stack([density, density * (0.4 * log10 * ((slope + 1) - 10 ** x)), density * x * log10])  # itself and its slopes in knee and slope
        area = np.concatenate([np.zeros((3, 1)), np.cumsum((by[:, 1:] + by[:, :-1]) / 2 * width, axis=1)], axis=1)
        base, step = area[:, at], area[:, at + 1] - area[:, at]
        norm = base + part * step
        if not (norm[0] > 0).all():
            return 1e100, np.zeros(2)
        bend = step[0] / norm[0]
        log_norm = (n * (np.log(norm[0]) - bend ** 2 * spread / 2)).sum() + total * top
        turned = np.array([(n * (norm[k] / norm[0] - spread * bend * (step[k] / norm[0] - bend * norm[k] / norm[0]))).sum() for k in (1, 2)])
        # Sums over rows of the log of the shape and of its slopes, from their sums of magnitudes and fluxes.
        sum_x = 0.4 * (total * knee - sum_m)
        sum_power = flux * 10 ** (0.4 * (knee - bright))
        own = (slope + 1) * log10 * sum_x - sum_power
        lean = np.array([0.4 * log10 * ((slope + 1) * total - sum_power), log10 * sum_x])
        return float(log_norm - own), turned - lean  # the constant factor of the shape cancels

    found = [bounded_newton(loss, s, bounds, rounds) for s in ([start] if start else STARTS)]
    best, value = min(found, key=lambda f: f[1])
    return float(best[0]), float(best[1]), value
