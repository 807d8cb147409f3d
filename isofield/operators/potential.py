"""Designs of potential flows from mode gradients, their scores, and audits of bases.

Mode gradients are an array of structs (x, y, z), one for each mode; coefficients are a plain list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.functions.columns import line_of_sight
from isofield.operators.regression import gram, grid_coefficients, grid_scores
from isofield.operators.relational import numbered, quantiles

AXES = ("x", "y", "z")


def radial_design(position: list[Column], gradients: Column) -> Column:
    """Component of every mode gradient along the line of sight."""
    n = line_of_sight(position)
    return F.transform(gradients, lambda g: g["x"] * n[0] + g["y"] * n[1] + g["z"] * n[2])


def with_affine(gradients: Column, scale: float) -> Column:
    """Gradients with those of the three scaled affine functions in front."""
    unit = lambda k: F.struct(*[F.lit(scale if j == k else 0.0).alias(a) for j, a in enumerate(AXES)])
    return F.concat(F.array(*[unit(k) for k in range(3)]), gradients)


def affine_scale(df: DataFrame, design: str) -> float:
    """Median over modes of the root mean square of a design column."""
    modes = df.select(F.posexplode(design).alias("mode", "v")).groupBy("mode").agg(F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"))
    return float(modes.agg(F.percentile("rms", F.lit(0.5))).first()[0] or 1.0)


def remove_affine(df: DataFrame, position: list[str], design: str, name: str = "design") -> DataFrame:
    """df with the part of every design column that the line of sight explains taken out.

    The projection needs one aggregate of three numbers for each mode, and a 3 x 3 system.
    """
    n = line_of_sight([F.col(c) for c in position])
    los = df.withColumns({f"n__{a}": c for a, c in zip(AXES, n)})
    row = los.agg(*[F.sum(F.col(f"n__{a}") * F.col(f"n__{b}")).alias(f"{a}{b}") for a in AXES for b in AXES]).first()
    square = np.array([[row[f"{a}{b}"] for b in AXES] for a in AXES])
    cross = los.select(*[f"n__{a}" for a in AXES], F.posexplode(design).alias("mode", "v")).groupBy("mode") \
        .agg(*[F.sum(F.col(f"n__{a}") * F.col("v")).alias(a) for a in AXES]).orderBy("mode").collect()
    beta = np.linalg.lstsq(square, np.array([[r[a] for a in AXES] for r in cross]).T, rcond=None)[0]
    part = [F.array(*[F.lit(float(v)) for v in beta[k]]) for k in range(3)]
    fixed = F.transform(design, lambda v, i: v - F.col("n__x") * F.get(part[0], i) - F.col("n__y") * F.get(part[1], i) - F.col("n__z") * F.get(part[2], i))
    return los.withColumn(name, fixed).drop(*[f"n__{a}" for a in AXES])


def velocity(gradients: Column, theta: list[float]) -> list[Column]:
    """Velocity of a potential: the mode gradients times their coefficients."""
    t = F.array(*[F.lit(float(v)) for v in theta])
    part = lambda a: F.aggregate(F.zip_with(F.slice(gradients, 1, len(theta)), t, lambda g, c: g[a] * c), F.lit(0.0), lambda s, v: s + v)
    return [part(a) for a in AXES]


def component_rows(df: DataFrame, id_col: str, gradients: str, target: list[str]) -> DataFrame:
    """Three rows for each point, one for each component: (id, component, design, target)."""
    along = lambda a: F.transform(gradients, lambda g: g[a])
    parts = F.array(*[F.struct(F.lit(k).alias("component"), along(a).alias("design"), F.col(t).alias("target")) for k, (a, t) in enumerate(zip(AXES, target))])
    return df.select(id_col, F.explode(parts).alias("r")).select(id_col, "r.component", "r.design", "r.target")


def quadratic_nrmse(theta: np.ndarray, g: np.ndarray, r: np.ndarray, target_square: float) -> float:
    """Normalised error of a fit from its Gram matrix, right-hand side and mean square of the target."""
    n = len(theta)
    return float(np.sqrt(max(0.0, theta @ g[:n, :n] @ theta - 2 * theta @ r[:n] + target_square) / target_square)) if target_square > 0 else float("nan")


def profile_nrmse(truth: Column, predicted: Column, profile: Column) -> Column:
    """Normalised error with rows weighted by the inverse square of their error profile."""
    w = 1 / (profile * profile)
    return F.sqrt(F.try_divide(F.sum(w * (predicted - truth) ** 2), F.sum(w * truth * truth)))


def standard_residual(truth: Column, predicted: Column, sigma: Column) -> Column:
    return F.sqrt(F.avg(F.try_divide(predicted - truth, sigma) ** 2))


def reduced_chi_square(truth: Column, predicted: Column, sigma: Column, freedom: float) -> Column:
    return F.try_divide(F.sum(F.try_divide(predicted - truth, sigma) ** 2), F.count(F.lit(1)) - F.lit(freedom))


def orthogonality(df: DataFrame, modes: str, mass: Column) -> DataFrame:
    """(i, j, product) of mode values under a measure: tasks send blocks of sums, never products of single rows."""
    g, _, total = gram(df.withColumn("zero__", F.lit(0.0)), modes, "zero__", mass)
    i, j = np.triu_indices(len(g))
    return df.sparkSession.createDataFrame(pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "product": (g * total)[i, j]}), "i int, j int, product double")


def vector_grid(train: DataFrame, validation: DataFrame, id_col: str, gradients: str, target: list[str], generator: np.ndarray, sizes: list[int], strengths: list[float], powers: list[float]) -> DataFrame:
    """Scores of fits to whole vectors, the bound that a fit to radial parts can be held against; as regression.grid_scores."""
    rows = component_rows(train, id_col, gradients, target)
    g, r, _ = gram(rows, "design", "target")
    return grid_scores(component_rows(validation, id_col, gradients, target), "design", "target", grid_coefficients(g, r, generator, sizes, strengths, powers))


def thin(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row of a total order."""
    return numbered(df, order, "at__").where(F.col("at__") % step == 0).drop("at__")


def robust_scaled(df: DataFrame, value: str, quantile: float = 0.99) -> DataFrame:
    """df with value over a high quantile of its size, clipped to [-1, 1]."""
    top = quantiles(df.select(F.abs(value).alias("size__")), [], "size__", [quantile]).select(F.get("quantiles", F.lit(0)).alias("top__"))
    return df.crossJoin(F.broadcast(top)).withColumn("scaled", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(value), F.col("top__"))))).drop("top__")


def slab(df: DataFrame, axis: str, half_width: float, candidates: list[float]) -> DataFrame:
    """Rows of the slab with most rows among slabs about the candidate positions, ties to the smallest position."""
    hits = df.select(F.explode(F.filter(F.array(*map(F.lit, candidates)), lambda c: F.abs(F.col(axis) - c) <= half_width)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    best = hits.agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("c__"))
    return df.crossJoin(F.broadcast(best)).where(F.abs(F.col(axis) - F.col("c__")) <= half_width).drop("c__")


def analytic_potential(x: Column, y: Column, z: Column) -> tuple[Column, list[Column]]:
    """A smooth potential and its gradient, for tests of gradients."""
    phi = F.sin(x) * F.cos(y) + F.lit(0.5) * z * z
    return phi, [F.cos(x) * F.cos(y), -F.sin(x) * F.sin(y), z]


def first_mode_constant(df: DataFrame, modes: str) -> DataFrame:
    """The mode with the smallest deviation over its mean size: the constant one."""
    long = df.select(F.posexplode(modes).alias("mode", "v")).groupBy("mode").agg(F.stddev_pop("v").alias("s"), F.avg(F.abs("v")).alias("m"))
    w = Window.orderBy("ratio", "mode")  # one row for each mode
    return long.select("mode", F.try_divide(F.col("s"), F.col("m")).alias("ratio")).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")

