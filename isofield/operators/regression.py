"""Weighted Gram matrices by blocks, ridge fits over grids, predictions and their variances.

Rows live in a DataFrame with a design array; only matrices of the size of the basis reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isofield.operators.spectral import triangle, triangle_rows

#: Columns of a block of the Gram matrix: what one task holds is a block's square.
BLOCK = 512


def gram(rows: DataFrame, design: str, target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'WX / sum w, X'Wy / sum w, sum w).

    Each task adds up its rows by pairs of column blocks and sends one row for each pair; pairs are then summed by key.
    """
    first = rows.select(F.size(design).alias("m")).first()
    if first is None:
        return np.zeros((0, 0)), np.zeros(0), 0.0
    m = first["m"]
    edges = list(range(0, m, BLOCK))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        total = 0.0
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(-1, m)
            y, w = batch["y"].to_numpy(float), batch["w"].to_numpy(float)
            total += w.sum()
            for i in edges:
                left = (x[:, i:i + BLOCK] * w[:, None]).T
                sums[i, -1] = sums.get((i, -1), 0) + left @ y
                for j in edges:
                    if j >= i:
                        sums[i, j] = sums.get((i, j), 0) + left @ x[:, j:j + BLOCK]
        sums[-1, -1] = np.array([total])
        yield pd.DataFrame([(i, j, v.ravel().tobytes()) for (i, j), v in sums.items()], columns=["i", "j", "v"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, np.sum([np.frombuffer(v) for v in part["v"]], axis=0).tobytes())], columns=["i", "j", "v"])

    w = F.lit(1.0) if weight is None else weight
    blocks = rows.select(F.col(design).alias("x"), F.col(target).cast("double").alias("y"), w.cast("double").alias("w")) \
        .mapInPandas(partial, "i int, j int, v binary").groupBy("i", "j").applyInPandas(add, "i int, j int, v binary")
    g, r, total = np.zeros((m, m)), np.zeros(m), 0.0
    for i, j, v in blocks.toLocalIterator():
        v = np.frombuffer(v)
        if i < 0:
            total = float(v[0])
        elif j < 0:
            r[i:i + BLOCK] = v
        else:
            block = v.reshape(len(g[i:i + BLOCK]), -1)
            g[i:i + BLOCK, j:j + BLOCK] = block
            g[j:j + BLOCK, i:i + BLOCK] = block.T
    return g / total, r / total, total


def penalty(generator: np.ndarray, power: float, ridge: float = 1e-12, free_zero: bool = True) -> np.ndarray:
    """Penalty of each mode: its generator to a power. Zero modes go free, or are penalised by the ridge constant alone."""
    floored = np.maximum(generator, ridge)
    return np.where(generator > 0, floored ** power, 0.0) if free_zero else floored


def factor(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor, with growing jitter on the diagonal where the matrix is not positive."""
    scale = float(np.median(np.abs(np.diag(matrix)))) or 1.0
    for jitter in (0.0, 1e-14, 1e-13, 1e-12, 1e-11, 1e-10, 1e-9, 1e-8):
        try:
            return np.linalg.cholesky(matrix + jitter * scale * np.eye(len(matrix)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("the system is not positive definite")


def solve(g: np.ndarray, r: np.ndarray, diagonal: np.ndarray, strength: float, ridge: float = 1e-12) -> np.ndarray:
    lower = factor(g + np.diag(strength * diagonal + ridge))
    return np.linalg.solve(lower.T, np.linalg.solve(lower, r))


def grid_coefficients(g: np.ndarray, r: np.ndarray, generator: np.ndarray, sizes: list[int], strengths: list[float], powers: list[float], ridge: float = 1e-12) -> list[dict]:
    """Solutions of every nested basis for every strength and power, one factorisation for each pair.

    The leading block of a Cholesky factor is the factor of the leading block.
    """
    out = []
    for power in powers:
        diagonal = penalty(generator, power, ridge)
        for strength in strengths:
            lower = factor(g + np.diag(strength * diagonal + ridge))
            forward = np.linalg.solve(lower, r)
            for n in sizes:
                theta = np.linalg.solve(lower[:n, :n].T, forward[:n])
                out.append({"n_basis": n, "strength": strength, "power": power, "theta": theta.tolist()})
    return out


def grid_scores(rows: DataFrame, design: str, target: str, grid: list[dict], weight: Column | None = None) -> DataFrame:
    """(candidate, n_basis, strength, power, nrmse) of every candidate over the rows, by sums of each task."""
    width = max(len(c["theta"]) for c in grid)
    theta = np.array([c["theta"] + [0.0] * (width - len(c["theta"])) for c in grid]).T

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        error, square = np.zeros(theta.shape[1]), 0.0
        for batch in batches:
            y, w = batch["y"].to_numpy(float), batch["w"].to_numpy(float)
            gap = np.array(batch["x"].tolist(), float)[:, :width] @ theta - y[:, None]
            error += w @ (gap * gap)
            square += w @ (y * y)
        yield pd.DataFrame({"candidate": np.arange(theta.shape[1]), "error": error, "square": square})

    w = F.lit(1.0) if weight is None else weight
    sums = rows.select(F.col(design).alias("x"), F.col(target).cast("double").alias("y"), w.cast("double").alias("w")).mapInPandas(partial, "candidate long, error double, square double")
    labels = rows.sparkSession.createDataFrame([(k, c["n_basis"], float(c["strength"]), float(c["power"])) for k, c in enumerate(grid)], "candidate long, n_basis int, strength double, power double")
    return sums.groupBy("candidate").agg(F.sqrt(F.try_divide(F.sum("error"), F.sum("square"))).alias("nrmse")).join(F.broadcast(labels), "candidate")


def vector_coefficients(rows: DataFrame, design: str, targets: list[str], generator: np.ndarray, sizes: list[int], strengths: list[float], powers: list[float], weight: Column | None = None, ridge: float = 1e-12) -> list[dict]:
    """grid_coefficients() for several targets at once: one pass, and one factor for each strength and power serves all of them."""
    g, _, _, right = _gram_of_many(rows, design, targets, weight)
    out = []
    for power in powers:
        diagonal = penalty(generator[:len(g)], power, ridge)
        for strength in strengths:
            lower = factor(g + np.diag(strength * diagonal + ridge))
            forward = np.linalg.solve(lower, right)
            out += [{"n_basis": n, "strength": strength, "power": power, "theta": np.linalg.solve(lower[:n, :n].T, forward[:n])} for n in sizes]
    return out


def _gram_of_many(rows: DataFrame, design: str, targets: list[str], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(Gram matrix, squares of targets, sum of weights, right-hand sides), the matrices over the sum of weights."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weights = 0.0, 0.0
        for batch in batches:
            both = np.column_stack([np.array(batch["x"].tolist(), float), np.array(batch["y"].tolist(), float)])
            w = batch["w"].to_numpy(float)
            total = total + both.T @ (both * w[:, None])
            weights += w.sum()
        if not np.isscalar(total):
            yield pd.DataFrame({"g": [np.concatenate([[weights], total.ravel()])]})

    w = F.lit(1.0) if weight is None else weight
    sums = rows.select(F.col(design).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"), w.cast("double").alias("w")).mapInPandas(partial, "g array<double>") \
        .agg(Summarizer.sum(array_to_vector("g")).alias("g")).first()["g"]
    if sums is None or not len(sums):
        raise ValueError("no rows to fit")
    weights, m = sums[0], round((len(sums) - 1) ** 0.5)
    g = np.array(sums.toArray()[1:]).reshape(m, m) / weights
    k = m - len(targets)
    return g[:k, :k], np.diag(g)[k:], float(weights), g[:k, k:]


def vector_scores(rows: DataFrame, design: str, targets: list[str], grid: list[dict], weight: Column | None = None) -> DataFrame:
    """(candidate, n_basis, strength, power, nrmse) of candidates with a column of coefficients for each target, over whole vectors."""
    width = max(len(c["theta"]) for c in grid)
    theta = np.zeros((len(grid), width, len(targets)))
    for k, c in enumerate(grid):
        theta[k, :len(c["theta"])] = c["theta"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        error, square = np.zeros(len(grid)), 0.0
        for batch in batches:
            x, y, w = np.array(batch["x"].tolist(), float).reshape(len(batch), -1)[:, :width], np.array(batch["y"].tolist(), float).reshape(len(batch), -1), batch["w"].to_numpy(float)
            for k in range(len(grid)):
                error[k] += w @ ((x @ theta[k] - y) ** 2).sum(1)
            square += w @ (y * y).sum(1)
        yield pd.DataFrame({"candidate": np.arange(len(grid)), "error": error, "square": square})

    w = F.lit(1.0) if weight is None else weight
    sums = rows.select(F.col(design).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"), w.cast("double").alias("w")).mapInPandas(partial, "candidate long, error double, square double")
    labels = rows.sparkSession.createDataFrame([(k, c["n_basis"], float(c["strength"]), float(c["power"])) for k, c in enumerate(grid)], "candidate long, n_basis int, strength double, power double")
    return sums.groupBy("candidate").agg(F.sqrt(F.try_divide(F.sum("error"), F.sum("square"))).alias("nrmse")).join(F.broadcast(labels), "candidate")


def least_squares(rows: DataFrame, design: str, targets: list[str], weight: Column | None = None, least: float = 1e-12) -> dict:
    """Unpenalised least squares without a Gram matrix: {"theta" (columns for targets), "rank", "residual" (norms)}.

    Each task reduces its rows of [design, targets] to a triangular factor, groups of tasks reduce those, and the driver the
    few that are left, so the condition of the design is not squared. Directions whose singular value is at most `least`
    of the largest are left out: of all best solutions the shortest is returned.
    """
    w = F.lit(1.0) if weight is None else weight
    both = F.concat(F.transform(design, lambda v: v.cast("double")), F.array(*[F.col(t).cast("double") for t in targets]))
    block = rows.select(F.lit(0).cast("long").alias("id"), F.transform(both, lambda v: v * F.sqrt(w)).alias("v"))
    r = triangle(triangle_rows(block).collect())
    if not r.size:
        raise ValueError("no rows to fit")
    k = r.shape[1] - len(targets)
    u, s, t = np.linalg.svd(r[:, :k], full_matrices=False)
    keep = s > least * s[0] if len(s) else np.zeros(0, bool)
    theta = (t[keep].T / s[keep]) @ (u[:, keep].T @ r[:, k:])
    return {"theta": theta, "rank": int(keep.sum()), "residual": np.linalg.norm(r[:, :k] @ theta - r[:, k:], axis=0)}


def best_of(scores: DataFrame) -> dict:
    """The candidate of the smallest score; ties go to the smaller basis, then strength, then power."""
    row = scores.orderBy(F.col("nrmse").asc_nulls_last(), "n_basis", "strength", "power").first()
    if row is None:
        raise ValueError("no candidate was scored")
    return row.asDict()


def select_and_refit(train: DataFrame, validation: DataFrame, design: str, target: str, generator: np.ndarray, sizes: list[int], strengths: list[float], powers: list[float],
                     weight: Column | None = None, ridge: float = 1e-12) -> tuple[dict, np.ndarray]:
    """(chosen candidate, coefficients): the grid is fitted on train and judged on validation, the choice is fitted again on both."""
    g, r, _ = gram(train, design, target, weight)
    sizes = [n for n in sizes if n <= len(g)]
    chosen = best_of(grid_scores(validation, design, target, grid_coefficients(g, r, generator[:len(g)], sizes, strengths, powers, ridge), weight))
    g, r, _ = gram(train.unionByName(validation), design, target, weight)
    n = chosen["n_basis"]
    return chosen, solve(g[:n, :n], r[:n], penalty(generator[:n], chosen["power"], ridge), chosen["strength"], ridge)


def closure(rows: DataFrame, held_out: DataFrame, design: str, theta: np.ndarray, weight: Column | None = None, tolerance: float = 1e-8) -> dict:
    """Whether labels made of known coefficients give these back: relative errors of coefficients, fit and held-out rows.

    Nothing is penalised. status is "pass" if all three stay within the tolerance, else "review".
    """
    g, r, _ = gram(predict(rows, design, theta, "made__"), design, "made__", weight)
    found = solve(g, r, np.zeros(len(theta)), 0.0, 0.0)

    def error(df: DataFrame) -> float:
        both = predict(predict(df, design, theta, "made__"), design, found, "found__")
        row = both.agg(F.sqrt(F.try_divide(F.sum((F.col("found__") - F.col("made__")) ** 2), F.sum(F.col("made__") ** 2))).alias("e")).first()
        return float(row["e"]) if row["e"] is not None else float("nan")

    errors = {"coefficient_error": float(np.linalg.norm(found - theta) / np.linalg.norm(theta)), "fit_error": error(rows), "held_out_error": error(held_out)}
    return {"n_basis": len(theta), **errors, "found": found, "status": "pass" if all(e <= tolerance for e in errors.values()) else "review"}


def baselines(train: DataFrame, rows: DataFrame, target: list[str]) -> DataFrame:
    """(baseline, n, nrmse): predictions of zero and of the mean over train, for scalars or vectors."""
    mean = train.agg(*[F.avg(t).alias(f"mean{i}__") for i, t in enumerate(target)])
    each = F.array(F.struct(F.lit("zero").alias("baseline"), *[F.lit(0.0).alias(f"p{i}__") for i in range(len(target))]),
                   F.struct(F.lit("mean").alias("baseline"), *[F.col(f"mean{i}__").alias(f"p{i}__") for i in range(len(target))]))
    made = rows.crossJoin(F.broadcast(mean)).select(*target, F.inline(each))
    error = sum(((F.col(t) - F.col(f"p{i}__")) ** 2 for i, t in enumerate(target)), F.lit(0.0))
    square = sum((F.col(t) ** 2 for t in target), F.lit(0.0))
    return made.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.try_divide(F.sum(error), F.sum(square))).alias("nrmse"))


def predict(rows: DataFrame, design: str, theta: np.ndarray, name: str = "predicted") -> DataFrame:
    """rows with the product of the leading design columns and theta, as a column expression."""
    t = F.array(*[F.lit(float(v)) for v in theta])
    products = F.zip_with(F.slice(design, 1, len(theta)), t, lambda a, b: a * b)
    return rows.withColumn(name, F.aggregate(products, F.lit(0.0), lambda a, b: a + b))


def effective_freedom(g: np.ndarray, diagonal: np.ndarray, strength: float, ridge: float = 1e-12) -> float:
    return float(np.trace(np.linalg.solve(g + np.diag(strength * diagonal + ridge), g)))


def spectrum(g: np.ndarray) -> dict:
    """Rank, nullity, condition, stable rank and entropy rank of a design, from its Gram matrix."""
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))
    if not len(values) or values[0] == 0:
        return {"rank": 0, "nullity": len(values), "condition": float("nan"), "stable_rank": 0.0, "entropy_rank": 0.0}
    rank = int((values > len(values) * np.finfo(float).eps ** 0.5 * values[0]).sum())
    share = values ** 2 / (values ** 2).sum()
    share = share[share > 0]
    return {"rank": rank, "nullity": len(values) - rank, "condition": float(values[0] / values[rank - 1]), "stable_rank": float((values ** 2).sum() / values[0] ** 2),
            "entropy_rank": float(np.exp(-(share * np.log(share)).sum()))}


def covariance(g: np.ndarray, noise: np.ndarray, diagonal: np.ndarray, strength: float, total: float, ridge: float = 1e-12) -> np.ndarray:
    """Sandwich covariance of the coefficients; noise is X'(w sigma)^2 X / sum w."""
    inverse = np.linalg.inv(g + np.diag(strength * diagonal + ridge))
    return inverse @ noise @ inverse / total


def prediction_variance(rows: DataFrame, design: str, cov: np.ndarray, name: str = "variance") -> DataFrame:
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch[design].tolist(), float)[:, :len(cov)]
            yield batch[columns].assign(**{name: np.einsum("ij,jk,ik->i", x, cov, x)})

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` double")
