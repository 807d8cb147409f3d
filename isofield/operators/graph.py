"""Neighbour joins, kernels, Markov operators, local metrics and gradients over edge tables (src, dst, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.operators.neighbours import AXES, knn  # noqa: F401
from isofield.operators.relational import quantiles
from isofield.sources.shared import cut


def bandwidth(edges: DataFrame, rank: int, factor: float = 1.0) -> DataFrame:
    """(src, rho): a multiple of the distance to the rank-th neighbour, floored at 1e-8 of the median positive one."""
    rho = edges.where(F.col("rank") == rank).select("src", (F.col("dist") * factor).alias("rho"))
    floor = quantiles(rho.where("rho > 0").select("rho"), [], "rho", [0.5]).select(F.greatest(F.get("quantiles", F.lit(0)) * 1e-8, F.lit(2.220446049250313e-16)).alias("floor"))
    return rho.crossJoin(F.broadcast(floor)).select("src", F.greatest("rho", F.coalesce("floor", F.lit(2.220446049250313e-16))).alias("rho"))


def kernel(edges: DataFrame, rho: DataFrame) -> DataFrame:
    """(src, dst, w): exp(-d^2 / (rho_src rho_dst)), the larger of both directions, and ones on the diagonal."""
    r = rho.withColumnRenamed("src", "dst").withColumnRenamed("rho", "rho_dst")
    w = edges.join(rho, "src").join(r, "dst").select("src", "dst", F.exp(-(F.col("dist") ** 2) / (F.col("rho") * F.col("rho_dst"))).alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    diagonal = rho.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    return both.where("w > 0").unionByName(diagonal)


def markov(weights: DataFrame) -> DataFrame:
    """Rows scaled to sum to one."""
    total = weights.groupBy("src").agg(F.sum("w").alias("total"))
    return weights.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def apply(edges: DataFrame, value: DataFrame, weight: str, name: str) -> DataFrame:
    """(src, name): edge weights times value(id, v), summed over each row."""
    return edges.join(value, edges["dst"] == value["id"]).groupBy("src").agg(F.sum(F.col(weight) * F.col("v")).alias(name))


def alpha_operator(weights: DataFrame, mass: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Symmetric operator (src, dst, s) and nodes (id, w, q, d, pi) of a kernel with node weights mass(id, w).

    q = K w, K' = K / (q_i q_j)^alpha, d = K' w, pi proportional to w d, S = sqrt(w_i / d_i) K' sqrt(w_j / d_j).
    """
    # Each is read several times below; written once, none is worked out again in every place.
    q = cut(apply(weights, mass.withColumnRenamed("w", "v"), "w", "q").withColumnRenamed("src", "id"))
    left = q.select(F.col("id").alias("src"), F.col("q").alias("qs"))
    right = q.select(F.col("id").alias("dst"), F.col("q").alias("qd"))
    scaled = cut(weights.join(left, "src").join(right, "dst").select("src", "dst", (F.col("w") * F.pow(F.col("qs") * F.col("qd"), F.lit(-alpha))).alias("w")))
    d = apply(scaled, mass.withColumnRenamed("w", "v"), "w", "d").withColumnRenamed("src", "id")
    nodes = cut(mass.join(q, "id").join(d, "id"))
    total = nodes.agg(F.sum(F.col("w") * F.col("d")).alias("total"))
    nodes = nodes.crossJoin(F.broadcast(total)).withColumn("pi", F.col("w") * F.col("d") / F.col("total")).drop("total")
    root = nodes.select("id", F.sqrt(F.col("w") / F.col("d")).alias("r"))
    s = scaled.join(root.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(root.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst")
    return s.select("src", "dst", (F.col("rs") * F.col("w") * F.col("rd")).alias("s")), nodes


def local_metric(transition: DataFrame, points: DataFrame, rho: DataFrame) -> DataFrame:
    """(src, g_xx, g_xy, ...): covariance of neighbour positions under transition(src, dst, p), over 2 rho^2."""
    placed = transition.join(points.withColumnRenamed("id", "dst"), "dst")
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    p = F.col("p")
    sums = placed.groupBy("src").agg(*[F.sum(p * F.col(a)).alias(f"m_{a}") for a in AXES], *[F.sum(p * F.col(a) * F.col(b)).alias(f"m_{a}{b}") for a, b in pairs])
    return sums.join(rho, "src").select("src", *[((F.col(f"m_{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) / (2 * F.col("rho") ** 2)).alias(f"g_{a}{b}") for a, b in pairs])


def inverse_metric(metric: DataFrame) -> DataFrame:
    """(src, i_xx, ..., condition, clipped): inverse of the symmetric 3 x 3 metric.

    Eigenvalues below max(1e-14, 1e-10 max(trace / 3, 1)) are raised to that; clipped counts them, and condition is the
    ratio of the outer eigenvalues then. A metric with a null, NaN or infinite entry has a null inverse.
    """
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    at = [(AXES.index(a), AXES.index(b)) for a, b in pairs]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = np.empty((len(batch), 3, 3))
            for (a, b), (i, j) in zip(pairs, at):
                g[:, i, j] = g[:, j, i] = batch[f"g_{a}{b}"].to_numpy(float)
            good = np.isfinite(g).all((1, 2))
            values, vectors = np.linalg.eigh(np.where(good[:, None, None], g, np.eye(3)))
            floor = np.maximum(1e-14, 1e-10 * np.maximum(values.sum(1) / 3, 1.0))[:, None]
            kept = np.maximum(values, floor)
            inverse = (vectors / kept[:, None, :]) @ vectors.transpose(0, 2, 1)
            out = {f"i_{a}{b}": inverse[:, i, j] for (a, b), (i, j) in zip(pairs, at)} | {"condition": kept.max(1) / kept.min(1)}
            known = pd.DataFrame(out, index=batch.index).where(pd.Series(good, index=batch.index), axis=0)
            yield pd.concat([batch[["src"]], known, pd.Series(np.where(good, (values < floor).sum(1), 0), index=batch.index, name="clipped", dtype="int32")], axis=1)

    kind = dict(metric.dtypes)["src"]
    out = metric.select("src", *[f"g_{a}{b}" for a, b in pairs]).mapInPandas(invert, f"src {kind}, " + ", ".join(f"i_{a}{b} double" for a, b in pairs) + ", condition double, clipped int")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in out.columns[1:-1]})


def gradient(transition: DataFrame, points: DataFrame, rho: DataFrame, function: DataFrame, metric: DataFrame) -> DataFrame:
    """(src, d_x, d_y, d_z): covariance of function(id, v) with position over 2 rho^2, times the inverse metric.

    Exact for affine functions.
    """
    placed = transition.join(points.withColumnRenamed("id", "dst"), "dst").join(function.withColumnRenamed("id", "dst"), "dst")
    p, v = F.col("p"), F.col("v")
    sums = placed.groupBy("src").agg(F.sum(p * v).alias("m_v"), *[F.sum(p * F.col(a)).alias(f"m_{a}") for a in AXES], *[F.sum(p * v * F.col(a)).alias(f"m_v{a}") for a in AXES])
    cov = [(F.col(f"m_v{a}") - F.col("m_v") * F.col(f"m_{a}")) / (2 * F.col("rho") ** 2) for a in AXES]
    inv = inverse_metric(metric)
    get = lambda a, b: F.col(f"i_{min(a, b)}{max(a, b)}")
    return sums.join(rho, "src").join(inv, "src").select("src", *[sum((get(a, b) * c for b, c in zip(AXES, cov)), F.lit(0.0)).alias(f"d_{a}") for a in AXES])


def bulk_field(edges: DataFrame, values: DataFrame, width: Column | float, names: list[str], mass: str | None = None, dispersion: bool = False) -> DataFrame:
    """Kernel means of neighbour values with weights exp(-(d / h)^2): (src, names..., effective, nearest, farthest).

    mass names a column of values that the weights are multiplied by. dispersion adds the root of the weighted mean square
    distance of the vectors of all names from their mean.
    """
    h = width if isinstance(width, Column) else F.lit(width)
    k = F.exp(-((F.col("dist") / h) ** 2)) * (F.lit(1.0) if mass is None else F.col(mass))
    w = edges.join(values.withColumnRenamed("id", "dst"), "dst").withColumn("w__", k)
    k = F.col("w__")
    mean = {c: F.try_divide(F.sum(k * F.col(c)), F.sum(k)) for c in names}
    if not dispersion:
        more = []
    else:
        # Squares are taken about the mean over all rows, one small aggregate, so that no large common part cancels.
        centre = values.agg(*[F.avg(c).alias(f"{c}__0") for c in names])
        w = w.crossJoin(F.broadcast(centre))
        off = {c: F.col(c) - F.col(f"{c}__0") for c in names}
        square = sum((F.try_divide(F.sum(k * o * o), F.sum(k)) - F.try_divide(F.sum(k * o), F.sum(k)) ** 2 for o in off.values()), F.lit(0.0))
        more = [F.sqrt(F.greatest(square, F.lit(0.0))).alias("dispersion")]
    return w.groupBy("src").agg(*[m.alias(c) for c, m in mean.items()], *more, F.try_divide(F.sum(k) ** 2, F.sum(k * k)).alias("effective"),
                                F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))


def adaptive_width(edges: DataFrame, rank: int, factor: float) -> DataFrame:
    """edges with h: a multiple of the distance to the rank-th neighbour of each source."""
    h = edges.where(F.col("rank") == rank).select("src", (F.col("dist") * factor).alias("h"))
    return edges.join(h, "src")


def nystrom(edges: DataFrame, rho_query: DataFrame, rho_node: DataFrame, mass: DataFrame) -> DataFrame:
    """(src, dst, p): transition from queries to nodes by the kernel, weighted by node mass(id, w), rows summing to one."""
    r = rho_node.select(F.col("src").alias("dst"), F.col("rho").alias("rho_dst"))
    m = mass.select(F.col("id").alias("dst"), F.col("w").alias("mass"))
    w = edges.join(rho_query, "src").join(r, "dst").join(m, "dst").select("src", "dst", (F.col("mass") * F.exp(-(F.col("dist") ** 2) / (F.col("rho") * F.col("rho_dst")))).alias("w"))
    return markov(w)


def query_transition(edges: DataFrame, rho_query: DataFrame, rho_node: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """(src, dst, p, q, total): transition from new points to nodes(id, w, q) by the kernel of the operator of `alpha`.

    edges are the neighbours of the new points among the nodes. q is a new point's own density (kernel times w, at least
    the smallest positive step of a double at 1), the kernel over (q q_node) ** alpha times w is scaled to rows of one,
    and total is what a row summed to before.
    """
    r = rho_node.select(F.col("src").alias("dst"), F.col("rho").alias("rho_dst"))
    m = nodes.select(F.col("id").alias("dst"), F.col("w").alias("mass"), F.col("q").alias("density"))
    k = edges.join(rho_query, "src").join(r, "dst").join(m, "dst").select("src", "dst", "mass", "density", F.exp(-(F.col("dist") ** 2) / (F.col("rho") * F.col("rho_dst"))).alias("k"))
    own = Window.partitionBy("src")  # as many rows as a point has neighbours
    k = k.withColumn("q", F.greatest(F.sum(F.col("k") * F.col("mass")).over(own), F.lit(2.220446049250313e-16)))
    k = k.withColumn("row", F.col("k") * F.pow(F.col("q") * F.col("density"), F.lit(-alpha)) * F.col("mass")).withColumn("total", F.sum("row").over(own))
    return k.select("src", "dst", F.try_divide("row", "total").alias("p"), "q", "total")


def extend_modes(transition: DataFrame, modes: DataFrame, values: dict[int, list[float]], least: float = 1e-10) -> DataFrame:
    """(src, block, v): modes of the nodes carried to new points, sum over p times v, over the mode's eigenvalue.

    modes(id, block, v) come in blocks of columns, so that an edge carries one block at a time; values gives each block's
    eigenvalues. Modes whose eigenvalue is at most `least` in size are null at every new point.
    """
    moved = transition.join(modes.withColumnRenamed("id", "dst"), "dst").groupBy("src", "block").agg(
        Summarizer.mean(array_to_vector("v"), F.col("p")).alias("mean"), F.sum("p").alias("total"))
    over = F.create_map(*[c for b, vs in values.items() for c in (F.lit(b), F.array(*[F.lit(float(x)) if abs(x) > least else F.lit(None).cast("double") for x in vs]))])
    return moved.select("src", "block", F.zip_with(vector_to_array("mean"), over[F.col("block")], lambda x, value: x * F.col("total") / value).alias("v"))
