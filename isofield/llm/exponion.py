"""Exact k-means over integer vectors by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.llm.common import Scratch

#: Integers up to this size have squared distances of 64 components that doubles hold exactly.
EXACT = 1 << 22
#: Sums of a cluster are added up in so many parts before the driver adds the parts.
PARTS = 8
#: What bounds are widened by, so that rounding never hides a centroid: a share and an absolute amount.
SLACK = 1e-9
STATE = "kind int, vec_id long, x array<double>, cluster int, upper double, lower double, distance string, n long, sums array<string>"
ARROW = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()),
                   ("distance", pa.string()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: doubles where all are small, Python integers else."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return scaled
    return np.array([[int(v) * scale if abs(v) > 1e300 else int(np.floor(v * scale)) for v in row] for row in x], object)


@dataclass
class Centroids:
    """Centroids with the lists of their distances to one another, nearest first."""
    exact: list[list[int]]

    def __post_init__(self) -> None:
        self.small = all(abs(v) <= EXACT for c in self.exact for v in c)
        if self.small:
            self.at = np.array(self.exact, float)
            self.square = (self.at ** 2).sum(1)
            gaps = np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(2))
            self.order = np.argsort(gaps, axis=1, kind="stable")
            self.gaps = np.take_along_axis(gaps, self.order, 1)

    def squares(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of each row to the centroids of which; exact, as all terms are integers below 2**53."""
        return (x * x).sum(1)[:, None] - 2 * (x @ self.at[which].T) + self.square[which]


def nearest(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower bounds after the nearest centroid of each vector is found, ties to the smaller number.

    A vector keeps its centroid unseen while its upper bound lies below its lower bound or half the distance to the next
    centroid. Otherwise its own distance is taken, and if that does not settle it, the centroids of a ball around its own
    are scanned: twice its distance and the distance to the next centroid in radius, inclusive, so that every centroid
    that could be nearest or second nearest is inside. Scans take the sorted list up to the next power of two.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    k = len(c.exact)
    if k == 1:
        return np.zeros_like(cluster), np.sqrt(c.squares(x, np.array([0]))[:, 0]), np.full(len(x), np.inf)
    safe = np.maximum(lower, c.gaps[cluster, 1] / 2) * (1 - SLACK) - SLACK
    todo = np.flatnonzero(~(upper < safe))
    if len(todo):
        own = np.sqrt(((x[todo] - c.at[cluster[todo]]) ** 2).sum(1))
        upper[todo] = own
        todo = todo[~(own < safe[todo])]
    if not len(todo):
        return cluster, upper, lower
    radius = (2 * upper[todo] + c.gaps[cluster[todo], 1]) * (1 + SLACK) + SLACK
    for a in np.unique(cluster[todo]):
        rows = todo[cluster[todo] == a]
        inside = np.searchsorted(c.gaps[a], radius[cluster[todo] == a], "right")
        inside = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int), k)
        for m in np.unique(inside):
            part, which = rows[inside == m], np.sort(c.order[a, :m])
            d = c.squares(x[part], which)
            best = d.argmin(1)  # of equal ones the first, and which rises
            first = np.take_along_axis(d, best[:, None], 1)[:, 0]
            d[np.arange(len(part)), best] = np.inf
            cluster[part], upper[part], lower[part] = which[best], np.sqrt(first), np.sqrt(d.min(1))
    return cluster, upper, lower


def _wide(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, list[int]]:
    """Nearest centroids by Python integers, for components whose squares doubles do not hold."""
    found = [min((sum((int(v) - w) ** 2 for v, w in zip(row, centre)), k) for k, centre in enumerate(c.exact)) for row in x]
    return np.array([k for _, k in found], int), [d for d, _ in found]


def _rows(size: int, **columns) -> pa.RecordBatch:
    """State rows, nulls in the columns that are not given."""
    arrays = [pa.nulls(size, f.type) if f.name not in columns else columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _round(c: Centroids, scale: int, width: int, moved: np.ndarray | None, first: bool):
    """The pass of one round over state rows; each task adds a row of sums for each cluster it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = [0] * len(c.exact), [None] * len(c.exact)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            column = batch.column("x")
            x = integers(column.flatten().to_numpy(zero_copy_only=False).reshape(n, width), scale)
            if x.dtype == object or not c.small:
                cluster, distance = _wide(x, c)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                if first:
                    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
                else:
                    cluster = batch.column("cluster").to_numpy().astype(np.int64)
                    upper = batch.column("upper").to_numpy() + moved[cluster] * (1 + SLACK)
                    most = np.sort(moved)[::-1]
                    other = np.where(moved[cluster] == most[0], most[1] if len(most) > 1 else 0.0, most[0])
                    lower = batch.column("lower").to_numpy() - other * (1 + SLACK)
                cluster, upper, lower = nearest(x, cluster, upper, lower, c)
                distance = ((x - c.at[cluster]) ** 2).sum(1).astype(np.int64).tolist()
            for k in np.unique(cluster):
                rows = x[cluster == k]
                total = rows.sum(0) if rows.dtype == object else rows.astype(np.int64).sum(0)
                total = [int(v) for v in total]
                count[k] += len(rows)
                sums[k] = total if sums[k] is None else [a + b for a, b in zip(sums[k], total)]
            yield _rows(n, kind=[0] * n, vec_id=batch.column("vec_id"), x=column, cluster=cluster.astype(np.int32), upper=upper, lower=lower, distance=list(map(str, distance)))
        seen = [k for k in range(len(c.exact)) if count[k]]
        if seen:
            yield _rows(len(seen), kind=[1] * len(seen), cluster=seen, n=[count[k] for k in seen], sums=[list(map(str, sums[k])) for k in seen])

    return run


def _added(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of sums of one task, added by cluster."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in rows:
        for k, n, sums in zip(batch["cluster"], batch["n"], batch["sums"]):
            old = found.get(k, (0, [0] * len(sums)))
            found[k] = (old[0] + int(n), [a + int(b) for a, b in zip(old[1], sums)])
    if found:
        yield pd.DataFrame({"cluster": list(found), "n": [v[0] for v in found.values()], "sums": [list(map(str, v[1])) for v in found.values()]})


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `width` finite components.

    Components become floor(scale * x). The k vectors with the smallest SHA-256 of "seed:id" are the first centroids;
    each round assigns every vector to the nearest (ties: the smaller number) and moves every centroid that has vectors
    to the floor of their mean; at the end vectors are assigned once more. All arithmetic is exact, so the result does
    not depend on how rows are dealt out; the search ends early when no centroid moves.

    Null vectors, vectors of another length and those with a null, NaN or infinite component are left out. Equal vectors
    and repeated ids are rows of their own; a null id counts as the text "null" in the hash, and equal hashes are taken in
    the order of vectors. With fewer than k vectors, each is a centroid; a table without any gives no rows. Other columns
    are ignored. Distances and inertias beyond 64 bits are null.

    A round is one pass over the vectors, written to the shared folder with the bounds of each; the driver holds the
    centroids alone (k rows, sent to every task), and no vector is shuffled.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where((F.size("x") == width) & finite)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256), F.col("x")]
    first = kept.orderBy(*order).limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    exact = [[int(v) for v in integers(np.array([r["x"]], float), scale)[0]] for r in first]
    with Scratch(spark) as scratch:
        state, moved = kept, None
        for turn in range(rounds + 1):
            c = Centroids(exact)
            source = state if moved is None else state.where("kind = 0")
            passed = scratch.cut(source.mapInArrow(_round(c, scale, width, moved, moved is None), STATE), "exponion")
            if moved is not None:
                scratch.drop(state)
            state = passed
            if turn == rounds:
                break
            parts = state.where("kind = 1").select("cluster", "n", "sums").repartition(PARTS).mapInPandas(_added, "cluster int, n long, sums array<string>").collect()
            new = [list(row) for row in exact]
            for a in {r["cluster"] for r in parts}:
                own = [r for r in parts if r["cluster"] == a]
                n = sum(r["n"] for r in own)
                new[a] = [sum(int(r["sums"][d]) for r in own) // n for d in range(width)]
            if new == exact:
                break
            known = c.small and Centroids(new).small
            moved = np.array([float(sum((p - q) ** 2 for p, q in zip(a, b))) ** 0.5 if known else np.inf for a, b in zip(exact, new)])
            exact = new
        scratch.keep(state)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in exact]
    rows = state.where("kind = 0").select("vec_id", "cluster", F.expr("try_cast(distance as decimal(38,0))").alias("exact"))
    sums = rows.groupBy("cluster").agg(F.when(F.count("exact") == F.count(F.lit(1)), F.try_sum("exact")).alias("part"))
    total = sums.agg(F.when(F.count("part") == F.count(F.lit(1)), F.try_sum("part")).alias("all"))
    names = spark.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    long = lambda name: F.expr(f"try_cast(`{name}` as bigint)")
    per = names.join(sums, "cluster").crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", long("exact").alias("distance"), long("part").alias("cluster_inertia"), long("all").alias("inertia"), "centroid_sha256")
