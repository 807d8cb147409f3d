"""Inverted lists of coarse centroids with product-quantised residuals, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that centroids and codebooks are fitted on at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
MAX_LISTS = 1024
SUBSPACES, CODES = 16, 256
ROUNDS = 8


def valid(vector) -> "F.Column":
    """Whether an array takes part: not null, not empty, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_col: str, vector_col: str, *more: str) -> tuple[DataFrame, int]:
    """(id, vector, ...) of the rows that take part, and the commonest length of their vectors, of equally common ones the longest."""
    single = dict(rows.dtypes)[vector_col] == "array<float>"  # half as wide to ship, and doubles take the same values
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if single else F.col(vector_col).cast("array<double>")).alias("vector"), *more) \
        .where(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows, sizes["d"] if sizes else 0


def sample(rows: DataFrame, bound: int) -> np.ndarray:
    """Unit vectors of the rows with the smallest hashes of their ids, at most bound of them."""
    got = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(bound).toPandas()
    x = np.array(got["vector"].tolist(), float).reshape(len(got), -1)
    return unit(x)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x over a power of two, so that no square overflows or vanishes; cosines stay the same to the last bit."""
    if not x.size:
        return x
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    """Coarse centroids, the columns of each subspace, and a codebook for the residuals in each."""

    centres: np.ndarray
    columns: list[np.ndarray]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes leave out) of unit vectors."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for k, (c, book) in enumerate(zip(self.columns, self.books)):
            codes[:, k] = nearest(rest[:, c], book)
            left += ((rest[:, c] - book[codes[:, k]]) ** 2).sum(1)
        return own, codes, np.sqrt(left)

    def distances(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of unit vectors, or of one, to the coded rows of a list, by table look-up."""
        rest = np.atleast_2d(queries) - self.centres[number]
        out = np.zeros((len(rest), len(codes)))
        for k, (c, book) in enumerate(zip(self.columns, self.books)):
            out += np.take(squares(rest[:, c], book), codes[:, k], axis=1)
        return out if queries.ndim == 2 else out[0]


def fit(x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 7) -> Quantiser:
    centres = k_means(x, max(1, min(lists, MAX_LISTS)), ROUNDS, seed)
    rest = x - centres[nearest(x, centres)]
    columns = [c for c in np.array_split(np.arange(x.shape[1]), subspaces) if len(c)]
    return Quantiser(centres, columns, [k_means(rest[:, c], codes, ROUNDS, seed + 1 + k) for k, c in enumerate(columns)])


def index(rows: DataFrame, quantiser: Quantiser, more: str = "") -> DataFrame:
    """rows(id, vector[, more columns]) with their list, codes, code error and distance to the list's centroid."""
    names = [c for c in rows.columns if c not in ("id", "vector")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = unit(np.array(batch["vector"].tolist(), float))
                number, codes, left = quantiser.encode(x)
                away = np.linalg.norm(x - quantiser.centres[number], axis=1)
                yield batch.assign(list=number.astype(np.int32), codes=[c.tobytes() for c in codes], left_out=left, away=away)[
                    ["id", "vector", *names, "list", "codes", "left_out", "away"]]

    return rows.mapInPandas(run, f"id long, vector {dict(rows.dtypes)['vector']}{more}, list int, codes binary, left_out double, away double")


def cosines(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines of rows with as many others; the same two vectors give the same last bit, wherever they stand and whichever comes first."""
    return (rows * others).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((others * others).sum(1)))


def code_matrix(codes: "pd.Series") -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
