"""Approximate nearest neighbours: inverted lists, residual codes, table look-ups, exact cosines of what codes cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.llm import ivfpq
from isofield.llm.common import cut

#: Share of their true neighbours among all rows that the probed lists must hold for so many sampled queries.
TARGET, SAMPLED = 0.98, 400
#: Rows of a list, and queries, that one task holds against each other; larger lists are split. A list's vectors travel
#: once for each block of its queries, a query's once for each block of its lists' rows, so blocks are as large as a task holds.
BLOCK, QUERIES = 50_000, 20_000
#: Code distances, and queries, that are held at once.
CELLS, TOGETHER = 1_000_000, 512
FOUND = "query_id long, id long, score double"


def nearest(ids: np.ndarray, x: np.ndarray, asked_by: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, place of row, cosine) of the k nearest of rows x to each of asked, all compared; ties to the smaller id."""
    lengths = np.sqrt((x * x).sum(1))
    like = (asked / np.sqrt((asked * asked).sum(1))[:, None]) @ (x / lengths[:, None]).T
    like[asked_by[:, None] == ids[None, :]] = -np.inf
    return _best(like, ids, x, asked, k)


def _best(like: np.ndarray, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest of each row of like; those within rounding of the last are decided by the cosine row by row, then by id."""
    bound = np.partition(like, like.shape[1] - k, axis=1)[:, -k] if like.shape[1] > k else np.full(len(like), -2.0)
    query, row = np.nonzero((like >= bound[:, None] - 1e-12) & (like > -np.inf))
    cos = np.concatenate([ivfpq.cosines(x[row[i:i + 65536]], asked[query[i:i + 65536]]) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    order = np.lexsort((ids[row], -cos, query))
    query, row, cos = query[order], row[order], cos[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], cos[keep]


def probes(indexed: DataFrame, quantiser: ivfpq.Quantiser, k: int, target: float = TARGET, sampled: int = SAMPLED) -> int:
    """Fewest nearest lists that hold the target share of the k nearest, among all rows, of a sample of the queries.

    The sample is of the queries themselves, those with the smallest hashes of their ids, and their neighbours come from
    brute force over every row, so neither queries of another kind than most rows nor a dense table mislead it.
    """
    asks = indexed.where("asks").select("id", "vector").orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(sampled).toPandas()
    if not len(asks):
        return 1
    by, asked = asks["id"].to_numpy(), ivfpq.scaled(np.array(asks["vector"].tolist(), float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.iloc[first:first + 2048]
                query, row, cos = nearest(part["id"].to_numpy(), ivfpq.scaled(np.array(part["vector"].tolist(), float)), by, asked, k)
                yield pd.DataFrame({"query": query, "id": part["id"].to_numpy()[row], "list": part["list"].to_numpy()[row], "score": cos})

    near = indexed.select("id", "vector", "list").mapInPandas(run, "query long, id long, list int, score double")
    true = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query", "list").toPandas()
    if not len(true):
        return 1
    place = ivfpq.squares(ivfpq.unit(asked), quantiser.centres).argsort(1, kind="stable").argsort(1, kind="stable")
    ranks = np.sort(place[true["query"].to_numpy(), true["list"].to_numpy()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           max_train: int = ivfpq.MAX_TRAIN) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every query row among all rows but those of its own id.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. The index holds
    every row that takes part; only centroids and codebooks are fitted on a bounded sample, and the number of probes on
    sampled queries. In a probed list nothing is missed: the rows that code distances put first bound a query's answer,
    what code distance less code error puts beyond it is ruled out, and exact cosines rank the rest.
    Null, zero and non-finite vectors and null ids take no part. Vectors that are not of the commonest length are lists of
    their own, one for each length, compared exactly. A repeated id is searched once for each of its different vectors'
    best rows and never finds itself. A query with fewer candidates than k gets all found. An empty table gives an empty
    result.
    """
    every, length = ivfpq.usable(rows, id_col, vector_col, F.coalesce(is_query, F.lit(False)).alias("asks"))
    if not length:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    every = cut(every, "vectors")
    base, odd = every.where(F.size("vector") == length), every.where(F.size("vector") != length)
    q = ivfpq.fit(ivfpq.sample(base, max_train), int(round(np.sqrt(base.count()) / 2)))
    indexed = cut(ivfpq.index(base, q, ", asks boolean"), "index")
    near = probes(indexed, q, k)
    odd = odd.withColumns({"list": -F.size("vector"), "codes": F.lit(b""), "left_out": F.lit(0.0), "away": F.lit(0.0)})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                order = ivfpq.squares(ivfpq.unit(np.array(batch["vector"].tolist(), float)), q.centres).argsort(1)[:, :near]
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), order.shape[1]), "vector": [v for v in batch["vector"] for _ in range(order.shape[1])],
                                    "list": order.ravel().astype(np.int32)})

    asked = cut(indexed.where("asks").select("id", "vector").mapInPandas(ask, f"id long, vector {dict(base.dtypes)['vector']}, list int")
                .unionByName(odd.where("asks").select("id", "vector", "list")), "asked")
    indexed = indexed.unionByName(odd)
    # Lists are split into blocks of rows and of queries by hash, so that a hot list is many tasks.
    size = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).join(
        asked.groupBy("list").agg(F.count(F.lit(1)).alias("queries")), "list") \
        .select("list", F.ceil(F.col("rows") / BLOCK).cast("int").alias("rb"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("qb"))
    # One row for each list, of which there are at most MAX_LISTS, and for each rarer length.
    size = F.broadcast(size)
    left = indexed.join(size, "list").select("list", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("s"), "id", "vector", "codes", "left_out")
    right = asked.join(size, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("qb")).cast("int").alias("s"), "id", "vector")

    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        ids, number, left_out = rows["id"].to_numpy(), int(rows["list"].iloc[0]), rows["left_out"].to_numpy()
        vectors, by, asked = ivfpq.scaled(np.array(rows["vector"].tolist(), float)), queries["id"].to_numpy(), ivfpq.scaled(np.array(queries["vector"].tolist(), float))
        codes, units = ivfpq.code_matrix(rows["codes"]), ivfpq.unit(vectors)
        found, step = [], max(1, min(TOGETHER, CELLS // len(ids)))
        for first in range(0, len(by), step):
            v, own = asked[first:first + step], by[first:first + step, None] == ids[None, :]
            if number < 0:
                at, row, cos = nearest(ids, vectors, by[first:first + step], v, k)
            else:
                u = ivfpq.unit(v)
                far = np.sqrt(q.distances(u, number, codes))
                far[own] = np.inf
                # The k that stand first by code bound the distance of a query's k-th nearest.
                reach = np.full(len(v), np.inf)
                if len(ids) > k:
                    lead = np.argpartition(far, k - 1, axis=1)[:, :k]
                    away = np.sqrt(np.maximum(2 - 2 * np.einsum("qkd,qd->qk", units[lead], u), 0))
                    reach = np.where(np.isinf(np.take_along_axis(far, lead, 1)).any(1), np.inf, away.max(1) + 1e-7)
                maybe = (far - left_out <= reach[:, None]) & ~own
                some = np.flatnonzero(maybe.any(0))
                if not len(some):
                    continue
                like = np.where(maybe[:, some], u @ units[some].T, -np.inf)
                at, row, cos = _best(like, ids[some], vectors[some], v, k)
                row = some[row]
            found.append(pd.DataFrame({"query_id": by[first + at], "id": ids[row], "score": cos}))
        return pd.concat(found) if found else scan(rows[:0], queries)

    hits = left.groupBy("list", "r", "s").cogroup(right.groupBy("list", "r", "s")).applyInPandas(scan, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
