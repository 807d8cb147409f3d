"""Exact k nearest neighbours by leaves of points along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isofield.functions.columns import finite
from isofield.operators.relational import cumulative, numbered
from isofield.sources.shared import cut

AXES = ("x", "y", "z")
#: Points of a leaf, leaves under one box above it, and queries that one group answers at most.
LEAF, FAN, ASKED = 256, 1024, 20_000
BITS = 21
#: Queries whose distances are held at once.
ROWS = 512


def _coded(df: DataFrame, low: list[float], side: list[float]) -> DataFrame:
    """df with `code`, the place of (x, y, z) on a curve of interleaved bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            for k, a in enumerate(AXES):
                x = (batch.column(a).to_numpy() - low[k]) / side[k]
                cell = np.clip(x * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                for bit in range(BITS):
                    code |= ((cell >> bit) & 1) << (3 * bit + k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", code long")


def _at(table) -> np.ndarray:
    return np.column_stack([table[a].to_numpy() for a in AXES]) if len(table) else np.zeros((0, 3))


def _outside(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of points from boxes, queries by boxes."""
    total = np.zeros((len(at), len(low)))
    for k in range(3):
        gap = np.maximum(np.maximum(low[None, :, k] - at[:, None, k], at[:, None, k] - high[None, :, k]), 0)
        total += gap * gap
    return np.sqrt(total)


def _salted(asks: DataFrame, side: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both with `salt`, so that no (key, salt) has much more than ASKED asks; the side's rows go to every salt of their key."""
    parts = asks.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))
    a = asks.join(parts, key).withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")).drop("salts")
    return a, side.join(parts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


FOUND = pa.schema([("query", pa.int64()), ("leaf", pa.int64()), ("dst", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64()))])


def _nearest(k: int):
    """Of each ask (query, leaf, x, y, z, reach) the k nearest points of the leaf within reach, ties to the smaller id."""
    def run(asks: pa.Table, points: pa.Table) -> pa.Table:
        if not len(asks) or not len(points):
            return FOUND.empty_table()
        ids, at = points["id"].to_numpy(), _at(points)
        order = np.argsort(ids)
        ids, at = ids[order], at[order]
        query, where, reach = asks["query"].to_numpy(), _at(asks), asks["reach"].to_numpy()
        dst, dist, ends = [], [], [0]
        for first in range(0, len(query), ROWS):
            part = where[first:first + ROWS]
            d = np.zeros((len(part), len(ids)))
            for a in range(3):
                gap = part[:, None, a] - at[None, :, a]
                d += gap * gap
            d = np.sqrt(d)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, best, 1)
            inside = near <= reach[first:first + ROWS, None]
            dst.append(ids[best][inside])
            dist.append(near[inside])
            ends.extend((ends[-1] + np.cumsum(inside.sum(1))).tolist())
        offsets = pa.array(ends, pa.int32())
        return pa.Table.from_arrays([pa.array(query), asks["leaf"].combine_chunks().cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(dst))),
                                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(dist)))], schema=FOUND)
    return run


def knn(queries: DataFrame, points: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(src, dst, dist, rank): the k nearest points(id, x, y, z) of each query(id, x, y, z), ties to the smaller id.

    skip_self leaves out the point of the query's own id. Rows with a null, NaN or infinite coordinate take no part. With
    fewer points than k a query has them all. Ids are unique within each table.

    Points are put in order along a curve of interleaved bits and cut into leaves of equally many, dense regions into
    small leaves and sparse ones into large. Of points at one place only the k + 1 smallest ids can be an answer, and
    queries at one place are answered once, so coinciding rows cost nothing more. A query first searches the leaf where it
    stands on the curve; the distance found bounds its answer. Only queries whose ball of that radius meets other leaves'
    boxes travel there: boxes of FAN leaves are tested first (one row for LEAF * FAN points, sent to every task), then
    the boxes of their leaves, then points. No point is copied, but where one leaf has more than ASKED queries.
    """
    spark = queries.sparkSession
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in AXES]).where(" and ".join(f"{a} is not null" for a in AXES)) \
        .where(finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull() & finite(F.col("z")).isNotNull())
    asked, points = clean(queries), clean(points)
    box = points.agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo_{a}") for a in AXES], *[F.max(a).alias(f"hi_{a}") for a in AXES]).first()
    if not box["n"] or k < 1:
        return spark.createDataFrame([], "src long, dst long, dist double, rank int")
    low = [box[f"lo_{a}"] for a in AXES]
    side = [max(box[f"hi_{a}"] / 2 - box[f"lo_{a}"] / 2, 1e-300) * 2 for a in AXES]
    wanted = k + 1
    leaf_size = max(LEAF, 2 * wanted)

    # Points in leaves.
    same = Window.partitionBy(*AXES).orderBy("id")  # tasks keep k + 1 rows of a place before any shuffle
    distinct = points.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= wanted).drop("rank")
    placed = numbered(_coded(distinct, low, side), ["code", *AXES, "id"], "place")
    n = placed.count()
    last = max(n // leaf_size - 1, 0)
    leaves = cut(placed.select("id", *AXES, "code", F.least(F.floor(F.col("place") / leaf_size), F.lit(last)).cast("long").alias("leaf")))
    sides = [f(a).alias(f"{name}_{a}") for name, f in (("lo", F.min), ("hi", F.max)) for a in AXES]
    boxes = cut(leaves.groupBy("leaf").agg(*sides).withColumn("tree", F.floor(F.col("leaf") / FAN)))
    over = [f(f"{name}_{a}").alias(f"{name}_{a}") for name, f in (("lo", F.min), ("hi", F.max)) for a in AXES]
    tops = boxes.groupBy("tree").agg(*over).orderBy("tree").toPandas()
    corner = lambda t, name: np.column_stack([np.asarray(t[f"{name}_{a}"]) for a in AXES])

    # Places to ask for, and the leaf where each stands on the curve.
    spots = cut(_coded(asked.select(*AXES).distinct(), low, side).withColumn("query", F.monotonically_increasing_id()))
    counts = cumulative(spots.select("code", F.lit(0).alias("w")).unionByName(leaves.select("code", F.lit(1).alias("w"))), [], "code", F.col("w")).select("code", "before__")
    start = F.least(F.floor(F.least(F.col("before__"), F.lit(n - 1)) / leaf_size), F.lit(last)).cast("long")
    first = spots.join(counts, "code").select("query", *AXES, start.alias("leaf"), F.lit(float("inf")).alias("reach"))
    shown = "query long, leaf long, dst array<long>, dist array<double>"

    def search(asks: DataFrame) -> DataFrame:
        a, p = _salted(asks, leaves.select("id", *AXES, "leaf"), "leaf")
        return a.groupBy("leaf", "salt").cogroup(p.groupBy("leaf", "salt")).applyInArrow(_nearest(wanted), shown)

    own = cut(search(first).join(spots, "query").select("query", "leaf", "dst", "dist", *AXES))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, names = corner(tops, "lo"), corner(tops, "hi"), np.asarray(tops["tree"], np.int64)
        for batch in batches:
            for begin in range(0, len(batch), 2048):
                part = batch.slice(begin, 2048)
                reach = part.column("reach").to_numpy()
                row, tree = np.nonzero(_outside(_at(part), lo, hi) <= reach[:, None])
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(names[tree])], names=[*part.schema.names, "tree"])

    # A hair more than the distance found, so that rounding hides no box.
    bound = F.when(F.size("dist") < wanted, F.lit(float("inf"))).otherwise(F.element_at("dist", -1) * (1 + 1e-9) + 1e-300)
    open_ = own.select("query", F.col("leaf").alias("home"), *AXES, bound.alias("reach"))
    by_tree = open_.mapInArrow(trees, "query long, home long, x double, y double, z double, reach double, tree long")
    ask_schema = pa.schema([("query", pa.int64()), ("leaf", pa.int64()), *[(a, pa.float64()) for a in AXES], ("reach", pa.float64())])

    def into(asks: pa.Table, below: pa.Table) -> pa.Table:
        if not len(asks) or not len(below):
            return ask_schema.empty_table()
        out = []
        names = below["leaf"].to_numpy()
        lo, hi = corner({c: below[c].to_numpy() for c in below.column_names if c[:3] in ("lo_", "hi_")}, "lo"), corner({c: below[c].to_numpy() for c in below.column_names if c[:3] in ("lo_", "hi_")}, "hi")
        for begin in range(0, len(asks), 2048):
            part = asks.slice(begin, 2048)
            near = _outside(_at(part), lo, hi) <= part["reach"].to_numpy()[:, None]
            near &= names[None, :] != part["home"].to_numpy()[:, None]
            row, leaf = np.nonzero(near)
            taken = part.take(pa.array(row))
            out.append(pa.Table.from_arrays([taken["query"], pa.array(names[leaf]), *[taken[a] for a in AXES], taken["reach"]], schema=ask_schema))
        return pa.concat_tables(out)

    a, b = _salted(cut(by_tree), boxes, "tree")
    further = cut(a.groupBy("tree", "salt").cogroup(b.groupBy("tree", "salt")).applyInArrow(into, "query long, leaf long, x double, y double, z double, reach double"))
    found = own.select("query", "dst", "dist").unionByName(search(further).select("query", "dst", "dist"))
    rows = found.select("query", F.explode(F.arrays_zip("dst", "dist")).alias("f")).select("query", F.col("f.dst").alias("dst"), F.col("f.dist").alias("dist"))
    # Each leaf sends k + 1 rows at most for a place.
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "dst"))).where(F.col("rank") <= wanted)
    answers = best.join(spots.select("query", *AXES), "query").select(*AXES, "dst", "dist")
    each = asked.select(F.col("id").alias("src"), *AXES).join(answers, list(AXES))
    if skip_self:
        each = each.where("src <> dst")
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return cut(each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "dist", F.col("rank").cast("int").alias("rank")))
