"""Start vectors for the leading modes of a large operator: a small coarse operator and overlapping parts that tasks solve alone.

Values of a large graph's operator crowd below the largest, so that a Krylov space or a filter takes ever more products, each of
which is a shuffle. Here nodes are gathered around seeds; the operator between gatherings is small and solved on the driver, and
gatherings that lie together make parts. In a round each part corrects the residuals of the block alone, by many products within
one task, and Rayleigh-Ritz over the block, its corrections and its last step does the rest (locally optimal block
preconditioned conjugate gradients). The number of rounds hardly depends on the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.sources.shared import Tables

#: Seed of the gatherings; nodes of a graph from which on it is worth it, nodes of a gathering, and gatherings aimed at.
SEED, LEAST, RATIO, COARSE = 17, 1000, 50, 1024
#: Steps of the growth of gatherings at most.
GROWTH = 30
#: Layers of nodes around a part, products within a part, and the ratio of values that they cover.
LAYERS, STEPS, SPREAD = 2, 30, 150.0
#: Columns beside the wanted ones, and rounds at most.
BESIDE, ROUNDS = 6, 40
#: Edges of a part with its layers, over those of a part alone, at most.
WIDER = 8

PACKED = pa.schema([("part", pa.int32()), ("home", pa.int32()), ("inside", pa.int32()), ("ids", pa.list_(pa.int64())), ("agg", pa.list_(pa.int32())), ("b", pa.list_(pa.float64())),
                    ("src", pa.list_(pa.int32())), ("dst", pa.list_(pa.int32())), ("s", pa.list_(pa.float64())), ("row", pa.list_(pa.int32())), ("to", pa.list_(pa.int32()))])
PACKED_SQL = "part int, home int, inside int, ids array<long>, agg array<int>, b array<double>, src array<int>, dst array<int>, s array<double>, row array<int>, to array<int>"


def _wide(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def even(edges: DataFrame, ids: DataFrame, tables: Tables) -> tuple[DataFrame, float]:
    """(id, b): ones after two averages with their products, all positive; and a bound on the operator's values from it."""
    once = edges.groupBy(F.col("src").alias("id")).agg(F.sum("s").alias("sb"))
    first = ids.join(once, "id", "left").select("id", ((1 + F.coalesce("sb", F.lit(0.0))) / 2).alias("b"))
    twice = edges.join(first.toDF("dst", "b"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("s") * F.col("b")).alias("sb"))
    out = tables.cut(first.join(twice, "id", "left").select("id", F.col("b").alias("before"), F.coalesce("sb", F.lit(0.0)).alias("sb")))
    # Collatz: no value of a non-negative operator exceeds the largest ratio of a product to a positive vector.
    return out.select("id", ((F.col("before") + F.col("sb")) / 2).alias("b")), float(out.agg(F.max(F.col("sb") / F.col("before"))).first()[0])


def gathered(edges: DataFrame, ids: DataFrame, n: int, ratio: int, tables: Tables) -> DataFrame | None:
    """(id, seed): each node with the seed whose growth reached it first, along the stronger edge; None if that takes too long."""
    h, place = lambda c: F.xxhash64(F.lit(SEED), c), tables.place()
    have = turn = 0

    def grown(new: DataFrame) -> int:
        """The rows of one more step, written beside the others."""
        nonlocal have, turn
        path, turn = f"{place}/step={turn}", turn + 1
        new.write.parquet(path)
        found = ids.sparkSession.read.schema("id long, seed long").parquet(path).count()
        have += found
        return found

    grown(ids.where(F.pmod(h("id"), F.lit(ratio)) == 0).select("id", F.col("id").alias("seed")))
    while have < n and turn <= GROWTH:
        named = ids.sparkSession.read.schema("id long, seed long, step int").parquet(place).select("id", "seed")
        rest = ids.join(named, "id", "left_anti")
        open_ = edges.join(rest.withColumnRenamed("id", "src"), "src")
        if not grown(open_.join(named.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.max_by("seed", F.struct("s", "dst")).alias("seed")).withColumnRenamed("src", "id")):
            # What no seed can reach: nodes before all their neighbours are seeds.
            near = open_.where("src <> dst").groupBy("src").agg(F.min(h("dst")).alias("least")).withColumnRenamed("src", "id")
            grown(rest.join(near, "id", "left").where(F.col("least").isNull() | (h("id") <= F.col("least"))).select("id", F.col("id").alias("seed")))
    return ids.sparkSession.read.schema("id long, seed long, step int").parquet(place).select("id", "seed") if have >= n else None


def parted(coarse: np.ndarray, load: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gathering, by halving again and again along the second vector of what is to be halved."""
    links = coarse - np.diag(np.diag(coarse))
    out = np.zeros(len(load), np.int64)

    def halve(own: np.ndarray, k: int, first: int) -> None:
        if k == 1 or len(own) == 1:
            out[own] = first
            return
        s = links[np.ix_(own, own)]
        root = np.sqrt(s.sum(1) + 1e-300)
        order = np.argsort(np.linalg.eigh(s / root[:, None] / root)[1][:, -2] / root, kind="stable")
        sums = np.cumsum(load[own][order])
        at = min(max(int(np.searchsorted(sums, sums[-1] * (k // 2) / k)), 1), len(own) - 1)
        halve(own[order[:at]], k // 2, first)
        halve(own[order[at:]], k - k // 2, first + k // 2)

    halve(np.arange(len(load)), parts, 0)
    return out


def _pack(part: pa.Table) -> pa.Table:
    """One row of a part's edges (src, layer, dst, s, agg, b, dst_agg, dst_b, near): home nodes first, then its layers, then what these touch."""
    src, dst, layer = part["src"].to_numpy(), part["dst"].to_numpy(), part["layer"].to_numpy()
    mine, at = np.unique(src, return_index=True)
    away = layer[at] > 0
    touched, where = np.unique(dst, return_index=True)
    outer = ~np.isin(touched, mine)
    ids = np.concatenate([mine[~away], mine[away], touched[outer]])
    first = np.concatenate([at[~away], at[away]])
    agg = np.concatenate([part["agg"].to_numpy()[first], part["dst_agg"].to_numpy()[where[outer]]])
    b = np.concatenate([part["b"].to_numpy()[first], part["dst_b"].to_numpy()[where[outer]]])
    order = np.argsort(ids)
    place = lambda x: order[np.searchsorted(ids[order], x)].astype(np.int32)
    said = part.filter(pa.compute.is_valid(part["near"]))
    near = said["near"].combine_chunks()
    counts = pa.compute.list_value_length(near).to_numpy(zero_copy_only=False) if len(near) else np.zeros(0, np.int64)
    kept = part["s"].to_numpy() != 0
    lists = [ids, agg.astype(np.int32), b, place(src)[kept], place(dst)[kept], part["s"].to_numpy()[kept], np.repeat(place(said["src"].to_numpy()), counts), near.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]
    head = [part["part"][:1].combine_chunks().cast(pa.int32()), pa.array([int((~away).sum())], pa.int32()), pa.array([len(mine)], pa.int32())]
    return pa.Table.from_arrays([*head, *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]], schema=PACKED)


class _Part:
    """A part's row as arrays; blocks are columns by nodes."""

    def __init__(self, packed: pa.Table):
        flat = lambda c: packed[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.home, self.inside = packed["home"][0].as_py(), packed["inside"][0].as_py()
        self.ids, self.agg, self.b, self.src, self.dst, self.s, self.row, self.to = (flat(c) for c in PACKED.names[3:])

    def placed(self, rows: pa.Table) -> np.ndarray:
        v = _wide(rows["v"])
        out = np.zeros((v.shape[1], self.inside))
        order = np.argsort(self.ids[:self.inside])
        out[:, order[np.searchsorted(self.ids[order], rows["id"].to_numpy())]] = v.T
        return out

    def times(self, x: np.ndarray, which: np.ndarray | slice = slice(None), n: int | None = None) -> np.ndarray:
        src, dst, s, n = self.src[which], self.dst[which], self.s[which], n or self.inside
        return np.stack([np.bincount(src, s * column[dst], n)[:n] for column in x])

    def solved(self, r: np.ndarray, tau: float, high: float) -> np.ndarray:
        """Chebyshev iteration on (tau - S) e = r with nothing outside the part and its layers."""
        own = np.flatnonzero(self.dst < self.inside)
        middle, half = high * (1 + 1 / SPREAD) / 2, high * (1 - 1 / SPREAD) / 2
        sigma, rho = middle / half, half / middle
        step = r / middle
        e = step.copy()
        for _ in range(STEPS - 1):
            off = r - tau * e + self.times(e, own)
            following = 1 / (2 * sigma - rho)
            step = following * rho * step + 2 * following / half * off
            e, rho = e + step, following
        return e


class Domains:
    """A non-negative operator in parts that lie together, each with some layers of nodes around, and its coarse operator."""

    def __init__(self, nodes: DataFrame, packed: DataFrame, coarse: np.ndarray, mass: np.ndarray, bound: float):
        self.nodes, self.packed, self.bound = nodes, packed, bound
        root = np.sqrt(mass)
        values, vectors = np.linalg.eigh(coarse / root[:, None] / root)
        self.values, self.vectors = values[::-1], vectors[:, ::-1] / root[:, None]

    @staticmethod
    def built(operator, ids: DataFrame, part: int, tables: Tables) -> Domains | None:
        """None where gathering does not come to few gatherings of bounded size."""
        n = ids.count()
        links = operator.edges.select("src", "dst", "s")
        b, bound = even(links, ids, tables)
        named = gathered(links, ids, n, max(RATIO, n // COARSE), tables)
        if named is None or not np.isfinite(bound) or bound <= 0:
            return None
        seeds = sorted(r["seed"] for r in named.select("seed").distinct().limit(2 * COARSE + 1).collect())
        if not 1 < len(seeds) <= 2 * COARSE:
            return None
        spark = ids.sparkSession
        numbers = F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "seed long, agg int"))
        nodes = tables.cut(named.join(numbers, "seed").join(b, "id").select("id", "agg", "b"))
        source, target = nodes.toDF("src", "agg", "b"), nodes.toDF("dst", "dst_agg", "dst_b")
        edges = tables.cut(links.join(source, "src").join(target, "dst"))
        coarse, mass, load = np.zeros((len(seeds), len(seeds))), np.zeros(len(seeds)), np.zeros(len(seeds))
        for r in edges.groupBy("agg", "dst_agg").agg(F.sum(F.col("s") * F.col("b") * F.col("dst_b")).alias("s"), F.count(F.lit(1)).alias("n")).collect():
            coarse[r["agg"], r["dst_agg"]] = r["s"]
            load[r["agg"]] += r["n"]
        for r in nodes.groupBy("agg").agg(F.sum(F.col("b") ** 2).alias("b")).collect():
            mass[r["agg"]] = r["b"]
        if load.max() > part:
            return None
        coarse = (coarse + coarse.T) / 2
        of = parted(coarse, load + 1, max(1, min(len(seeds), round(np.ceil(load.sum() / part)))))
        parts = lambda agg, name: F.broadcast(spark.createDataFrame([(k, int(p)) for k, p in enumerate(of)], f"{agg} int, {name} int"))
        home = nodes.join(parts("agg", "part"), "agg").select("part", "id")
        across = edges.join(parts("dst_agg", "dst_part"), "dst_agg")
        place, every = tables.place(), None
        for layer in range(LAYERS + 1):
            out = home
            if layer:
                around = every.where(F.col("layer") == layer - 1).join(across.withColumnRenamed("src", "id"), "id").where("dst_part <> part").select("part", F.col("dst").alias("id")).distinct()
                out = around.join(every, ["part", "id"], "left_anti")
            out.write.parquet(f"{place}/layer={layer}")
            every = spark.read.schema("part int, id long, layer int").parquet(place)
        all_edges = every.withColumnRenamed("id", "src").join(edges, "src")
        if all_edges.groupBy("part").count().agg(F.max("count")).first()[0] > WIDER * part:
            return None
        routes = every.groupBy("id").agg(F.collect_list(F.when(F.col("layer") <= 1, F.col("part"))).alias("near"), F.collect_list("part").alias("to"))
        state = tables.cut(nodes.join(routes, "id").select("id", "agg", "b", "near", "to"))
        alone = every.withColumnRenamed("id", "src").join(state.withColumnRenamed("id", "src"), "src").select(
            "part", "src", "layer", F.col("src").alias("dst"), F.lit(0.0).alias("s"), "agg", "b", F.col("agg").alias("dst_agg"), F.col("b").alias("dst_b"), F.when(F.col("layer") == 0, F.col("near")).alias("near"))
        rows = all_edges.withColumn("near", F.lit(None).cast("array<int>")).select(*alone.columns).unionByName(alone)
        packed = tables.cut(rows.groupBy("part").applyInArrow(_pack, PACKED_SQL))
        return Domains(state.drop("near"), packed, coarse, mass, bound)

    def corrected(self, messages: DataFrame, tau: float, coarse: np.ndarray) -> DataFrame:
        """(part, id, v): of residuals (part, id, v) the corrections, sent to every part that touches a node. coarse is that of the gatherings."""
        high, schema = tau + self.bound, pa.schema([("part", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

        def run(packed: pa.Table, rows: pa.Table) -> pa.Table:
            if not len(packed) or not len(rows):
                return schema.empty_table()
            p = _Part(packed)
            rough = p.b * coarse[p.agg].T
            e = rough[:, :p.inside] + p.solved(p.placed(rows) - tau * rough[:, :p.inside] + p.times(rough), tau, high)
            return pa.Table.from_arrays([pa.array(p.to), pa.array(p.ids[p.row]), _lists(e.T[p.row])], schema=schema)

        return self.packed.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(run, "part int, id long, v array<double>")

    def times(self, messages: DataFrame) -> DataFrame:
        """(id, v, w): vectors (part, id, v) of the parts' own nodes and what they touch, and the operator times them."""
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])

        def run(packed: pa.Table, rows: pa.Table) -> pa.Table:
            if not len(packed) or not len(rows):
                return schema.empty_table()
            p = _Part(packed)
            v = p.placed(rows)
            w = p.times(v, np.flatnonzero(p.src < p.home), p.home)
            return pa.Table.from_arrays([pa.array(p.ids[:p.home]), _lists(v[:, :p.home].T), _lists(w.T)], schema=schema)

        return self.packed.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(run, "id long, v array<double>, w array<double>")


def _moved(state: DataFrame, turn: np.ndarray, last: np.ndarray, theta: np.ndarray) -> DataFrame:
    """state's (x, y) turned to the block and its last step, with v, the residuals of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.hstack([turn, last])
        for batch in batches:
            if len(batch):
                x, y = _wide(batch.column("x")) @ both, _wide(batch.column("y")) @ both
                v = y[:, :len(theta)] - x[:, :len(theta)] * theta
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "agg", "b", "to")], _lists(x), _lists(y), _lists(v)], names=["id", "agg", "b", "to", "x", "y", "v"])

    return state.select("id", "agg", "b", "to", "x", "y").mapInArrow(run, "id long, agg int, b double, to array<int>, x array<double>, y array<double>, v array<double>")


def _sums(state: DataFrame, size: int, width: int, theta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x'x, x'y, squares of the residuals that the block had at values theta, and sums of (x, y) times b over gatherings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = np.zeros((2 * width + 1, width)), np.zeros((size, 2 * width))
        for batch in batches:
            if len(batch):
                x, y = _wide(batch.column("x")), _wide(batch.column("y"))
                own[:width] += x.T @ x
                own[width:2 * width] += x.T @ y
                if theta is not None:
                    own[-1, :len(theta)] += ((y[:, :len(theta)] - x[:, :len(theta)] * theta) ** 2).sum(0)
                agg = batch.column("agg").to_numpy()
                order = np.argsort(agg, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], agg[order][1:] != agg[order][:-1]]))
                parts[agg[order][starts]] += np.add.reduceat((np.hstack([x, y]) * batch.column("b").to_numpy()[:, None])[order], starts, axis=0)
        has = np.flatnonzero(parts.any(1))
        wide = np.concatenate([np.hstack([own, np.zeros_like(own)]), parts[has]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(len(own)), has])), _lists(wide)], names=["id", "v"])

    out = np.zeros((2 * width + 1, width)), np.zeros((size, 2 * width))
    rows = state.select("agg", "b", "x", "y").mapInArrow(run, "id long, v array<double>").groupBy("id").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("id", vector_to_array("v").alias("v"))
    for r in rows.collect():
        if r["id"] < 0:
            out[0][-1 - r["id"]] = r["v"][:width]
        else:
            out[1][r["id"]] = r["v"]
    return out[0][:width], out[0][width:2 * width], out[0][-1], out[1]


def start(operator, ids: DataFrame, random: DataFrame, wanted: int, width: int, tolerance: float, part: int, tables: Tables) -> DataFrame | None:
    """(id, v): the `wanted` leading modes to residual norms of about the tolerance; after ROUNDS more columns near them; or None.

    random(id, v) has at least as many columns and gives each of them a part outside the gatherings.
    """
    domains = Domains.built(operator, ids, part, tables)
    if domains is None:
        return None
    width = min(width, wanted + BESIDE, len(domains.values) - 1)
    if width < wanted:
        return None
    size, shape = len(domains.values), domains.vectors[:, :width]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                b = batch.column("b").to_numpy()[:, None]
                x = b * (shape[batch.column("agg").to_numpy()] + 1e-3 * _wide(batch.column("v"))[:, :width] * np.abs(shape).max())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "agg", "b", "to")], _lists(x)], names=["id", "agg", "b", "to", "v"])

    def sent(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("to").alias("part"), "id", "v")

    state = tables.cut(domains.nodes.join(random, "id").mapInArrow(begin, "id long, agg int, b double, to array<int>, v array<double>"))
    state = tables.cut(state.drop("v").join(domains.times(sent(state)).withColumnsRenamed({"v": "x", "w": "y"}), "id"))
    theta, columns = None, width
    for round_ in range(ROUNDS + 1):
        squares, projected, left, sums = _sums(state, size, columns, theta)
        scale = 1 / np.sqrt(np.maximum(np.diag(squares), 1e-300))
        weight, turn = np.linalg.eigh(squares * scale[:, None] * scale)
        kept = weight > 1e-12
        turn = scale[:, None] * turn[:, kept] / np.sqrt(weight[kept])
        values, small = np.linalg.eigh(turn.T @ (projected + projected.T) / 2 @ turn)
        small = turn @ small[:, ::-1][:, :width]
        done = theta is not None and np.sqrt(left[:wanted].max()) <= tolerance
        theta = values[::-1][:width]
        if done or round_ == ROUNDS or len(theta) < width:
            break
        last = small.copy()
        last[:width] = 0
        last = last if round_ else last[:, :0]
        tau = float(theta[0] + max(0.2 * (theta[0] - theta[-1]), 1e-6 * domains.bound))
        restricted = sums[:, columns:] @ small - sums[:, :columns] @ small * theta
        rough = domains.vectors @ ((domains.vectors.T @ restricted) / np.maximum(tau - domains.values, 1e-6 * domains.bound)[:, None])
        moved = _moved(state, small, last, theta)
        found = domains.times(domains.corrected(sent(moved), tau, rough))
        state = tables.cut(moved.drop("v").join(found, "id").select("id", "agg", "b", "to", F.concat("x", "v").alias("x"), F.concat("y", "w").alias("y")))
        columns = 2 * width + last.shape[1]
    small, theta = (small[:, :wanted], theta[:wanted]) if done else (small, theta)
    return tables.cut(_moved(state, small, small[:, :0], theta).select("id", F.col("x").alias("v")))
