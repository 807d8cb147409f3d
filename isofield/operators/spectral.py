"""Leading eigenpairs of a symmetric operator held as an edge table, in blocks that are locked one after the other."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.operators import domains
from isofield.sources.blocks import BlockStore
from isofield.sources.shared import Tables

#: Seed of the start blocks.
SEED = 11
#: Modes of a block at most: no row carries more than so many doubles.
BLOCK = 64
#: Edges of a part of the operator, and doubles of a file of vectors.
PART, FILE = 100_000, 2_000_000
#: Products of a filter at most, products of one job, and how far a filter may raise one mode over another.
DEGREE, CHAIN, RAISE = 40, 8, 1e8
VECTOR = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])


def _wide(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _summed(rows: DataFrame) -> DataFrame:
    """(id, v): arrays of one id added, first in tasks, then over tasks."""
    return rows.groupBy("id").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("id", vector_to_array("v").alias("v"))


class Operator:
    """A symmetric operator (src, dst, s), dealt out once to parts of bounded size.

    An edge's part comes from its source; sources with more edges than a tenth of a part are spread over several. A
    product sends each part the vectors of the nodes it needs, once for a part and not once for an edge, multiplies
    within the part and adds what parts found for the same node.
    """

    def __init__(self, edges: DataFrame, tables: Tables, part: int = PART):
        said = edges.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least")).first()
        n, self.least = said["n"], said["least"]
        parts = self.parts = max(1, math.ceil(n / part))
        degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part // 10)
        spread = F.pmod(F.xxhash64("dst"), F.coalesce(F.ceil(F.col("n") / (part // 10)), F.lit(1)))
        self.edges = tables.cut(edges.select("src", "dst", "s").join(degree, "src", "left").select(
            "src", "dst", "s", F.pmod(F.xxhash64("src", spread), F.lit(parts)).cast("int").alias("part")), parts)
        self.needs = tables.cut(self.edges.select("part", "dst").distinct(), parts)
        self.homes: DataFrame | None = None

    def times(self, block: DataFrame) -> DataFrame:
        """(id, v): the operator times block(id, v); nodes without edges are absent."""
        def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
            if not len(vectors):
                return VECTOR.empty_table()
            src, total = _product(edges, vectors)
            return pa.Table.from_arrays([pa.array(src), _lists(total)], schema=VECTOR)

        sent = self.needs.join(block.select(F.col("id").alias("dst"), "v"), "dst")
        found = self.edges.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, "id long, v array<double>")
        return _summed(found)

    def settle(self, ids: DataFrame, tables: Tables) -> None:
        """Give every node of ids one part that is its home, for advance()."""
        if self.homes is None:
            home = ids.select(F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part"), F.col("id").alias("dst"), F.lit(True).alias("home"))
            both = self.needs.withColumn("home", F.lit(False)).unionByName(home)
            self.homes = tables.cut(both.groupBy("part", "dst").agg(F.max("home").alias("home")), self.parts)

    def advance(self, state: DataFrame, a: float, b: float, c: float) -> DataFrame:
        """(id, v, w) to (id, a S v + b v + c w, v), reading state once, so that steps may follow each other in one job.

        A null w counts as zero. Only a node's home sends its old vectors on.
        """
        schema = pa.schema([*VECTOR, ("w", pa.list_(pa.float64()))])

        def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
            out = []
            own = vectors.filter(vectors["home"]) if len(vectors) else vectors
            if len(own):
                v = _wide(own["v"])
                total = b * v + c * _wide(own["w"]) if not own["w"].null_count else b * v
                out.append(pa.Table.from_arrays([own["dst"], _lists(total), _lists(v)], schema=schema))
            if len(vectors) and len(edges):
                src, total = _product(edges, vectors)
                out.append(pa.Table.from_arrays([pa.array(src), _lists(a * total), pa.nulls(len(src), pa.list_(pa.float64()))], schema=schema))
            return pa.concat_tables(out) if out else schema.empty_table()

        sent = self.homes.join(state.withColumnRenamed("id", "dst"), "dst").select("part", "dst", "home", "v", F.when(F.col("home"), F.col("w")).alias("w"))
        found = self.edges.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, "id long, v array<double>, w array<double>")
        return found.groupBy("id").agg(Summarizer.sum(array_to_vector("v")).alias("v"), F.first("w", True).alias("w")).select("id", vector_to_array("v").alias("v"), "w")


def filtered(operator: Operator, start: DataFrame, ids: DataFrame, degree: int, low: float, cut: float, high: float, tables: Tables, files: int) -> DataFrame:
    """(id, v): start(id, v) through a Chebyshev polynomial of S that damps values from low to cut and is about 1 at high."""
    operator.settle(ids, tables)
    half, centre = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (high - centre)
    state = start.select("id", "v", F.lit(None).cast("array<double>").alias("w"))
    for k in range(degree):
        if not k:
            state = operator.advance(state, sigma / half, -centre * sigma / half, 0.0)
        else:
            following = 1 / (2 / first - sigma)
            state = operator.advance(state, 2 * following / half, -2 * centre * following / half, -sigma * following)
            sigma = following
        if (k + 1) % CHAIN == 0 or k + 1 == degree:
            state = tables.cut(state, files)
    return state.select("id", "v")


def _degree(low: float, cut: float, high: float, last: float, wanted: float) -> int:
    """Products that raise a mode of value high at most RAISE times over one at the cut, or that of value last as often as wanted."""
    growth = lambda value: math.acosh(max((2 * value - cut - low) / (cut - low), 1 + 1e-9))
    return max(1, min(DEGREE, int(math.acosh(RAISE) / growth(high)), math.ceil(math.acosh(max(wanted, 2.0)) / growth(last))))


def _product(edges: pa.Table, vectors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(src, sums) of a part's edges times the vectors (dst, v) it was sent."""
    ids, v = vectors["dst"].to_numpy(), _wide(vectors["v"])
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
    at = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    weight = np.where(ids[at] == dst, edges["s"].to_numpy(), 0.0)
    by = np.argsort(src, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], src[by][1:] != src[by][:-1]]))
    return src[by][starts], np.add.reduceat(weight[by, None] * v[at[by]], starts, axis=0)


def _mapped(rows: DataFrame, turn: dict[int, np.ndarray] | np.ndarray) -> DataFrame:
    """(id, v @ turn) of rows(id, v), or of rows(id, block, v) with a matrix for each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            if isinstance(turn, np.ndarray):
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(_wide(batch.column("v")) @ turn)], schema=VECTOR)
                continue
            which = batch.column("block").to_numpy()
            for k in np.unique(which):
                own = batch.filter(pa.array(which == k))
                yield pa.RecordBatch.from_arrays([own.column("id"), _lists(_wide(own.column("v")) @ turn[int(k)])], schema=VECTOR)

    return rows.mapInArrow(run, "id long, v array<double>")


def _inner_rows(basis: DataFrame, block: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            which = batch.column("block").to_numpy()
            for k in np.unique(which):
                own = batch.filter(pa.array(which == k))
                total[int(k)] = total.get(int(k), 0) + _wide(own.column("v")).T @ _wide(own.column("w"))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([list(map(float, (g.shape[0], *g.ravel()))) for g in total.values()], pa.list_(pa.float64()))], schema=VECTOR)

    joined = basis.join(block.select("id", F.col("v").alias("w")), "id").select("block", "v", "w")
    # The first entry of a matrix is its number of rows, once for each task that sent one.
    rows = joined.mapInArrow(run, "id long, v array<double>").groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("n"), Summarizer.sum(array_to_vector("v")).alias("v"))
    return rows.select("id", F.concat(F.array("n"), vector_to_array("v")).alias("v"))


def _matrices(rows) -> dict[int, np.ndarray]:
    return {r["id"]: np.array(r["v"][2:]).reshape(round(r["v"][1] / r["v"][0]), -1) for r in rows}


def inner(basis: DataFrame, block: DataFrame) -> dict[int, np.ndarray]:
    """For each block of basis(id, block, v) its inner products with block(id, v); each task sends one small matrix a block."""
    return _matrices(_inner_rows(basis, block).collect())


def without(block: DataFrame, basis: DataFrame, products: dict[int, np.ndarray]) -> DataFrame:
    """block(id, v) less the basis' part in it."""
    if not products:
        return block
    return _summed(block.select("id", "v").unionByName(_mapped(basis, {k: -c for k, c in products.items()})))


def triangle_rows(block: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if len(batch):
                x = _wide(batch.column("v"))
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(r)), pa.int64()), _lists(r)], schema=VECTOR)

    return block.select("id", "v").mapInArrow(run, "id long, v array<double>").repartition(4).mapInArrow(run, "id long, v array<double>")


def triangle(rows) -> np.ndarray:
    """R of the QR of a tall block: of tasks, of groups of tasks (triangle_rows), and of those few on the driver."""
    x = [r["v"] for r in rows]
    return np.linalg.qr(np.array(x, float), mode="r") if x else np.zeros((0, 0))


def inner_and_triangle(basis: DataFrame, block: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """inner() and the triangle of block in one job."""
    rows = _inner_rows(basis, block).withColumn("which", F.lit(0)).unionByName(triangle_rows(block).withColumn("which", F.lit(1))).collect()
    return _matrices([r for r in rows if r["which"] == 0]), triangle([r for r in rows if r["which"] == 1])


def _orthonormal(r: np.ndarray, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(turn, back) of a block with triangle r: block @ turn is orthonormal and spans the block up to parts below `least` of the largest; block = (block @ turn) @ back."""
    _, s, t = np.linalg.svd(r)
    keep = s > max(s[0] * least, 1e-13) if len(s) else np.zeros(0, bool)
    return t.T[:, :len(s)][:, keep] / s[keep], s[keep, None] * t[:len(s)][keep]


@dataclass
class Modes:
    """Eigenvalues, largest first, residual norms |S v - value v| and the table of vectors (id, block, v)."""
    values: np.ndarray
    residuals: np.ndarray
    vectors: DataFrame
    tolerance: float

    @property
    def converged(self) -> np.ndarray:
        return self.residuals <= self.tolerance

    def table(self) -> DataFrame:
        """(id, mode, value) of every node and mode."""
        width = self.vectors.groupBy("block").agg(F.max(F.size("v")).alias("n")).collect()
        start, at = {}, 0
        for r in sorted(width, key=lambda r: r["block"]):
            start[r["block"]], at = at, at + r["n"]
        shift = F.create_map(*[F.lit(x) for k, n in start.items() for x in (k, n)])
        return self.vectors.select("id", "block", F.posexplode("v").alias("place", "value")).select("id", (shift[F.col("block")] + F.col("place")).alias("mode"), "value")


class Unconverged(RuntimeError):
    """Residual norms stayed above the tolerance."""


def continued(edges: DataFrame, nodes: DataFrame, total: int, store: BlockStore, block: int = BLOCK, spare: int = 16, depth: int = 12, restarts: int = 8, tolerance: float = 1e-8, strict: bool = True) -> Modes:
    """The `total` largest eigenpairs, going on from whatever blocks the store already holds.

    Each block of at most `block` modes is found with all earlier ones locked: a Krylov space of blocks (`spare` columns
    wider) is grown, every
    product is freed of the locked modes and of the space in two passes and made orthonormal by a tree of QR factors, and
    Rayleigh-Ritz on the small projected operator gives values and residual norms at every step. A space of `depth`
    blocks starts anew from its best vectors. Where such a space could not come to hold every node, it stays short, and
    its best vectors first pass a Chebyshev polynomial that damps values below theirs, several products in one job. The first
    block of a large operator without negative entries starts from vectors of domains.start, which are found in few rounds; they
    are held to the same tests as any others. The accepted block is audited with a product of its own, its signs are
    fixed (the largest component is positive, ties by the smaller id) and it is written with values and residuals in its
    manifest; a run that was killed goes on after its last block. Only matrices of the size of a block, or of the
    Krylov space, reach the driver.

    strict raises Unconverged where a block's residuals stay above the tolerance after the last restart; otherwise they are
    returned as they are, and Modes.converged says which are good. A graph with fewer nodes than total gives as many modes.
    """
    done = store.completed()
    values = [v for m in done for v in m["values"]]
    residuals = [r for m in done for r in m["residuals"]]
    n = nodes.select("id").distinct().count()
    total = min(total, n)
    spark = nodes.sparkSession
    with Tables(spark) as tables:
        operator, ids = None, tables.cut(nodes.select("id").distinct(), max(1, n // FILE))
        while len(values) < total:
            operator = operator or Operator(edges, tables)
            k = len(done)
            m = min(block, total - len(values))
            files = max(1, n * m // FILE)
            locked = store.read(0, k - 1).select("id", "block", "v") if k else None
            own, found, left = _block(operator, ids, locked, m, n - len(values), k, spare, depth, restarts, tolerance, tables, files, max(values, default=-math.inf))
            if strict and left.max() > tolerance:
                raise Unconverged(f"block {k}: residual norm {left.max():.3e} exceeds {tolerance:.1e}")
            store.write(k, own.coalesce(files), values=found.tolist(), residuals=left.tolist())
            done.append({"values": found.tolist(), "residuals": left.tolist()})
            values += found.tolist()
            residuals += left.tolist()
    blocks, seen = 0, 0
    while seen < total:
        seen += len(done[blocks]["values"])
        blocks += 1
    vectors = store.read(0, blocks - 1).select("id", "block", "v")
    if seen > total:
        last = len(done[blocks - 1]["values"]) - (seen - total)
        vectors = vectors.withColumn("v", F.when(F.col("block") == blocks - 1, F.slice("v", 1, last)).otherwise(F.col("v")))
    return Modes(np.array(values[:total]), np.array(residuals[:total]), vectors, tolerance)


def _block(operator: Operator, ids: DataFrame, locked: DataFrame | None, m: int, room: int, number: int, spare: int, depth: int, restarts: int, tolerance: float, tables: Tables,
           files: int, highest: float = -math.inf) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(vectors, values, residuals) of the m largest modes beside the locked ones, of which the largest has the value highest."""
    width = min(room, m + spare)
    short, low = room > depth * width, math.inf
    save = lambda df: tables.cut(df, files)
    random = F.array(*[(F.pmod(F.xxhash64(F.lit(SEED + number), F.lit(c), "id"), F.lit(1 << 40)).cast("double") / float(1 << 40) - 0.5) for c in range(width)])
    start = save(ids.select("id", random.alias("v")))
    if short and locked is None and room >= domains.LEAST and operator.least is not None and operator.least >= 0:
        near = domains.start(operator, ids, start, m, width, tolerance / 4, PART, tables)
        start = start if near is None else near
    for restart in range(restarts + 1):
        if locked is not None:
            for _ in range(2):
                start = save(without(start, locked, inner(locked, start)))
        turn, _ = _orthonormal(triangle(triangle_rows(start).collect()))
        place, sizes, projected = tables.place(), [turn.shape[1]], np.zeros((0, 0))
        next_ = _mapped(start, turn)
        while True:
            k = len(sizes) - 1
            next_.coalesce(files).write.parquet(f"{place}/block={k}")
            basis = ids.sparkSession.read.schema("id long, v array<double>, block int").parquet(place).select("id", "block", "v")
            product = save(operator.times(basis.where(F.col("block") == k)))
            # Locked blocks count as -1, -2, ... beside those of the space.
            both = basis.coalesce(files * (k + 1))
            both = both if locked is None else both.unionByName(locked.select("id", (-1 - F.col("block")).alias("block"), "v"))
            first = inner(both, product)
            rest = save(without(product, both, first))
            second, r = inner_and_triangle(both, rest)
            turn, back = _orthonormal(r)
            edges_ = np.concatenate([[0], np.cumsum(sizes)])
            grown = np.zeros((edges_[-1], edges_[-1]))
            grown[:len(projected), :len(projected)] = projected
            for j in range(k + 1):
                part = sum((p[j] for p in (first, second) if j in p), np.zeros((sizes[j], sizes[k])))
                grown[edges_[j]:edges_[j + 1], edges_[k]:] = part
                grown[edges_[k]:, edges_[j]:edges_[j + 1]] = part.T
            projected = grown
            theta, ritz = np.linalg.eigh((projected + projected.T) / 2)
            order = np.argsort(theta)[::-1]
            theta, ritz = theta[order], ritz[:, order]
            good = min(m, len(theta))
            estimate = np.linalg.norm(back @ ritz[edges_[k]:, :good], axis=0) if back.size else np.zeros(good)
            whole = not back.size or edges_[-1] >= room
            passed = len(theta) >= m and estimate.max() <= tolerance / 4
            if passed or whole or len(sizes) == (depth if not short else min(depth, 1 if restart else 2)):
                break
            # The second pass and the turn to an orthonormal block in one step.
            next_ = _mapped(without(rest, both, second), turn)
            sizes.append(turn.shape[1])
        kept = min(width, len(theta))
        start = save(_summed(_mapped(basis, {j: ritz[edges_[j]:edges_[j + 1], :kept] for j in range(len(sizes))})))
        if passed or whole or restart == restarts:
            break
        if short:
            # No value lies far beyond those of the space and what its last block leaves over.
            left = float(np.linalg.norm(back, 2))
            low, high = min(low, float(theta[-1]) - left), max(highest, float(theta[0]) + left)
            edge = float(theta[kept - 1])
            if low < edge < theta[0]:
                degree = _degree(low, edge, high, float(theta[good - 1]), 10 * float(estimate.max()) / (tolerance / 4))
                start = filtered(operator, start, ids, degree, low, edge, float(theta[0]), tables, files)
    m = min(m, kept)
    vectors = save(_signed(_mapped(start, np.eye(kept)[:, :m]), m))
    product = operator.times(vectors)
    gaps = ids.select("id").join(vectors, "id").join(product.select("id", F.col("v").alias("y")), "id", "left")
    off = F.zip_with(F.coalesce("y", F.array(*[F.lit(0.0)] * m)), F.zip_with("v", F.array(*[F.lit(float(t)) for t in theta[:m]]), lambda a, t: a * t), lambda a, b: (a - b) * (a - b))
    norms = gaps.select(array_to_vector(off).alias("e")).agg(Summarizer.sum(F.col("e")).alias("e")).first()["e"]
    return vectors, theta[:m].copy(), np.sqrt(np.array(norms.toArray()))


def _signed(rows: DataFrame, m: int) -> DataFrame:
    size = lambda k: F.struct(F.abs(F.get("v", F.lit(k))), -F.col("id"))
    best = rows.agg(*[F.max_by(F.signum(F.get("v", F.lit(k))), size(k)).alias(f"s{k}") for k in range(m)])
    signs = best.select(F.array(*[F.col(f"s{k}") for k in range(m)]).alias("signs"))
    return rows.crossJoin(F.broadcast(signs)).select("id", F.zip_with("v", "signs", lambda a, s: a * F.when(s < 0, -1.0).otherwise(1.0)).alias("v"))


def generator(values: np.ndarray, scale: float | None = None) -> np.ndarray:
    """max(1 - value, 0) over its median among positive non-constant modes, or over a fixed scale."""
    raw = np.maximum(1 - values, 0)
    rest = raw[1:][raw[1:] > 0]
    unit = scale if scale else (float(np.median(rest)) if len(rest) else 1.0)
    return raw / unit


def matched(new: DataFrame, old: DataFrame, weight: DataFrame, old_values: np.ndarray, gap: float = 1e-6) -> tuple[DataFrame, list[dict]]:
    """Bring new modes back onto old ones: (id, v) aligned, and what was found of each group of near-equal values.

    new and old are (id, v) with as many modes, weight(id, w) is the measure in which they are orthonormal. Old values that
    differ by at most gap from the one before are a group, whose modes may be mixed, swapped or negated. The block of inner
    products of a group has the singular values that are the cosines of the principal angles between both spans; its
    polar factor is the rotation that brings the new modes closest to the old. A group's row says its first and last mode,
    the least cosine, the signs of the diagonal and the largest deviation of an aligned mode from its old one.
    """
    scaled = old.join(weight, "id").select("id", F.lit(0).alias("block"), F.transform("v", lambda x: x * F.col("w")).alias("v"))
    cross = inner(scaled, new)[0]  # old by new
    m = len(cross)
    starts = [0, *[k for k in range(1, m) if abs(old_values[k] - old_values[k - 1]) > gap], m]
    turn, groups = np.zeros((m, m)), []
    for a, b in zip(starts, starts[1:]):
        u, s, t = np.linalg.svd(cross[a:b, a:b])
        turn[a:b, a:b] = (u @ t).T
        groups.append({"first": a, "last": b - 1, "least_cosine": float(s.min()), "signs": np.sign(np.diag(cross)[a:b]).astype(int).tolist()})
    aligned = _mapped(new, turn)
    off = F.zip_with("a.v", "b.v", lambda x, y: F.abs(x - y))
    far = aligned.alias("a").join(old.alias("b"), "id").select(F.posexplode(off).alias("mode", "off")).groupBy("mode").agg(F.max("off").alias("off")).collect()
    largest = {r["mode"]: r["off"] for r in far}
    for g in groups:
        g["largest_deviation"] = max(largest[k] for k in range(g["first"], g["last"] + 1))
    return aligned, groups
