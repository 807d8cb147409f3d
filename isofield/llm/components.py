"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.llm.common import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition, replaced by links of each node to the smallest node it reaches there."""
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[label[keep]]), pa.array(nodes[keep])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a long, b long); component is the smallest node it reaches.

    Alternates hanging every neighbour that is larger on the smallest neighbour with hanging a node's smaller
    neighbours on the smallest of them, until nothing changes; each round is an aggregate and a join by node, and is
    written to the shared folder. The number of rounds grows with the logarithm of the longest chain. Self-links and
    repeated links do no harm; nodes without links to others are absent.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .mapInArrow(_forest, "a long, b long").distinct(), "links")
        last = None
        while True:
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
                edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = scratch.cut(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
            scratch.drop(edges)
            small_least = large.groupBy("b").agg(F.min("a").alias("m"))
            small = large.join(small_least, "b")
            edges = scratch.cut(small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(
                small_least.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y")
                .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small-star")
            scratch.drop(large)
            state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
            if state == last:
                break
            last = state
        scratch.keep(edges)
    hung = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return hung.unionByName(roots)
