"""Near-duplicate vectors: coarse lists, residual codes, table look-ups over sufficient probes, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.llm import ivfpq
from isofield.llm.common import cut
from isofield.llm.components import components

THRESHOLD = 0.93
#: Rows of a list that one task holds against as many others.
BLOCK = 4096
LIST_ROWS = 2048
#: Code distances, and queries, that are held at once.
CELLS, TOGETHER = 1_000_000, 512


def near(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         threshold: float = THRESHOLD, max_train: int = ivfpq.MAX_TRAIN) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least threshold.
    Equal vectors of a label are one class, compared once, with its number of ids as weight: n_links counts the other
    ids of the class and the ids of linked classes. Rows of one id with different vectors are vectors of their own.
    Null, zero and non-finite vectors link with nothing, as do null ids; vectors of another length link with their like
    alone. A vector goes to its nearest list and asks every list whose border lies within the reach of a link, whatever
    the link's direction, unless the list is too narrow to reach that far; in a list the code distance less the code error rules most rows out, and the exact cosine
    decides. Vectors that are not of the commonest length are a list of their own, compared exactly. An empty table
    gives an empty result.
    """
    hashes = {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "label", "vector")}
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"  # half as wide to ship, and doubles take the same values
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    base = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ivfpq.valid(F.col("vector"))).withColumns(hashes)
    # A class is named by one of its hashes; its label also holds the length of its vectors.
    every = cut(base.groupBy("label", "h1", "h2").agg(F.min("id").alias("least"), F.countDistinct("id").alias("weight"), F.first("vector").alias("vector"))
                .select(F.col("h1").alias("id"), "h2", "vector", F.concat(F.size("vector"), F.lit(":"), "label").alias("label"), "weight", "least", F.size("vector").alias("d")), "classes")
    usual = every.groupBy("d").agg(F.sum("weight").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not usual:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = every.where(F.col("d") == usual["d"]).select("id", "vector", "label", "weight")
    odd = every.where(F.col("d") != usual["d"]).select("id", "vector", "label", "weight", F.lit(-1).alias("list"), F.lit(b"").alias("codes"), F.lit(0.0).alias("left_out"), F.lit(0.0).alias("away"))
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    x = ivfpq.sample(classes, max_train)
    q = ivfpq.fit(x, -(-stats["n"] // (LIST_ROWS * max(1, stats["labels"]))))
    reach = float(np.sqrt(2 - 2 * threshold))
    between = np.sqrt(ivfpq.squares(q.centres, q.centres))
    indexed = cut(ivfpq.index(classes, q, ", label string, weight long"), "index")
    # The width of each list, at most MAX_LISTS numbers.
    widths = {r["list"]: r["width"] for r in indexed.groupBy("list").agg(F.max("away").alias("width")).collect()}
    width = np.array([widths.get(k, -np.inf) for k in range(len(q.centres))])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = ivfpq.squares(ivfpq.unit(np.array(batch["vector"].tolist(), float)), q.centres)
                home = batch["list"].to_numpy()
                # A row of list j is no nearer to this vector's own centre than to c_j, so by Cauchy-Schwarz a linked one gives
                # d_j^2 - d_home^2 <= 2 * reach * |c_j - c_home|; and no row of list j is further from c_j than the list is wide.
                border = d - d[np.arange(len(d)), home][:, None] <= 2 * reach * between[home] + 1e-9
                at, number = np.nonzero(border & (np.sqrt(d) <= width + reach + 1e-9))
                yield batch[["id", "vector", "label"]].iloc[at].assign(list=number.astype(np.int32))

    asked = cut(indexed.select("id", "vector", "label", "list").mapInPandas(ask, f"id long, vector {kind}, label string, list int")
                .unionByName(odd.select("id", "vector", "label", "list")), "asked")
    indexed = indexed.unionByName(odd)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    size = cut(indexed.groupBy("label", "list").agg(F.count(F.lit(1)).alias("n")).join(
        asked.groupBy("label", "list").agg(F.count(F.lit(1)).alias("m")), ["label", "list"])
        .select("label", "list", blocks("n").alias("rb"), blocks("m").alias("qb")), "size")
    key = ["label", "list", "r", "s"]
    left = indexed.join(size, ["label", "list"]).select("label", "list", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int").alias("r"),
                                                        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("s"), "id", "vector", "weight", "codes", "left_out")
    right = asked.join(size, ["label", "list"]).select("label", "list", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"),
                                                       F.pmod(F.xxhash64(F.lit(1), "id"), F.col("qb")).cast("int").alias("s"), "id", "vector")

    def compare(rows_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        if not len(rows_) or not len(queries):
            return none
        ids, weights, number = rows_["id"].to_numpy(), rows_["weight"].to_numpy(), int(rows_["list"].iloc[0])
        codes, left_out, by = ivfpq.code_matrix(rows_["codes"]), rows_["left_out"].to_numpy(), queries["id"].to_numpy()
        vectors, asked = (ivfpq.scaled(np.array(t["vector"].tolist(), float)) for t in (rows_, queries))
        units = ivfpq.unit(vectors)
        out, trees, step = [], [], max(1, min(TOGETHER, CELLS // len(ids)))
        for first in range(0, len(by), step):
            own, v = by[first:first + step], asked[first:first + step]
            u = ivfpq.unit(v)
            maybe = own[:, None] != ids[None, :]
            if number >= 0:
                maybe &= np.sqrt(q.distances(u, number, codes)) - left_out <= reach + 1e-9
            some = np.flatnonzero(maybe.any(0))
            like = u @ units[some].T
            query, row = np.nonzero(maybe[:, some] & (like >= threshold - 1e-12))
            # Within rounding of the threshold the cosine pair by pair decides, the same from either side.
            close = np.flatnonzero(like[query, row] <= threshold + 1e-12)
            row = some[row]
            fine = np.ones(len(query), bool)
            fine[close] = ivfpq.cosines(vectors[row[close]], v[query[close]]) >= threshold
            query, row = query[fine], row[fine]
            if len(query):
                links = np.zeros(len(own), np.int64)
                np.add.at(links, query, weights[row])
                out.append(pd.DataFrame({"id": own[links > 0], "links": links[links > 0], "other": -1}))
                trees.append(forest(own[query], ids[row]))
        if not out:
            return none
        pairs = np.concatenate(trees)
        tree = forest(pairs[:, 0], pairs[:, 1])
        return pd.concat([*out, pd.DataFrame({"id": tree[:, 0], "links": 0, "other": tree[:, 1]})]).astype("int64")

    found = cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "id long, links long, other long"), "found")
    counts = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = every.select("id", "h2", "weight", "least").join(counts, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left") \
        .where("weight > 1 or links is not null").withColumn("root", F.coalesce("component", "id"))
    known = cut(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    found_in = known.drop("component").join(least, "root") \
        .select(F.col("id").alias("h1"), "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component")
    named = own.select("id", *[F.when(F.col("id").isNotNull(), h).alias(k) for k, h in hashes.items()]).join(found_in, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of each node with the smallest node it reaches, in place of links that would be quadratic in a group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return np.column_stack([nodes[keep], nodes[label[keep]]])
