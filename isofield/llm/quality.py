"""Quality classifier with site evidence, by hierarchical empirical Bayes.

A document has the evidence of its own text, a logistic model over its shape. A site (host) and a part of a site (path)
have the evidence of all their documents: sums of these probabilities, labelled ones counting as their label, from
which a document's own is left out. Sparse sites are shrunk towards the global prior, sparse paths towards their site,
with weights that the spread between sites and between paths gives (method of moments).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isofield.llm.common import cut
from isofield.llm.toxicity import held_out
from isofield.llm.words import blocks, words

#: Labelled rows that the text model is fitted on at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
STEPS, RATE, RIDGE = 400, 0.3, 1e-3
KEEP = 0.5
BROADCAST_PATHS = 100_000
NAMES = ("log words", "mean word bytes", "distinct share", "commonest share", "letters", "capitals", "digits", "signs",
         "bars", "lines a word", "end marks a word", "long words")


def shape(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; null and empty texts have zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for first, n, data, offsets in blocks(column):
        row, start, end, value = words(data, offsets, lower=False)
        at = np.repeat(np.arange(n), np.diff(offsets))
        count = lambda mask: np.bincount(at[mask], minlength=n)
        size, bytes_ = np.bincount(row, minlength=n), np.maximum(np.diff(offsets), 1)
        some = np.maximum(size, 1)
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])) if len(r) else np.zeros(0, bool)
        at_new = np.flatnonzero(new)
        times = np.diff(np.append(at_new, len(r)))
        most = np.zeros(n)
        np.maximum.at(most, r[at_new], times)
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        digit, high = (data >= 48) & (data <= 57), data >= 128
        space = (data == 32) | ((data >= 9) & (data <= 13))
        out[first:first + n] = np.column_stack([
            np.log1p(size), np.bincount(row, end - start, minlength=n) / some, np.bincount(r[at_new], minlength=n) / some, most / some,
            count(upper | lower | high) / bytes_, count(upper) / bytes_, count(digit) / bytes_, count(~(upper | lower | high | digit | space)) / bytes_,
            count(data == 124) / some, count(data == 10) / some, count((data == 46) | (data == 33) | (data == 63)) / some,
            np.bincount(row[end - start > 20], minlength=n) / some])
    return out


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z * z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


def with_evidence(docs: DataFrame, text_col: str, model: tuple | None, name: str) -> DataFrame:
    """docs with the text model's probability, or with the shape itself where no model is given."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shape(batch.column(at))
            if model:
                mean, scale, w = model
                got = pa.array(1 / (1 + np.exp(-np.clip(expand(x, mean, scale) @ w, -8, 8))))
            else:
                got = pa.array(x.tolist(), pa.list_(pa.float64()))
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, got], names=[*(c for c in batch.schema.names if c != text_col), name])

    kind = T.DoubleType() if model else T.ArrayType(T.DoubleType())
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(name, kind)]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple | None:
    """Text model on at most max_train labelled documents; None without labels of both kinds."""
    wanted = labels.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = with_evidence(docs.select("id", "text").join(F.broadcast(wanted), "id"), "text", None, "shape").toPandas().sort_values("id")
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows["shape"].tolist())
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = expand(x, mean, scale)
    w, square = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-8)
    for _ in range(STEPS):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) / len(y) + RIDGE * w
        square += g * g
        w -= RATE * g / np.sqrt(square)
    return mean, scale, w


def strength(groups: DataFrame, centre: Column) -> float:
    """Weight of a prior, in documents, from the spread of group means about their centres beyond what chance gives.

    groups has n and good; one row comes back. Groups that spread no more than chance have a weight of a million.
    """
    rate = F.col("good") / F.col("n")
    row = groups.where("n >= 2").agg(
        F.sum(F.col("n") * (rate - centre) ** 2).alias("spread"), F.sum(centre * (1 - centre)).alias("chance"),
        F.sum(F.col("n") * centre * (1 - centre)).alias("full")).first()
    spread, chance, full = (float(row[c] or 0) for c in ("spread", "chance", "full"))
    if full <= chance or spread <= chance:
        return 1e6
    return float(np.clip((full - spread) / (spread - chance), 0.1, 1e6))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, held_out, text_score, host_score, path_score, score, keep) of every document.

    Scores are probabilities of label 1. Labels of ids whose crc32 leaves 1 modulo 3 teach nothing. Null and empty
    texts have an empty shape; null hosts and paths are a site and a path. Rows that repeat an id in labels count once,
    as good only if all are; repeated documents count each. Without labels of both kinds every text scores the same.
    An empty table gives an empty result. Only the named columns are read.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")) \
        .agg(F.min(label_col).cast("int").alias("label")).where(~held_out(F.col("id")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    model = fit(base, known, max_train)
    seen = cut(with_evidence(base, "text", model, "p") if model else base.drop("text").withColumn("p", F.lit(0.5)), "evidence")
    seen = cut(seen.join(known, "id", "left").withColumn("q", F.coalesce(F.col("label").cast("double"), F.col("p"))), "known")
    paths = cut(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    row = hosts.agg(F.sum("n"), F.sum("good")).first()
    prior = float(np.clip((row[1] or 0.5) / (row[0] or 1), 1e-3, 1 - 1e-3))
    a = strength(hosts, F.lit(prior))
    shrunk = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("good").alias("hgood"), ((F.col("good") + a * prior) / (F.col("n") + a)).alias("hmean"))
    levels = cut(paths.join(shrunk, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "levels")
    b = strength(levels, F.col("hmean"))
    small = F.broadcast if levels.count() <= BROADCAST_PATHS else (lambda df: df)
    levels = levels.withColumnsRenamed({"host": "h", "path": "t", "n": "pn", "good": "pgood"})
    joined = seen.join(small(levels), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("t")))
    host_score = (F.col("hgood") - F.col("q") + a * prior) / (F.col("hn") - 1 + a)
    path_score = (F.col("pgood") - F.col("q") + b * host_score) / (F.col("pn") - 1 + b)
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    logit = lambda c: F.log(c / (1 - c))
    total = logit(inside(F.col("p"))) + logit(inside(F.col("path_score"))) - F.lit(float(np.log(prior / (1 - prior))))
    return joined.withColumn("host_score", inside(host_score)).withColumn("path_score", inside(path_score)) \
        .withColumn("score", 1 / (1 + F.exp(-total))).select(
            F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("p").alias("text_score"), "host_score", "path_score", "score",
            (F.col("score") >= KEEP).alias("keep"))
