"""Toxicity classifier whose score may not change when identity terms are swapped.

A logistic model over words and word beginnings. Labelled texts that name a group are doubled with the group's name
swapped for another; squared differences between the two scores are penalised, so that neutral mentions of a group
carry no weight of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isofield.llm.common import cut, in_small_batches
from isofield.llm.words import blocks, stems, tidy

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
FEATURES = 2000
STEM_BYTES = (4, 5, 6, 7, 8, 9, 10)
THRESHOLD = 0.7
RIDGE, POSITIVE_WEIGHT, COUNTERFACTUAL_WEIGHT, STEPS, RATE = 1e-4, 3.0, 1.0, 300, 0.3
#: Terms are swapped within their group alone: a faith for a faith, an origin for an origin.
IDENTITY_GROUPS = (
    ("atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim"),
    ("african", "arab", "asian", "black", "latino", "white"),
    ("bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight", "transgender"),
    ("female", "male"), ("men", "women"), ("old", "elderly", "young"), ("blind", "deaf", "disabled"),
    ("foreign", "immigrant", "refugee"))


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def features_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, count) of every text, block by block."""
    for first, _, data, offsets in blocks(column):
        row, value = stems(data, offsets, STEM_BYTES)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        at = np.flatnonzero(new)
        yield row[at] + first, value[at], np.diff(np.append(at, len(row)))


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> str | None:
    """text with each identity term replaced by the next one of its group; None if it names none."""
    following = {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]))}
    out, n = re.subn(r"\b(" + "|".join(following) + r")\b", lambda m: following[m[0].lower()], text, flags=re.IGNORECASE)
    return out if n else None


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(id, label, swap, features, counts) of at most max_train labelled documents outside the held-out third.

    swap is 0 for a text and 1 for its counterfactual.
    """
    wanted = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
              .agg(F.max(label_col).cast("int").alias("label")).where(~held_out(F.col("id")))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels_ = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            pairs = [(i, s) for i, t in enumerate(texts) if t and (s := swapped(t)) is not None]
            doubled = np.array([i for i, _ in pairs], np.int64)
            for swap, where, column in ((0, np.arange(len(ids)), pa.array(texts, pa.string())), (1, doubled, pa.array([s for _, s in pairs], pa.string()))):
                for row, feature, count in features_of(column):
                    texts_in, begin = np.unique(row, return_index=True)
                    ends = np.append(begin[1:], len(row)).astype(np.int32)
                    offsets = pa.array(np.append(begin[:1], ends).astype(np.int32)) if len(row) else pa.array([0], pa.int32())
                    at = where[texts_in]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[at]), pa.array(labels_[at].astype(np.int32)), pa.array(np.full(len(at), swap, np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(feature.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))],
                        names=["id", "label", "swap", "features", "counts"])

    return in_small_batches(rows).mapInArrow(tidy(run), "id long, label int, swap int, features array<long>, counts array<int>")


def only(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Training rows with the chosen features alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts = batch.column(3), batch.column(4)
            row = features.value_parent_indices().to_numpy()
            value, count = features.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()
            at = np.minimum(np.searchsorted(chosen, value), len(chosen) - 1)
            hit = chosen[at] == value
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[hit], minlength=len(batch)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(at[hit].astype(np.int64))),
                                              pa.ListArray.from_arrays(offsets, pa.array(count[hit].astype(np.int32)))], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def held_out(id_col) -> "F.Column":
    """Whether the id belongs to the third that no model learns from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = MAX_TRAIN, n_features: int = FEATURES) -> Model:
    """Fit on the bounded sample. Features are those that tell the labels apart best, by a standardised log odds ratio.

    Without labelled rows of both kinds the model scores every text with the smoothed share of toxic rows.
    """
    rows = cut(training_rows(docs, labels, id_col, text_col, label_col, max_train), "toxic")
    own = rows.where("swap = 0")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((toxic + 0.5) / (clean + 0.5)))
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (F.lit(toxic + 0.5) - a)) - F.log((b + 0.5) / (F.lit(clean + 0.5) - b))
    best = (own.select("label", F.explode("features").alias("feature")).groupBy("feature")
            .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("b"))
            .where("a + b >= 2").select("feature", (F.abs(odds) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("z"))
            .orderBy(F.desc("z"), "feature").limit(n_features))
    chosen = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))
    if not len(chosen):
        return Model(chosen, np.zeros(0), prior)
    return _train(only(rows, chosen).toArrow(), len(chosen), chosen)


def _train(texts: pa.Table, n: int, chosen: np.ndarray) -> Model:
    texts = texts.combine_chunks().sort_by([("id", "ascending"), ("swap", "ascending")])
    features, counts = (texts[c].combine_chunks() for c in ("features", "counts"))
    ids, swaps = texts["id"].to_numpy(), texts["swap"].to_numpy()
    # Texts get consecutive numbers; a counterfactual has the number of its text (repeated documents share them).
    first = np.append(True, ids[1:] != ids[:-1])
    number = np.cumsum(first) - 1
    y = texts["label"].to_numpy()[first].astype(float)
    parent = features.value_parent_indices().to_numpy()
    row, swap = number[parent], swaps[parent] == 1
    col, value = features.flatten().to_numpy(), np.log1p(counts.flatten().to_numpy())
    doubled = np.zeros(len(y), bool)
    doubled[number[swaps == 1]] = True
    r, c, v = row[~swap], col[~swap], value[~swap]
    # Differences between a text and its counterfactual, as one sparse matrix.
    pick = doubled[row]
    dr, dc, dv = row[pick], col[pick], np.where(swap[pick], -value[pick], value[pick])
    w, bias, square = np.zeros(n), -2.0, np.full(n + 1, 1e-8)
    weight = np.where(y == 1, POSITIVE_WEIGHT, 1.0) / len(y)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * w[c], minlength=len(y)) + bias, -30, 30)))
        e = (p - y) * weight
        g = np.bincount(c, v * e[r], minlength=len(w)) + RIDGE * w
        if len(dr):
            gap = np.bincount(dr, dv * w[dc], minlength=len(y)) * COUNTERFACTUAL_WEIGHT / doubled.sum()
            g += np.bincount(dc, dv * gap[dr], minlength=len(w))
        square += np.append(g * g, e.sum() ** 2)
        w -= RATE * g / np.sqrt(square[:-1])
        bias -= RATE * e.sum() / np.sqrt(square[-1])
    return Model(chosen, w, float(bias))


def scores(column: pa.Array, model: Model, mask: np.ndarray) -> np.ndarray:
    """Scores of texts; null and empty texts score the bias alone."""
    out = np.full(len(column), model.bias)
    for first, n, data, offsets in blocks(column):
        row, value = stems(data, offsets, STEM_BYTES)
        maybe = np.flatnonzero(mask[(value & np.uint64(len(mask) - 1)).astype(np.int64)])
        row, value = row[maybe], value[maybe]
        at = np.minimum(np.searchsorted(model.features, value), max(len(model.features) - 1, 0))
        if len(at):
            hit = model.features[at] == value
            cell, count = np.unique(row[hit] * len(model.features) + at[hit], return_counts=True)
            out[first:first + n] += np.bincount(cell // len(model.features), np.log1p(count) * model.weights[cell % len(model.features)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column; score_col must be a name that docs does not have."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << 20, bool)
        mask[(model.features & np.uint64(len(mask) - 1)).astype(np.int64)] = True
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), model, mask))], names=[*batch.schema.names, score_col])

    return in_small_batches(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Null and empty texts get the model's base score. Rows of labels that repeat an id count once, as toxic if any is;
    null labels and null ids teach nothing. Repeated documents are scored each. Only the named columns are read, and
    only the text bears on a score. Empty tables give an empty result or a constant score.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    out = with_scores(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "score__")
    return out.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col("score__").alias("score"),
                      (F.col("score__") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that the classifier calls toxic, in the same columns, whatever their names.

    Null and empty texts have the base score; repeated rows are judged each. Empty tables give an empty result.
    """
    model, score_col = fit(docs, labels, text_col=text_col), "score"
    while score_col.lower() in {c.lower() for c in docs.columns}:
        score_col += "_"
    return with_scores(docs, model, text_col, score_col).where(F.col(score_col) < THRESHOLD).drop(score_col)
