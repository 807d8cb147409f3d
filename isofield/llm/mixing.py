"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from isofield.functions.columns import random_number
from isofield.llm.common import cut, n_words, named, unnamed

SEED = 20240917
#: Bits of a draw below the coarse and the fine steps of a source.
COARSE, FINE = 19, 7
#: The table of sources is sent to every task only up to this many rows.
BROADCAST_SOURCES = 50_000


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources in code-point order, null last.

    The running position is taken from a range-partitioned sort with an offset for each partition,
    so no task sees all sources.
    """
    ranged = cut(sources.repartitionByRange("is_null", "source").sortWithinPartitions("is_null", "source")
                 .withColumn("part", F.spark_partition_id()), "sources")
    w = Window.partitionBy("part").orderBy("is_null", "source")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One window over a row for each partition.
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(w) - 1 + F.col("before")
    return ranged.join(F.broadcast(before), "part").select(
        "source", "is_null", "source_size", (F.pmod(place, F.lit(3)) + 1).cast("double").alias("weight"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """target = min(max_epochs * source_size, level * weight), with the level that spends the total.

    A round clamps the sources above their cap and shares what is left by weight; it ends when none is above.
    Each round is one aggregate of one row.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = -1.0
    while True:
        clamped = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("spent"),
                          F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if not row["open"]:
            break
        higher = (total - row["spent"]) / row["open"]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return sources.withColumn("target", F.when(cap < F.col("weight") * F.lit(level), cap)
                              .otherwise(F.least(cap, F.col("weight") * F.lit(max(level, 0.0)))))


def draw(id_: Column, integral: bool, size: Column, seed: int) -> Column:
    """A number in [0, 2**31) that seed, id and size fix, by arithmetic that SQL repeats; other ids than integers are hashed first."""
    return random_number(seed, F.coalesce(size, F.lit(0)), F.coalesce(id_.cast("long") if integral else F.xxhash64(id_), F.lit(0)))


def runs_out(sums: DataFrame, lacks: DataFrame) -> DataFrame:
    """(source, step, left): the step of each source in which its lack runs out, and what of the lack that step must give.

    sums has the words of each (source, step), a source having at most 4,096 steps; a source without a lack has no such step.
    """
    run = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (sums.join(lacks.select(F.col("source").alias("of"), "lack"), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("upto", F.sum("words").over(run))
            .where((F.col("upto") >= F.col("lack")) & (F.col("upto") - F.col("words") < F.col("lack")))
            .select("source", "step", (F.col("lack") - F.col("upto") + F.col("words")).alias("left")))


def with_taken(docs: DataFrame, sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """docs(..., id__, source__, size__, draw__) with source_size__, target__ and taken__: the words of each document that the mix takes.

    sizes has (source, size, draw) of the same rows and is read several times. Documents are taken in the order of their draws.
    The place where a source's lack runs out is found by the first 12 bits of the draw, then by the next 12 within them, so
    that one task orders a 2**24th of a source alone.
    """
    step = lambda name, bits: F.shiftright(name, bits).cast("int").alias("step")
    coarse = cut(sizes.groupBy("source", step("draw", COARSE)).agg(F.sum("size").alias("words")), "steps")
    sums = coarse.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("is_null", F.col("source").isNull())
    weights = cut(cyclic_weights(sums), "weights")
    stats = weights.agg(F.sum("source_size").alias("total"), F.count(F.lit(1)).alias("n")).first()
    small = F.broadcast if stats["n"] <= BROADCAST_SOURCES else (lambda df: df)
    filled = water_fill(weights, float(stats["total"] or 0), max_epochs)
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    filled = cut(filled.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
                 .withColumn("lack", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
                 .select("source", "source_size", "target", "whole", "lack"), "targets")

    edge = cut(runs_out(coarse, small(filled)), "edges").select(F.col("source").alias("of"), F.col("step").alias("at"), "left")
    within = (sizes.join(small(edge), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("draw", COARSE) == F.col("at")))
              .groupBy("source", step("draw", FINE)).agg(F.sum("size").alias("words")))
    last = runs_out(within, small(edge.select(F.col("of").alias("source"), F.col("left").alias("lack"))))
    plan = cut(filled.alias("f").join(last.alias("e"), F.col("f.source").eqNullSafe(F.col("e.source")), "left")
               .select(F.col("f.source").alias("of__"), F.col("source_size").alias("source_size__"), F.col("target").alias("target__"), F.col("whole").alias("whole__"),
                       F.coalesce("e.step", F.lit(-1)).alias("edge__"), F.coalesce("e.left", F.lit(0)).alias("left__")), "plan")

    joined = docs.join(small(plan), F.col("source__").eqNullSafe(F.col("of__"))).withColumn("step__", F.shiftright("draw__", FINE))
    base = F.col("whole__") * F.col("size__")
    rest = joined.where("step__ <> edge__") \
        .withColumn("taken__", base + F.when(F.col("step__") < F.col("edge__"), F.col("size__")).otherwise(F.lit(0)))
    order = Window.partitionBy("source__", "edge__").orderBy("draw__", "id__", "size__").rowsBetween(Window.unboundedPreceding, 0)
    cutoff = joined.where("step__ = edge__").withColumn("upto__", F.sum("size__").over(order)) \
        .withColumn("taken__", base + F.greatest(F.lit(0), F.least(F.col("size__"), F.col("left__") - F.col("upto__") + F.col("size__"))))
    out = [*docs.columns, "source_size__", "target__", F.col("taken__").cast("long").alias("taken__")]
    return rest.select(*out).unionByName(cutoff.select(*out))


def _integral(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, IntegralType)


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source__").alias("source"), F.col("size__").alias("size"), F.col("draw__").alias("draw"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes: (id, size, source_size, target, taken).

    Every document is repeated floor(target / source_size) times whole. What the source still lacks is spent in a
    seeded order of its documents: each one once more, the document at the boundary in part. Sizes are words of the
    text. Null texts and texts without words have size 0 and are taken 0 times. Null sources are one source, ordered
    last. Repeated rows are documents of their own. An empty table gives an empty result. A reserved column name in
    docs does no harm, as only the three named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id__"), F.col(source_col).alias("source__"), n_words(F.col(text_col)).alias("size__"))
    rows = cut(rows.withColumn("draw__", draw(F.col("id__"), _integral(docs, id_col), F.col("size__"), seed)), "sizes")
    return with_taken(rows, _sizes(rows), max_epochs).select(
        F.col("id__").alias(id_col), F.col("size__").alias("size"), F.col("source_size__").alias("source_size"),
        F.col("target__").alias("target"), F.col("taken__").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, in the columns of docs: whole repetitions, and a last one cut to its first words.

    Documents that the mix takes nothing of are gone. A cut text is its first words with one space between them. Names of
    other columns clash with nothing.
    """
    rows = named(docs, id__=id_col, source__=source_col, text=text_col, size__=n_words(docs[f"`{text_col}`"]))
    rows = rows.withColumn("draw__", draw(F.col("id__"), _integral(docs, id_col), F.col("size__"), seed))
    mixed = with_taken(rows, cut(_sizes(rows), "sizes"), max_epochs).where("taken__ > 0")
    full, part = F.expr("taken__ div size__"), F.col("taken__") % F.col("size__")
    copies = F.sequence(F.lit(1), (full + (part > 0).cast("long")))
    shown = mixed.withColumn("part__", part).withColumn("copy__", F.explode(copies)).withColumn("full__", full)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    text = F.when(F.col("copy__") <= F.col("full__"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("part__").cast("int")), " "))
    return unnamed(shown, docs.columns, **{text_col: text})
