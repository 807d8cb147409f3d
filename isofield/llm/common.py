"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isofield.sources.shared import shared_dir

#: Bytes that separate words: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of texts on its way to Python; Spark's own bounds are 10,000 rows and 64 MB.
BATCH = "4m"


def in_small_batches(texts: DataFrame) -> DataFrame:
    """texts, whose session sends tables to Python in batches of about BATCH from now on, unless it has a bound of its own.

    A batch is held several times over by each task: as vectors and as a stream in the JVM, in Python, and on its way back.
    The bound holds for tables sent row by row, not for groups.
    """
    conf, bound = texts.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, BATCH)
    return texts


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/isofield-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation above this point."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that go when the block ends, but for those that a result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def cut(self, df: DataFrame, what: str = "cut") -> DataFrame:
        path = scratch(self.spark, what)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, found))
        return found

    def keep(self, *found: DataFrame) -> None:
        """These tables stay in the shared folder."""
        self.tables = [t for t in self.tables if not any(t[1] is x for x in found)]

    def drop(self, *found: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        gone = [t for t in self.tables if not found or any(t[1] is x for x in found)]
        self.tables = [t for t in self.tables if t not in gone]
        jvm = self.spark._jvm
        for path, _ in gone:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def named(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """docs as one struct column `row` beside the given columns, so that no name of docs clashes with one of ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       *[(docs[f"`{c}`"] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def unnamed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that named() put away, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def n_words(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
