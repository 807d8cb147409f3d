"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local folder serves one machine; a cluster raises an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/isofield-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df there and read it back, so that what stands above is done once."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in the shared folder that are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def place(self) -> str:
        """A new path that is deleted with the tables."""
        self.paths.append(fresh(self.spark))
        return self.paths[-1]

    def cut(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """files bounds the number of files of a table of known small size."""
        path = self.place()
        (df.coalesce(files) if files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
