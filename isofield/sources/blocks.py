"""Tables kept as numbered blocks, each with a manifest that is written after its data."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isofield.sources.tables import exists


class BlockStore:
    """Blocks 0, 1, 2, ... of one table under place, for one signature of what they are made from.

    A block is a folder of Parquet files and a manifest with its number of rows and a digest of them that no order
    changes. A block whose job died half-way has no manifest, or one that its data no longer fit, and counts as absent.
    Readers name the blocks they want, and only those folders are read.
    """

    def __init__(self, spark: SparkSession, place: str, signature: dict, verify: bool = True):
        key = hashlib.sha256(json.dumps(signature, sort_keys=True).encode()).hexdigest()[:32]
        self.spark, self.at, self.verify = spark, f"{place}/{key}", verify

    def data(self, block: int) -> str:
        return f"{self.at}/data/block={block:06d}"

    def manifest(self, block: int) -> str:
        return f"{self.at}/manifest/{block:06d}"

    def _state(self, block: int) -> DataFrame:
        df = self.spark.read.parquet(self.data(block))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))

    def write(self, block: int, df: DataFrame, **more) -> None:
        """Replace a block; more is kept in its manifest as JSON."""
        df.write.mode("overwrite").parquet(self.data(block))
        self._state(block).withColumn("more", F.lit(json.dumps(more))).coalesce(1).write.mode("overwrite").json(self.manifest(block))

    def known(self, block: int) -> dict | None:
        """What the manifest keeps beside the digest, or None if the block is absent or is not what its manifest says."""
        if not exists(self.spark, f"{self.manifest(block)}/_SUCCESS"):
            return None
        said = self.spark.read.schema("rows long, digest string, more string").json(self.manifest(block)).first()
        if said is None or not exists(self.spark, self.data(block)):
            return None
        if self.verify:
            try:
                found = self._state(block).first()
            except Exception as error:  # files of which some are gone or cut off
                if not any(k in str(error) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "is not a Parquet file")):
                    raise
                return None
            if (found["rows"], found["digest"]) != (said["rows"], said["digest"]):
                return None
        return json.loads(said["more"])

    def completed(self) -> list[dict]:
        """What the manifests of blocks 0, 1, ... say, up to the first that is absent."""
        found = []
        while (more := self.known(len(found))) is not None:
            found.append(more)
        return found

    def read(self, first: int, last: int) -> DataFrame:
        """Rows of the blocks first to last, with their number as `block`; other blocks' folders are not read."""
        return self.spark.read.option("basePath", f"{self.at}/data").parquet(*[self.data(k) for k in range(first, last + 1)]).withColumn("block", F.col("block").cast("int"))
