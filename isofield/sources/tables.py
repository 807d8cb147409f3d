"""Readers and writers of catalogs and experiment tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isofield.functions.columns import finite

CATALOG = T.StructType([T.StructField("id", T.LongType(), False), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "vx", "vy", "vz")]])


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def exists(spark: SparkSession, place: str) -> bool:
    path = _path(spark, place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def first_existing(spark: SparkSession, places: list[str]) -> str:
    """The first place that exists in whatever store it is in."""
    for place in places:
        if exists(spark, place):
            return place
    raise FileNotFoundError(f"none of {places} exists")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_parquet(spark: SparkSession, place: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(place)


def read_csv(spark: SparkSession, place: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; empty and NaN fields are null."""
    df = spark.read.schema(schema).csv(place, header=True, nanValue="NaN")
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_json(spark: SparkSession, place: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(place, multiLine=True)


def read_description(spark: SparkSession, place: str) -> DataFrame:
    """(key, value) of lines of the form '# key : value'."""
    pattern = r"^#\s*([^:]+?)\s*:\s*(.*?)\s*$"
    return spark.read.text(place).where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value"))


def catalog_from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """A catalog from in-memory arrays pos[n, 3], vel[n, 3] and ids[n]; for small files that are converted once."""
    pos, vel = np.asarray(arrays["pos"], float), np.asarray(arrays["vel"], float)
    ids = np.asarray(arrays.get("ids", np.arange(len(pos))), np.int64)
    if pos.shape != vel.shape or pos.ndim != 2 or pos.shape[1] != 3 or len(ids) != len(pos):
        raise ValueError("pos and vel must be n x 3 and ids n long")
    rows = zip(ids.tolist(), *pos.T.tolist(), *vel.T.tolist())
    return spark.createDataFrame(list(rows), CATALOG)


def read_npz(spark: SparkSession, places: str | list[str], arrays: dict[str, str]) -> DataFrame:
    """One row for each entry of the named one-dimensional arrays of npz files, doubles but for ids: {"m_abs": "m_abs", "ids": "id"}.

    Files are read where tasks run, one file in one task, to be converted once. A file without one of the arrays, or with
    arrays of unlike lengths, is an error; pickled objects are refused. A two-dimensional array gives columns name_0, name_1, ...
    for its first three columns.
    """
    import io
    from collections.abc import Iterator

    import pandas as pd

    names = list(arrays.values())
    wide = [n for n in names if n in ("pos", "vel")]
    columns = [c for n in names for c in ([f"{n}_{k}" for k in range(3)] if n in wide else [n])]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    if missing := sorted(set(arrays) - set(held.files)):
                        raise ValueError(f"{path} has no {missing}")
                    out = {}
                    for key, name in arrays.items():
                        x = held[key]
                        if name in wide:
                            out |= {f"{name}_{k}": x[:, k].astype(float) for k in range(3)}
                        else:
                            out[name] = x.astype(np.int64 if name == "id" else float)
                yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").load(places).select("path", "content")
    return files.mapInPandas(load, ", ".join(f"`{c}` {'long' if c == 'id' else 'double'}" for c in columns))


def resume(spark: SparkSession, place: str, expected: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> DataFrame:
    """All blocks of a grid: those that place lacks are built from their keys in one job and added, a folder for each block.

    build gets the missing blocks and returns their rows with the keys. Each block has a manifest of its number of rows and
    a digest of them, written after the data: a block without one, or whose rows no longer fit it, counts as missing, and
    what a dead job left of it is overwritten. Blocks of which build gives no rows are remembered as empty. order names
    columns of a canonical order; rows are then numbered over all blocks as candidate_id, whatever run built them.
    """
    from isofield.operators.relational import missing_blocks, numbered
    from isofield.sources.shared import cut

    data, manifest = f"{place}/data", f"{place}/manifest"
    spread = [k for k, t in expected.dtypes if k in keys]
    kinds = ", ".join(f"`{k}` {t}" for k, t in expected.select(*keys).dtypes)

    def state(df: DataFrame) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows__"), F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).cast("string").alias("digest__"))

    def read() -> DataFrame | None:
        if not exists(spark, data):
            return None
        try:
            df = spark.read.parquet(data)
        except AnalysisException as error:  # no block has any row
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return None
        return df.withColumns({k: F.col(k).cast(t) for k, t in expected.select(*keys).dtypes})

    def good() -> DataFrame:
        said = spark.read.schema(f"{kinds}, rows__ long, digest__ string, made__ long").parquet(manifest) if exists(spark, f"{manifest}/_SUCCESS") else spark.createDataFrame([], f"{kinds}, rows__ long, digest__ string, made__ long")
        last = said.groupBy(*keys).agg(F.max_by(F.struct("rows__", "digest__"), "made__").alias("said"))
        held = read()
        if held is None:
            return last.where("said.rows__ = 0").select(*keys)
        both = last.join(state(held), keys, "left")
        return both.where((F.col("said.rows__") == F.coalesce("rows__", F.lit(0))) & F.col("said.digest__").eqNullSafe(F.col("digest__"))).select(*keys)

    missing = cut(missing_blocks(expected.select(*keys).distinct(), good(), keys))
    if missing.count():
        build(missing).write.partitionBy(*spread).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(data)
        held = read()
        built = missing.join(state(held), keys, "left") if held is not None else missing.withColumns({"rows__": F.lit(0), "digest__": F.lit(None)})
        made = spark.read.parquet(manifest).agg(F.max("made__")).first()[0] + 1 if exists(spark, f"{manifest}/_SUCCESS") else 0
        built.select(*keys, F.coalesce("rows__", F.lit(0)).cast("long").alias("rows__"), F.col("digest__").cast("string").alias("digest__"), F.lit(made).cast("long").alias("made__")).write.mode("append").parquet(manifest)
    found = read()
    if found is None:
        return spark.createDataFrame([], kinds)
    found = found.join(expected.select(*keys).distinct(), keys, "left_semi")
    return numbered(found, order) if order else found


def synthetic_points(spark: SparkSession, n: int, case: int, seed: int = 260922) -> DataFrame:
    """n points in a ball, in one stretched by axis (case 2) or with every axis bent by itself (case 3), made where they are needed."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + case), F.lit(k), "id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.log(u(2 * k))) * F.cos(2 * np.pi * u(2 * k + 1))
    df = spark.range(n).select("id", *[normal(k).alias(f"g{k}") for k in range(3)], (12 + 95 * F.pow(u(9), F.lit(1 / 3))).alias("r"))
    size = F.sqrt(F.col("g0") ** 2 + F.col("g1") ** 2 + F.col("g2") ** 2)
    scale = (1.0, 0.75, 1.15) if case == 2 else (1.0, 1.0, 1.0)
    axes = [F.col("r") * F.col(f"g{k}") / size * F.lit(s) for k, s in enumerate(scale)]
    if case == 3:
        axes = [a + 9 * F.tanh(a / 40) for a in axes]
    return df.select("id", *[a.alias(n) for a, n in zip(axes, "xyz")])


def _json_ready(c: Column, kind: T.DataType) -> Column:
    """c with null for numbers that JSON has no form for."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _json_ready(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _json_ready(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_ready(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def write_new(df: DataFrame, place: str, kind: str = "parquet") -> None:
    """Write a table as CSV, JSON or Parquet; an existing place is an error. Jobs commit all files or none.

    In JSON, NaN and infinite numbers become null, those in arrays, structs and map values too.
    """
    if kind == "csv":
        df.write.mode("errorifexists").csv(place, header=True)
    elif kind == "json":
        known = [_json_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
        df.select(F.to_json(F.struct(*known), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(place)
    else:
        df.write.mode("errorifexists").parquet(place)


def build_or_load(spark: SparkSession, place: str, signature: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at place if it was built under the same signature; otherwise it is built beside it, then recorded."""
    import hashlib

    key = hashlib.sha256(json.dumps(signature, sort_keys=True).encode()).hexdigest()
    at = f"{place}/{key[:32]}"
    if not exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def parse_list(text: str, kind: type = float) -> list:
    return [kind(x) for x in (p.strip() for p in text.split(",")) if x]


def parse_bool(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "y", "on")


def parse_seed_pairs(text: str) -> list[tuple[int, int]]:
    """'1:2,3:4' to [(1, 2), (3, 4)]."""
    pairs = [tuple(map(int, p.split(":"))) for p in text.split(",") if p.strip()]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("seed pairs are written a:b")
    return pairs
