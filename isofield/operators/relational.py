"""Relational operators with total orders and explicit null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isofield.functions.columns import finite
from isofield.sources.shared import cut


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under a total order; use descending columns to keep the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place__", F.row_number().over(w)).where("place__ = 1").drop("place__")


def argmin(df: DataFrame, groups: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the smallest score in each group, ties by the given columns in rising order; null scores last."""
    return keep_one(df, groups, [F.col(score).asc_nulls_last(), *map(F.col, ties)])


def first_known(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Of each group and column the first value that is not null, in the given order."""
    rest = [c for c in df.columns if c not in groups and c not in order]
    return df.groupBy(*groups).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def frequency(df: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """Counts of each combination, keys rising, counts falling."""
    return df.groupBy(*keys, *value).agg(F.count(F.lit(1)).alias("count")).orderBy(*keys, F.desc("count"), *value)


def missing_members(df: DataFrame, group: str, member: str, members: list[int]) -> DataFrame:
    """The members of a fixed list that each group lacks, sorted."""
    return df.groupBy(group).agg(F.collect_set(F.col(member).cast("int")).alias("seen")).select(
        group, F.array_sort(F.array_except(F.array(*map(F.lit, members)), F.col("seen"))).alias("missing"))


def counts_of(df: DataFrame, group: str, members: DataFrame) -> DataFrame:
    """Row counts of each member of a list, zero where there is none."""
    return members.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, "left").fillna(0, ["n"])


def in_label_order(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """One row for each label of a list in its order, nulls where df has none; other rows go."""
    spark = df.sparkSession
    order = F.broadcast(spark.createDataFrame(list(enumerate(labels)), f"place int, `{column}` string"))
    return order.join(df, column, "left").orderBy("place")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that fails when a key occurs twice on either side."""
    for side in (a, b):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {keys} are not unique")
    return a.join(b, keys, how)


def pivot_exact(df: DataFrame, index: list[str], column: str, values: list[str], cell: str) -> DataFrame:
    """Long to wide over listed values; fails when a cell has two rows."""
    if df.groupBy(*index, column).count().where("count > 1").limit(1).count():
        raise ValueError("a cell has more than one row")
    return df.groupBy(*index).pivot(column, values).agg(F.first(cell))


def subset_counts(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """(subset, n): how many rows each mask holds for, in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in masks.items()])
    return row.unpivot([], list(masks), "subset", "n")


def audit(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Common rows of two tables, and the largest absolute and the mean difference of each value."""
    both = new.alias("a").join(old.alias("b"), keys)
    gap = {v: F.col(f"a.{v}") - F.col(f"b.{v}") for v in values}
    return both.agg(F.count(F.lit(1)).alias("common_rows"), *[F.max(F.abs(g)).alias(f"max_abs_{v}") for v, g in gap.items()],
                    *[F.avg(g).alias(f"mean_{v}") for v, g in gap.items()])


def missing_blocks(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of a grid that no checkpoint has yet."""
    return expected.join(existing.select(*keys).distinct(), keys, "left_anti")


def numbered(df: DataFrame, order: list[str], name: str = "candidate_id") -> DataFrame:
    """0, 1, 2, ... over a total order, without bringing all rows together: a range sort, then an offset for each partition.

    The sorted rows are written once with their partition, so that counts and rows come from one and the same split; two
    plans of a range sort may draw their bounds differently. Rows that tie on all of order get numbers in any order.
    """
    names = {c.lower() for c in df.columns}
    part = next(c for c in ("part__", "part___", "part____") if c not in names)
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(F.col(part).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # One window over a row for each partition.
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy(part).orderBy(*order)
    placed = ranged.withColumn(name, F.row_number().over(w) - 1).alias("r").join(F.broadcast(before.alias("o")), F.col(f"r.{part}") == F.col("o.p"))
    return placed.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col(f"r.`{name}`") + F.col("o.before")).alias(name))


def ranked_within(df: DataFrame, groups: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """df with 0, 1, 2, ... over a total order inside each group, and the rows of the group; nulls are a group of their own.

    Rows are sorted by range over groups and order and written once; what crosses partitions is a row for each partition
    and group, so a group may be of any size. Rows that tie on all of order get ranks in any order.
    """
    ranged = cut(df.repartitionByRange(*groups, *order).withColumn("part__", F.spark_partition_id()))
    over = Window.partitionBy(*groups)
    blocks = ranged.groupBy(*groups, "part__").agg(F.count(F.lit(1)).alias("n__")).withColumns({
        "start__": F.coalesce(F.sum("n__").over(over.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total__": F.sum("n__").over(over)})
    local = ranged.withColumn("place__", F.row_number().over(Window.partitionBy(*groups, "part__").orderBy(*order)) - 1)
    on = F.col("a.part__") == F.col("b.part__")
    for g in groups:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return local.alias("a").join(blocks.alias("b"), on).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b.start__") + F.col("a.place__")).alias(rank), F.col("b.total__").alias(size))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a value in every column; NaN and infinite numbers are no values."""
    numbers = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: finite(F.col(c)) for c in columns if c in numbers}).dropna(subset=columns)


def distinct_configurations(df: DataFrame, keys: list[str], order: list[str], idle: dict[str, tuple[str, float]] | None = None, digits: int = 12) -> DataFrame:
    """The first row in the given order of each configuration, its number keys rounded.

    idle names keys without effect where another key is 0, and the value they then take: {"cap": ("gamma", 1.0)}.
    """
    numbers = {c for c, t in df.dtypes if t in ("double", "float")}
    fixed = df.withColumns({k: F.when(F.col(other) == 0, F.lit(value)).otherwise(F.col(k)) for k, (other, value) in (idle or {}).items()})
    fixed = fixed.withColumns({k: F.round(k, digits) + F.lit(0.0) for k in keys if k in numbers})  # + 0.0: one zero
    return keep_one(fixed, keys, [F.col(c) for c in order])


def at_chosen(candidates: DataFrame, choices: DataFrame, keys: list[str], size: str, chosen: str) -> DataFrame:
    """The candidates of each group at the size that was chosen for the group, with all that the choice table says of it."""
    return candidates.join(choices.withColumn(size, F.col(chosen)), [*keys, size])


def cumulative(df: DataFrame, groups: list[str], value: str, weight: Column) -> DataFrame:
    """(groups, value, v__, before__, upto__, total__, last__) for each different value of each group.

    before__ and upto__ are the weight below a value and with it, last__ the next smaller value. Rows are sorted by range
    and written once; what crosses partitions is one row for each partition and group, so a group may be of any size.
    """
    steps = df.groupBy(*groups, value).agg(F.sum(weight).alias("w__"))
    ranged = cut(steps.repartitionByRange(*groups, value).withColumn("part__", F.spark_partition_id()))
    blocks = ranged.groupBy(*groups, "part__").agg(F.sum("w__").alias("block__"), F.max(value).alias("top__"))
    over = Window.partitionBy(*groups).orderBy("part__")
    blocks = blocks.withColumns({"start__": F.coalesce(F.sum("block__").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                                 "edge__": F.lag("top__").over(over), "total__": F.sum("block__").over(Window.partitionBy(*groups))})
    inside = Window.partitionBy(*groups, "part__").orderBy(value)
    local = ranged.withColumns({"sum__": F.sum("w__").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "lag__": F.lag(value).over(inside)})
    on = F.col("a.part__") == F.col("b.part__")
    for g in groups:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    upto = F.col("b.start__") + F.col("a.sum__")
    return local.alias("a").join(blocks.alias("b"), on).select(
        *[F.col(f"a.{g}") for g in groups], F.col(f"a.{value}"), (upto - F.col("a.w__")).alias("before__"), upto.alias("upto__"),
        F.col("b.total__"), F.coalesce("a.lag__", "b.edge__").alias("last__"))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """(groups, name): exact quantiles with linear interpolation as one array; null values do not count.

    A table without values gives no row for a group, and one row of nulls where no groups are named.
    """
    steps = cumulative(df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias(value)), groups, value, F.lit(1))
    at = [F.lit(q) * (F.col("total__") - 1) for q in shares]
    pick = lambda k: F.min(F.when(F.col("upto__") > k, F.col(value)))
    rows = steps.groupBy(*groups).agg(*[pick(F.floor(h)).alias(f"low{i}__") for i, h in enumerate(at)], *[pick(F.ceil(h)).alias(f"high{i}__") for i, h in enumerate(at)],
                                      *[F.max(h - F.floor(h)).alias(f"part{i}__") for i, h in enumerate(at)])
    col = lambda k, i: F.col(f"{k}{i}__")
    return rows.select(*groups, F.array(*[col("low", i) + col("part", i) * (col("high", i) - col("low", i)) for i in range(len(shares))]).alias(name))


def digest(df: DataFrame) -> DataFrame:
    """One row: the count, and a sum of row hashes that no order changes."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def text_digest(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One row: the count, and a sum of the leading 60 bits of md5 over the columns' texts, joined by |; nulls are skipped."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(head).alias("digest"))


def signature(columns: list[str]) -> Column:
    """SHA-256 of the row's JSON with keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
