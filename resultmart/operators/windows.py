"""Progression over time, carry-forward and dense keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.sources.tables import written


def progression(df: DataFrame, partition: Sequence[str], order: Sequence[str], measures: Sequence[str], tie: str) -> DataFrame:
    """Add previous_<m> and <m>_delta for every measure, in one window. Nulls come last; ``tie`` makes the order unique."""
    w = Window.partitionBy(*partition).orderBy(*[F.col(c).asc_nulls_last() for c in [*order, tie]])
    added = {}
    for m in measures:
        added[f"previous_{m}"] = F.lag(m).over(w)
        added[f"{m}_delta"] = F.col(m) - F.lag(m).over(w)
    return df.withColumns(added)


def ranged_progression(df: DataFrame, partition: Sequence[str], order: Sequence[str], measures: Sequence[str], tie: str) -> DataFrame:
    """As ``progression``, where one partition may hold most rows.

    Rows are range-partitioned by partition and order and written with their range. A row's forerunner is the one before
    it in its range; for the first row of a range it is the last one of the range before, of which one row is carried.
    """
    keys = [*partition, *order, tie]
    columns = [F.col(c).asc_nulls_last() for c in keys]
    rows = written(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "progression")
    w = Window.partitionBy("_part", *partition).orderBy(*columns[len(partition) :])
    held = F.struct(*[F.col(m).alias(f"m{i}") for i, m in enumerate(measures)])
    inside = rows.withColumns({"_n": F.row_number().over(w), "_before": F.lag(held).over(w)})
    # the last row of each range: one row a range, so that all of them fit one task
    latest = Window.partitionBy("_part").orderBy(*[F.col(c).desc_nulls_first() for c in keys])
    ends = rows.withColumn("_back", F.row_number().over(latest)).where("_back = 1").select("_part", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(partition)]).alias("_key"), held.alias("_last"))
    along = Window.orderBy("_part")
    parts = ends.select("_part", F.lag("_key").over(along).alias("_key"), F.lag("_last").over(along).alias("_last"))
    met = inside.join(F.broadcast(parts), "_part")
    follows = F.col("_n") == 1
    for i, c in enumerate(partition):
        follows = follows & F.col("_key").isNotNull() & F.col(f"_key.k{i}").eqNullSafe(F.col(c))
    before = F.when(follows, F.col("_last")).otherwise(F.col("_before"))
    added = {}
    for i, m in enumerate(measures):
        added[f"previous_{m}"] = before[f"m{i}"]
        added[f"{m}_delta"] = F.col(m) - before[f"m{i}"]
    return met.withColumns(added).select(*df.columns, *added)


def positions(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each partition from 1 in a total order, nulls last, where one partition may hold most rows.

    This is the list of a group as rows. Rows are range-partitioned by partition and order and written with their range;
    a row's number is its number in its range and the rows of its partition in the ranges before. Only the first partition
    of a range can have any there, so what is added is one row a range.
    """
    columns = [F.col(c).asc_nulls_last() for c in [*partition, *order]]
    rows = written(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "positions")
    sizes = rows.groupBy("_part", *partition).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*partition).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.withColumn("_before", F.sum("_n").over(ahead)).where("_before > 0")
    carried = carried.select("_part", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(partition)]).alias("_key"), "_before")
    inside = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *partition).orderBy(*columns[len(partition) :])))
    met = inside.join(F.broadcast(carried), "_part", "left")  # at most a row for each range
    same = F.col("_key").isNotNull()
    for i, c in enumerate(partition):
        same = same & F.col(f"_key.k{i}").eqNullSafe(F.col(c))
    return met.select(*df.columns, (F.col("_row") + F.when(same, F.col("_before")).otherwise(0)).alias(name))


def carry_forward(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and with the row itself."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def dense_key(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows from 1 in a global order, nulls last, without sending them to one task.

    Rows are range-partitioned and written with their partition, so that sizes and numbers come from the same ranges; a
    row's number is its number in its partition and the sizes of the partitions before it, of which only one row each is
    gathered. The rows have to be unique in ``order``.
    """
    columns = [F.col(c).asc_nulls_last() for c in order]
    parts = written(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "dense-key")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    out = parts.withColumn("_row", inside).join(F.broadcast(before), "_part")  # a row for each partition
    return out.select((F.col("_row") + F.col("_before")).cast("long").alias(name), *df.columns)
