"""Grouped summaries and tagged unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarise(df: DataFrame, by: Sequence[str | Column], aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Aggregates by name; without keys one row. ``having`` filters the groups."""
    columns = [c.alias(n) for n, c in aggs.items()]
    out = df.groupBy(*by).agg(*columns) if by else df.agg(*columns)
    return out if having is None else out.where(having)


def union_tagged(tag: str, **dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in dfs.items()])


def labelled_counts(**dfs: DataFrame) -> DataFrame:
    """(label, rows): the size of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("label"), "rows") for name, df in dfs.items()])


def count_children(parents: DataFrame, children: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Parents with the number of their children, 0 for none; children are counted before they are joined."""
    counts = children.groupBy(*on).agg(F.count("*").alias(name))
    return parents.join(counts, list(on), "left").fillna(0, [name])


def first_listed(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[Column], k: int, name: str = "values") -> DataFrame:
    """Each group's first ``k`` values in a total order, as an array, and the number of its rows (``n``).

    A list of whole groups grows with the largest one; this holds ``k`` values. The limit on the row number is applied by
    each task before rows are shuffled, as long as ``k`` is at most spark.sql.optimizer.windowGroupLimitThreshold (1000),
    so a group that holds most rows sends ``k`` rows from each task. Null keys form a group, null values count and are
    listed; an empty table has no groups. All rows in order: ``windows.positions``.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    held = df.select(*by, value.alias("_value"), rank.alias("_rank")).where(F.col("_rank") <= k)
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    both = held.withColumn("_n", F.lit(0).cast("long")).unionByName(counts, allowMissingColumns=True)
    kept = F.collect_list(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_value")))
    return both.groupBy(*by).agg(F.transform(F.array_sort(kept), lambda x: x["_value"]).alias(name), F.sum("_n").alias("n"))
