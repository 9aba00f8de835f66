"""Picking rows per key: the latest, the superseded, the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sorted(names: Sequence[str | Column], latest: bool) -> list[Column]:
    columns = [F.col(x) if isinstance(x, str) else x for x in names]
    return [c.desc_nulls_last() for c in columns] if latest else [c.asc_nulls_last() for c in columns]


def _ranked(df: DataFrame, key: Sequence[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The row of each key that comes last in ``order``, whose last column should break ties. Rank 1 is pushed below the shuffle."""
    return _ranked(df if where is None else df.where(where), key, _sorted(order, True)).where("_place = 1").drop("_place")


def superseded(df: DataFrame, key: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """All rows but the latest of each key."""
    return _ranked(df if where is None else df.where(where), key, _sorted(order, True)).where("_place > 1").drop("_place")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first, nulls last."""
    return _ranked(df, key, _sorted(order, False)).where("_place = 1").drop("_place")


def dedupe_first(df: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """Repeated keys go; the occurrence with the smallest position stays."""
    return first_per_key(df, key, [position])


def top(df: DataFrame, order: Sequence[Column], n: int, tie: Sequence[str]) -> DataFrame:
    """The first n rows; ``tie`` names columns that make the order unique."""
    return df.orderBy(*order, *[F.col(c).asc_nulls_last() for c in tie]).limit(n)
