"""Aggregates into arrays, and functions of arrays, maps and JSON texts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agg_ordered(value: Column, order: Column | None = None, distinct: bool = False, keep_null: bool = True, where: Column | None = None) -> Column:
    """An aggregate that gathers values, by ``order`` (nulls last) or else by value.

    Nulls stay unless ``keep_null`` is false; a filter that no row passes gives null, not an empty array.
    """
    held = F.struct(value.alias("v")) if order is None or distinct else F.struct(order.isNull().alias("n"), order.alias("o"), value.alias("v"))
    if where is not None:
        held = F.when(where, held)
    if not keep_null:
        held = F.when(value.isNotNull(), held)
    if distinct or order is None:
        rows = F.collect_set(held) if distinct else F.collect_list(held)
        out = F.array_sort(F.transform(rows, lambda r: r["v"]))
    else:
        out = F.transform(F.array_sort(F.collect_list(held)), lambda r: r["v"])
    return F.when(F.size(out) > 0, out)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def merge_map(a: Column, b: Column) -> Column:
    """Both maps' entries; those of b win. Null is an empty map."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def zip_map(headers: Column, cells: Column) -> Column:
    """A map from headers to cells; blank headers are left out, and of a repeated one the last cell counts."""
    n = F.least(F.size(headers), F.size(cells))
    held = F.slice(headers, F.lit(1), n)
    names = F.filter(F.array_distinct(held), lambda x: x.isNotNull() & (x != ""))
    last = lambda back: F.transform(names, lambda x: F.element_at(cells, (n + 1 - F.array_position(back, x)).cast("int")))
    return F.map_from_arrays(names, F.get(F.transform(F.array(F.reverse(held)), last), F.lit(0)))


def enumerate_rows(df: DataFrame, array_col: str, position: str = "position", value: str = "value") -> DataFrame:
    """A row for each element with its place from 1; rows without elements go."""
    return df.select("*", F.posexplode(array_col).alias("_place", value)).withColumn(position, F.col("_place") + 1).drop("_place")


def explode_tokens(df: DataFrame, array_col: str, as_: str) -> DataFrame:
    return df.select("*", F.explode(array_col).alias(as_))


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def _unescaped(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return run(c)


def first_json_string(c: Column, name: str) -> Column:
    """The first string field of that name in a text that holds JSON, plain or with its quotes escaped; entities and escapes undone, null where there is none."""
    plain, quoted = rf'"{name}":"([^"]*)"', rf'\\"{name}\\":\\"([^"]*)\\"'
    found = F.when(c.rlike(plain), F.regexp_extract(c, plain, 1)).when(c.rlike(quoted), F.regexp_extract(c, quoted, 1))
    return F.replace(F.replace(_unescaped(found), F.lit("\\u0026"), F.lit("&")), F.lit("\\/"), F.lit("/"))


def slice_between(c: Column, start: str, end: str, default: int = 50_000) -> Column:
    """The text from one marker to the next, or so many characters where the second is missing; null without the first."""
    a = F.locate(start, c)
    rest = F.substr(c, a)
    z = F.locate(end, rest)
    return F.when(a > 0, F.substr(rest, F.lit(1), F.when(z > 0, z - 1).otherwise(F.lit(default))))
