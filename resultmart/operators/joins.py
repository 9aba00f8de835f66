"""Joins: null-safe, preferring one source, anti, by alias, by longest prefix, updating."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultmart.functions.text import normalize_alias
from resultmart.sources.tables import written


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns where null equals null; Spark still hashes them. The right side's keys are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    out = left.join(renamed, _all([left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]), how)
    return out.drop(*[f"_r_{c}" for c in on])


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def prefer_source(preferred: DataFrame, fallback: DataFrame, on: Sequence[str], null_safe: Sequence[str] = (), compatible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """All rows of the preferred source and those of the fallback that match none of them.

    ``compatible(preferred, fallback)`` may restrict what counts as a match beyond the keys. Both have the same columns.
    """
    a, b = _side(preferred, "p_"), _side(fallback, "f_")
    p, f = (lambda c: a["p_" + c]), (lambda c: b["f_" + c])
    match = _all([p(c).eqNullSafe(f(c)) if c in null_safe else p(c) == f(c) for c in [*on, *null_safe]])
    if compatible is not None:
        match &= compatible(p, f)
    rest = b.join(a, match, "left_anti")
    return preferred.unionByName(rest.select([F.col("f_" + c).alias(c) for c in fallback.columns]))


def unmatched(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def drop_referencing(df: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """Rows of which no column refers to a row of its table (one column each); a null refers to nothing."""
    for column, gone in refs.items():
        keys = gone.select(F.col(gone.columns[0]).alias("_gone")).where("_gone IS NOT NULL")
        df = df.join(keys, df[column] == keys["_gone"], "left_anti")
    return df


def referencing(df: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """Rows of which a column refers to a row of its table (one column each, without repeats); what ``drop_referencing`` drops, found in one pass."""
    out, hit = df, F.lit(False)
    for i, (column, gone) in enumerate(refs.items()):
        keys = gone.select(F.col(gone.columns[0]).alias(f"_gone{i}")).where(f"_gone{i} IS NOT NULL")
        out = out.join(keys, F.col(column) == F.col(f"_gone{i}"), "left")
        hit = hit | F.col(f"_gone{i}").isNotNull()
    return out.where(hit).select(df.columns)


def resolve_alias(df: DataFrame, column: str, aliases: DataFrame, clubs: DataFrame) -> DataFrame:
    """Add club_id and canonical_name by the normalised text of a column; ``aliases`` has alias_normalized and club_id.

    The registry is small beside the results; Spark broadcasts it if it is below the session's threshold.
    """
    known = aliases.join(clubs.select("club_id", "canonical_name"), "club_id").select(F.col("alias_normalized").alias("_alias"), "club_id", "canonical_name")
    return df.withColumn("_key", normalize_alias(F.col(column))).join(known, F.col("_key") == F.col("_alias"), "left").drop("_key", "_alias")


def longest_prefix_join(df: DataFrame, profiles: DataFrame, row_key: Sequence[str], host: str, path: str, prefix: str) -> DataFrame:
    """Give each row the profile with its host and the longest prefix of its path, the first by its other columns among equals.

    A path is cut to the lengths that its host's prefixes have, at most as many as it has characters, and the cuts meet
    the prefixes by equality: the work grows with the different lengths, not with the profiles of a host. Rows without
    a profile keep nulls. A prefix's wildcard characters are ordinary ones.
    """
    values = [c for c in profiles.columns if c != host]
    known = profiles.where(F.col(host).isNotNull() & F.col(prefix).isNotNull())
    first = F.struct(*[F.col(c) for c, kind in profiles.dtypes if c != host and not kind.startswith("map")])
    right = known.groupBy(F.col(host).alias("_host"), F.col(prefix).alias("_prefix")).agg(F.min_by(F.struct(*values), first).alias("profile"))
    lengths = right.groupBy("_host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = df.select(*row_key, F.col(host).alias("_host"), F.col(path).alias("_path")).join(lengths, "_host")
    cuts = asked.select(*row_key, "_host", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"), "_path").withColumn("_prefix", F.substr("_path", F.lit(1), "_n"))
    best = cuts.join(right, ["_host", "_prefix"]).groupBy(*row_key).agg(F.max_by("profile", "_n").alias("profile"))
    return df.join(best, list(row_key), "left").select(*df.columns, *[F.col(f"profile.{c}").alias(c) for c in values])


def update_from(df: DataFrame, source: DataFrame, on: Sequence[str], set_: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Set columns of the rows that the source matches: ``set_[column](old, new)``. The source has one row per key."""
    renamed = source.select(*on, *[F.col(c).alias(f"_new_{c}") for c in set_]).withColumn("_hit", F.lit(True))
    out = df.join(renamed, list(on), "left")
    return out.select([(F.when(F.col("_hit"), set_[c](F.col(c), F.col(f"_new_{c}"))).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c)) for c in df.columns])


def assign_officials(marks: DataFrame, officials: DataFrame) -> DataFrame:
    """Add the official behind a judge's column, by segment and judge number. Judges, few beside marks, are written: where they are small, marks stay where they are."""
    judges = officials.where("role_group = 'judge' AND judge_number IS NOT NULL").groupBy("segment_id", "judge_number").agg(F.min("official_id").alias("official_id"))
    return marks.join(written(judges, "judges"), ["segment_id", "judge_number"], "left")
