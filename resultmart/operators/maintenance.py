"""Changes of tables as new tables: upserts, cascades, rule chains, run records and issues.

Nothing is changed in place: each function gives the new table, to be written beside the old one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultmart.functions.arrays import merge_map
from resultmart.functions.text import append_note, normalize_alias
from resultmart.operators.joins import drop_referencing, referencing, unmatched
from resultmart.operators.latest import first_per_key, latest_per_key
from resultmart.sources.tables import written

POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "overwrite": lambda old, new: new,
    "keep": lambda old, new: old,
    "coalesce": lambda old, new: F.coalesce(new, old),
    "merge": merge_map,
    "append": append_note,
}


def guard(*protected: str) -> Callable[[Column, Column], Column]:
    """A policy for states: protected ones stay."""
    return lambda old, new: F.when(old.isin(*protected), old).otherwise(F.coalesce(new, old))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], policy: dict[str, str | Callable[[Column, Column], Column]], order: Sequence[str] = (), null_safe_keys: bool = True) -> DataFrame:
    """Insert rows with new keys and change the others column by column.

    Of updates with the same key the last in ``order`` counts, or by all their other columns without one. Columns without a policy are overwritten. Null keys are
    equal unless ``null_safe_keys`` is false. The result has the columns of ``base``.
    """
    # without an order, the last one by all other columns counts, so that a retry chooses the same
    rest = list(order) or [c for c, kind in updates.dtypes if c not in keys and not kind.startswith("map")]
    last = latest_per_key(updates, list(keys), rest) if rest else updates.dropDuplicates(list(keys))
    old = base.select([F.col(c).alias(f"_o_{c}") for c in base.columns]).withColumn("_old", F.lit(True))
    new = last.select([F.col(c).alias(f"_n_{c}") for c in base.columns]).withColumn("_new", F.lit(True))
    match = F.lit(True)
    for k in keys:
        a, b = F.col(f"_o_{k}"), F.col(f"_n_{k}")
        match = match & (a.eqNullSafe(b) if null_safe_keys else a == b)
    out = []
    for c in base.columns:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keys:
            changed = a
        else:
            rule = policy.get(c, "overwrite")
            changed = (POLICIES[rule] if isinstance(rule, str) else rule)(a, b)
        out.append(F.when(F.col("_old").isNull(), b).when(F.col("_new").isNull(), a).otherwise(changed).alias(c))
    return old.join(new, match, "full").select(*out)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its keys; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table as one folder for each bucket of its keys, for ``upsert_buckets``."""
    df.withColumn("bucket", bucket_of(keys, buckets)).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(path)


def upsert_buckets(path: str, schema: str, updates: DataFrame, keys: Sequence[str], policy: dict[str, str | Callable[[Column, Column], Column]], buckets: int, order: Sequence[str] = ()) -> list[int]:
    """``upsert`` into a table of ``write_buckets`` that reads and rewrites only the buckets that updates fall into; gives those.

    The new rows are written beside the table before any bucket is replaced, so a try that fails in between leaves
    whole buckets, old or new. Repeating it with the same updates gives the same table, as far as the policies do
    (appended notes would be appended again).
    """
    spark = updates.sparkSession
    placed = written(updates.withColumn("bucket", bucket_of(keys, buckets)), "updates")
    touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())  # at most the number of buckets
    if not touched:
        return []
    base = spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    changed = upsert(base, placed.select(*base.columns), [*keys, "bucket"], policy, order)
    new = written(changed, "buckets")
    new.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def insert_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows whose keys aren't there yet, of several with one key the first by their other columns; null keys are never equal."""
    rest = [c for c, kind in rows.dtypes if c not in keys and not kind.startswith("map")]
    first = first_per_key(rows, list(keys), rest) if rest else rows.dropDuplicates(list(keys))
    return base.unionByName(unmatched(first, base, keys).select(base.columns))


#: For each table the columns by which its rows hang on another one, parents first.
REFERENCES: dict[str, dict[str, str]] = {
    "source_documents": {"import_run_id": "import_runs"},
    "parse_issues": {"import_run_id": "import_runs", "source_document_id": "source_documents"},
    "events": {"import_run_id": "import_runs"},
    "categories": {"event_id": "events"},
    "segments": {"category_id": "categories"},
    "schedule_items": {"event_id": "events"},
    "source_skater_appearances": {"import_run_id": "import_runs", "event_id": "events", "category_id": "categories", "segment_id": "segments"},
    "category_results": {"category_id": "categories"},
    "segment_results": {"segment_id": "segments"},
    "official_assignments": {"segment_id": "segments"},
    "pdf_score_summaries": {"segment_id": "segments"},
    "pdf_elements": {"pdf_score_summary_id": "pdf_score_summaries"},
    "pdf_element_judge_scores": {"pdf_element_id": "pdf_elements"},
    "pdf_program_components": {"pdf_score_summary_id": "pdf_score_summaries"},
    "pdf_component_judge_scores": {"pdf_program_component_id": "pdf_program_components"},
    "pdf_mlad_figurist_results": {"segment_id": "segments"},
    "source_archive_files": {"import_run_id": "import_runs", "source_document_id": "source_documents"},
}


def cascade_delete(tables: dict[str, DataFrame], dead_runs: DataFrame, references: dict[str, dict[str, str]] | None = None, root: str = "import_runs", key: str = "id") -> dict[str, DataFrame]:
    """The tables without the dead runs and everything that hangs on them, directly or through other rows.

    ``tables`` have their key in ``key``; ``references`` names each table's parents, in an order in which parents come
    first. A row goes if any of its references goes. Keys are unique; nothing hangs on a table without one.
    """
    gone = {root: dead_runs.select(F.col(dead_runs.columns[0]).alias(key)).distinct()}
    out = dict(tables)
    out[root] = unmatched(tables[root], gone[root], [key])
    known = references or REFERENCES
    for name, parents in known.items():
        if name not in tables:
            continue
        refs = {column: gone[parent] for column, parent in parents.items() if parent in gone and column in tables[name].columns}
        out[name] = drop_referencing(tables[name], refs)
        if key in tables[name].columns and any(name in p.values() and child in tables for child, p in known.items()):
            # written, as every table below asks for them again
            gone[name] = written(referencing(tables[name].select(*dict.fromkeys([key, *refs])), refs).select(key), f"gone-{name}")
    return out


def removed_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(label, removed) of each table."""
    from functools import reduce

    parts = [before[n].agg(F.count("*").alias("n")).crossJoin(after[n].agg(F.count("*").alias("m"))).select(F.lit(n).alias("label"), (F.col("n") - F.col("m")).alias("removed")) for n in before]  # one row each
    return reduce(DataFrame.unionByName, parts)


def refresh_registry(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Entries whose URL has a completed run are imported, and a failed validation of theirs has passed."""
    done = runs.where("status = 'completed'").select(F.col("root_url").alias("url")).distinct().withColumn("_done", F.lit(True))
    out = registry.join(done, "url", "left")
    status = F.when(F.col("_done"), F.lit("imported")).otherwise(F.col("status"))
    valid = F.when(F.col("_done") & (F.col("validation_status") == "failed"), F.lit("passed")).otherwise(F.col("validation_status"))
    return out.withColumn("status", status).withColumn("validation_status", valid).select(registry.columns)


@dataclass
class Rule:
    """Rows for which ``when`` holds get ``set``; every right-hand side sees the row as it was before the rule.

    ``audit`` names the columns whose former values are noted under the rule's name in the map column ``audit_col``.
    """

    name: str
    when: Column
    set: dict[str, Column]
    audit: Sequence[str] = field(default_factory=tuple)


def apply_rules(df: DataFrame, rules: Sequence[Rule], audit_col: str = "raw") -> DataFrame:
    """Apply rules in order; later ones see what earlier ones did."""
    for rule in rules:
        hit = F.coalesce(rule.when, F.lit(False))
        changed = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in rule.set.items()}
        if rule.audit:
            entry = F.to_json(F.create_map(*[x for c in rule.audit for x in (F.lit(f"original_{c}"), F.coalesce(F.col(c).cast("string"), F.lit("")))]))
            changed[audit_col] = F.when(hit, merge_map(F.col(audit_col), F.create_map(F.lit(rule.name), entry))).otherwise(F.col(audit_col))
        df = df.withColumns(changed)
    return df


def close_run(runs: DataFrame, run_id: int, status: str, stats: dict[str, int] | None = None, error: str | None = None) -> DataFrame:
    """Give a started run its end; a failed one keeps its error, in the same table as all others."""
    this = F.col("id") == run_id
    held = F.create_map(*[x for k, v in (stats or {}).items() for x in (F.lit(k), F.lit(str(v)))]) if stats else F.create_map().cast("map<string,string>")
    return runs.withColumns({"status": F.when(this, status).otherwise(F.col("status")), "stats": F.when(this, held).otherwise(F.col("stats")), "error": F.when(this, F.lit(error)).otherwise(F.col("error"))})


def issue_rows(df: DataFrame, level: str = "warning", code: str = "unknown", message: str = "") -> DataFrame:
    """(level, code, message, context) of issues; columns of those names fill them, all others go into the context."""
    own = {"level": level, "code": code, "message": message}
    heads = [(F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v)).alias(k) for k, v in own.items()]
    rest = [c for c in df.columns if c not in own]
    entries = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    context = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return df.select(*heads, context.alias("context"))


def club_id(name: Column) -> Column:
    """A public id that follows from the canonical name."""
    h = F.md5(normalize_alias(name))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def register_missing_aliases(appearances: DataFrame, clubs: DataFrame, aliases: DataFrame, column: str = "club") -> tuple[DataFrame, DataFrame]:
    """Clubs and aliases with an entry for every affiliation that none maps, at once and without change when repeated."""
    seen = appearances.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(F.trim(column).alias("alias_name"))
    seen = seen.withColumn("alias_normalized", normalize_alias(F.col("alias_name")))
    new = first_per_key(unmatched(seen, aliases, ["alias_normalized"]), ["alias_normalized"], ["alias_name"])
    named = new.select(club_id(F.col("alias_name")).alias("club_id"), F.col("alias_name").alias("canonical_name"), F.lit("provisional").alias("status"))
    mapped = new.select("alias_name", "alias_normalized", club_id(F.col("alias_name")).alias("club_id"), F.lit("review").alias("confidence"))
    return insert_ignore(clubs, named, ["club_id"]), insert_ignore(aliases, mapped, ["alias_normalized"])


def seeded_aliases(seed: DataFrame, clubs: DataFrame) -> DataFrame:
    """Aliases from seed rows (canonical_name, alias_name, confidence): of the spellings of one alias the first by the text of its confidence, then by canonical name and spelling."""
    rows = seed.withColumn("alias_normalized", normalize_alias(F.col("alias_name")))
    first = first_per_key(rows, ["alias_normalized"], ["confidence", "canonical_name", "alias_name"])
    return first.join(clubs.select("club_id", "canonical_name"), "canonical_name").select("alias_name", "alias_normalized", "club_id", F.lit("manual_seed").alias("source"), "confidence")
