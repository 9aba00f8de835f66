"""Operators that spread what one task held: lags over ranges, buckets that are rewritten alone, constraints in one pass."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from resultmart.operators import maintenance as M
from resultmart.operators import windows as W
from resultmart.operators.aggregate import first_listed
from resultmart.plans import quality


def test_lags_over_ranges_equal_the_window(spark):
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 50).alias("at"), F.col("id").alias("tie"), F.when(F.col("id") % 5 > 0, F.col("id") * 3).alias("m"))
    args = (["k"], ["at"], ["m"], "tie")
    expected = sorted(map(repr, W.progression(rows, *args).collect()))
    assert sorted(map(repr, W.ranged_progression(rows, *args).collect())) == expected
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = W.ranged_progression(rows, *args)
        assert sorted(map(repr, found.collect())) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert W.ranged_progression(rows.limit(0), *args).count() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "id long, name string, n int"
    base = spark.range(200).select("id", F.lit("old").alias("name"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([(None, "null", 1)], schema))
    M.write_buckets(base, path, ["id"], 8)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    def rows():
        return sorted(((r.id is None, r.id, r.name, r.n) for r in spark.read.schema(schema).parquet(path).collect()), key=repr)

    before = files()
    updates = spark.createDataFrame([(5, "new", None), (5, "newer", None), (1000, "added", 2), (None, "was null", None)], schema)
    touched = M.upsert_buckets(path, schema, updates, ["id"], {"n": "coalesce"}, 8)
    after = files()
    assert 0 < len(touched) < 8
    kept = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    held = {i: (name, n) for null, i, name, n in rows()}
    assert held[5] == ("newer", 1) and held[1000] == ("added", 2) and held[None] == ("was null", 1) and held[6] == ("old", 1) and len(rows()) == 202
    first = rows()
    assert M.upsert_buckets(path, schema, updates, ["id"], {"n": "coalesce"}, 8) == touched and rows() == first
    assert M.upsert_buckets(path, schema, updates.limit(0), ["id"], {}, 8) == [] and rows() == first


def test_constraints(spark):
    t = {
        "import_runs": spark.createDataFrame([(1, "completed"), (2, "odd"), (3, None)], "id long, status string"),
        "events": spark.createDataFrame([(10, 1, "u"), (11, 1, "u"), (12, 9, "u"), (13, None, "v")], "id long, import_run_id long, source_url string"),
        "categories": spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 77, "a"), (4, 77, "a")], "id long, event_id long, name string"),
        "source_url_registry": spark.createDataFrame([("x", "ready", "passed"), ("y", "imported", None)], "url string, status string, validation_status string"),
    }
    found = {(r.table, r.rule, r.value, r.rows) for r in quality.constraint_violations(t, references=True).collect()}
    assert found == {
        ("import_runs", "domain of status", "odd", 1), ("events", "unique import_run_id, source_url", "1|u", 2), ("events", "import_run_id in import_runs", "9", 1),
        ("categories", "unique event_id, name", "77|a", 2), ("categories", "event_id in events", "77", 2), ("source_url_registry", "domain of status", "ready", 1),
    }
    assert {r.rule for r in quality.constraint_violations(t).collect()} == {x[1] for x in found if " in " not in x[1]}
    assert quality.constraint_violations({"events": t["events"].limit(0)}).count() == 0


def test_first_values_of_a_group_of_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 1000 > 0, "hot").when(F.col("id") % 2000 > 0, F.concat(F.lit("k"), F.col("id") % 7000)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("at"), "id")
    value = F.when(F.col("id") % 3 > 0, F.col("id"))
    found = first_listed(rows, ["k"], value, [F.asc("at"), F.asc("id")], 20)
    groups: dict = {}
    for r in rows.select("k", "at", "id").toPandas().itertuples():
        groups.setdefault(r.k if isinstance(r.k, str) else None, []).append((r.at, r.id))
    expected = {k: (len(v), [i if i % 3 else None for _, i in sorted(v)[:20]]) for k, v in groups.items()}
    assert {r.k: (r.n, r["values"]) for r in found.collect()} == expected and None in expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]
    assert first_listed(rows.limit(0), ["k"], value, [F.asc("id")], 3).count() == 0


def test_positions_over_ranges_equal_the_window(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("k"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 50).alias("at"), "id")
    w = Window.partitionBy("k").orderBy(F.col("at").asc_nulls_last(), "id")
    expected = sorted(map(repr, rows.withColumn("position", F.row_number().over(w)).collect()))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            found = W.positions(rows, ["k"], ["at", "id"])
            assert sorted(map(repr, found.collect())) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert W.positions(rows.limit(0), ["k"], ["at", "id"]).count() == 0
