"""What moves between tasks: large tables as often as their joins need, small ones instead of them."""

import pytest
from pyspark.sql import functions as F

from resultmart.operators import joins as J
from resultmart.operators import maintenance as M
from resultmart.plans import analytics as V
from resultmart.plans import derived, mart, registry
from resultmart.sources.tables import empty_layer, load_layer, write_layer

MANY = 2_000_000


def moves(df, column: str) -> int:
    """Exchanges of a plan, as it begins, whose rows hold the column."""

    def walk(node) -> int:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan())
        below = node.children()
        own = name == "Exchange" and any(node.output().apply(i).name() == column for i in range(node.output().size()))
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(empty):
    return dict(empty)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layer"))
    write_layer(empty_layer(spark), root)
    return load_layer(spark, root, views=False)


def _spread(spark, *names: str) -> dict:
    """Rows of tables in several partitions, so that joins have to move them."""
    return {n: registry.shaped(spark.range(20, numPartitions=4).select("id", *[F.col("id").alias(c) for c in ("pdf_score_summary_id", "pdf_element_id", "element_no", "judge_number")]), n) for n in names}


def test_appearances_stay_where_events_are_few(spark, stored):
    few = spark.range(MANY).where("id < 3")
    run = F.concat(F.lit("u"), F.col("id"))
    t = stored | {
        "import_runs": registry.shaped(few.select("id", run.alias("root_url"), F.lit("completed").alias("status")), "import_runs"),
        "events": registry.shaped(few.select("id", F.col("id").alias("import_run_id"), run.alias("name")), "events"),
        "source_skater_appearances": registry.shaped(spark.range(MANY).select("id", (F.col("id") % 4).alias("event_id"), F.lit("A").alias("normalized_name")), "source_skater_appearances"),
    }
    out = V.v_skater_appearances_clean(t)
    assert moves(out, "skater_appearance_id") == 0
    assert out.groupBy("event_name").count().orderBy("event_name").collect() == [("u0", MANY // 4), ("u1", MANY // 4), ("u2", MANY // 4)]


def test_rows_of_the_layer_need_no_join_by_event(spark, no_broadcast):
    assert moves(derived.layer(spark, "/root/testdata/sf0.001")["source_skater_appearances"], "raw_name") == 0
    assert moves(derived.layer(spark, "/root/testdata/sf0.001")["source_skater_appearances"], "c_name") == 0


def test_facts_take_skaters_without_their_counts(spark, stored):
    t = stored | {"view:dim_skater": spark.range(1).select((F.col("id") + 7).alias("skater_key"), F.lit("A").alias("skater_name"), F.lit("B").alias("nation_code"), F.lit(None).cast("string").alias("club_name"))}
    assert [r.skater_key for r in mart._skater_keys(t).collect()] == [7]
    assert mart._skater_keys(stored).columns == mart._skater_keys(t).columns


def test_marks_move_once(spark, stored, no_broadcast):
    stored |= _spread(spark, "pdf_elements", "pdf_element_judge_scores")
    out = mart.fact_element_judge_mark(stored)
    assert moves(out, "judge_number") == 1
    assert out.columns == ["segment_score_key", "element_score_key", "element_judge_mark_key", "official_assignment_id", "judge_number", "score", "event_key", "category_key", "segment_key", "skater_key"]


def test_marks_stay_where_judges_are_few(spark):
    n = F.col("id")
    panel = spark.range(MANY).select((n % 5).alias("segment_id"), F.lit("judge").alias("role_group"), (n % 3).alias("judge_number"), F.concat(F.lit("n"), n % 3).alias("official_id"))
    marks = spark.range(MANY).select((n % 6).alias("segment_id"), (n % 3).alias("judge_number"), n.alias("mark"))
    out = J.assign_officials(marks, panel)
    assert moves(out, "mark") == 0
    assert out.agg(F.count("*"), F.count("official_id")).first() == (MANY, out.where("segment_id < 5").count())


def test_elements_move_once_to_their_sheets(spark, stored, no_broadcast):
    stored |= _spread(spark, "pdf_elements")
    assert moves(V.v_skater_elements(stored), "element_no") == 1
    # at most a second time for their codes, as small tables are not sent here
    assert moves(mart.fact_element_score(stored), "element_no") <= 2


def test_rows_that_go_are_those_that_do_not_stay(spark, no_broadcast):
    rows = spark.createDataFrame([(1, 10, 5), (2, 10, None), (3, None, 5), (4, None, None), (5, 11, 6), (6, 12, 6)], "id int, a int, b int")
    refs = {"a": spark.createDataFrame([(10,), (12,), (None,)], "k int"), "b": spark.createDataFrame([(5,)], "k int")}
    assert sorted(r.id for r in J.referencing(rows, refs).collect()) == [1, 2, 3, 6]
    assert sorted(r.id for r in J.drop_referencing(rows, refs).collect()) == [4, 5]
    tables = {"r": spark.range(3), "a": spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, r long"), "b": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, a long"), "c": spark.createDataFrame([(1, 1), (2, 2)], "id long, b long")}
    out = M.cascade_delete(tables, spark.range(1), {"a": {"r": "r"}, "b": {"a": "a"}, "c": {"b": "b"}}, "r")
    assert {n: sorted(r.id for r in df.collect()) for n, df in out.items()} == {"r": [1, 2], "a": [2, 3], "b": [2, 3], "c": [2]}
