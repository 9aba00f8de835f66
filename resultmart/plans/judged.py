"""Queries over score sheets, judges' marks and officials: sheets written from line items and read again, the facts of the
mart that hang on sheets, and the reports of runs.

The tables are those of ``derived.layer`` with elements, marks, components, officials and issues beside them. Sheets of one
category have no elements, segments of another one and all galas have no officials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resultmart.operators.aggregate import first_listed
from resultmart.operators.windows import positions
from resultmart.plans import analytics as V
from resultmart.plans import mart, quality, registry, sheets
from resultmart.plans.derived import _SKATERS, layer
from resultmart.plans.queries import ORACLES, query, table
from resultmart.sources.tables import written

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their number in the order."""
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each order with a skater for each line: summary, an element, its totals, two components, deductions."""
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    q, n, returned = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag") == "R"
    rows = F.array(
        F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.lit("Part P"), F.col("l_partkey")), F.lit("AAA"), F.col("l_suppkey").cast("string"), two(q + n), two(q), two(n), F.lit("0.00")),
        F.lit("# Executed Elements"),
        F.concat_ws(" ", F.lit("1"), F.concat(F.lit("3"), F.col("l_returnflag")), two(q), F.lit("0.10 2 - 1"), two(q + 0.1)),
        F.concat_ws(" ", two(q), two(q + 0.1)),
        F.lit("Program Components Factor"),
        F.concat_ws(" ", F.lit("Composition 1.00"), two(n), two(n + 0.25), two(n)),
        F.when(returned, F.concat_ws(" ", F.lit("Presentation 0.50"), two(n), two(n), two(n), two(n), two(n / 2))),
        F.when(returned, "Deductions: Falls -0.50 (1) -0.50").otherwise("Deductions: 0.00"),
    )
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", rows.alias("rows")))), lambda x: x["rows"])), "\n")
    # grouped by the key that lines are numbered by: their texts stay where they are
    return _lines(spark, d).groupBy("l_orderkey").agg(F.concat(F.lit("OPEN\n"), text).alias("text")).select(F.col("l_orderkey").cast("string").alias("doc_id"), "text")


@query(f"""
WITH {_SEQ}, held AS (SELECT n AS skater_no, l_returnflag = 'R' AS r FROM seq)
SELECT 0::BIGINT AS skater_no, NULL AS section, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n, 0::BIGINT AS line_no
UNION ALL SELECT skater_no, section, count(*) * any_value(rows) + CASE WHEN section = 'components' THEN count(*) FILTER (WHERE r) ELSE 0 END, NULL FROM held, (VALUES ('summary', 1), ('elements', 3), ('components', 3)) s(section, rows) GROUP BY skater_no, section
""")
def sheet_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all sheets by skater and section; line_no for those before the first skater."""
    found = sheets.sheet_sections(sheets.lines(_sheets(spark, d))).groupBy("skater_no", "section")
    return found.agg(F.count("*").alias("n"), F.max(F.when(F.col("skater_no") == 0, F.col("line_no"))).cast("long").alias("line_no"))


@query(f"""
WITH {_SEQ}
SELECT l_orderkey, n AS skater_no, l_quantity::DOUBLE AS base_value_total, round(l_quantity + 0.1, 2)::DOUBLE AS element_score_total, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 3 END AS judge_count, CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END::DOUBLE AS deductions FROM seq
""")
def sheet_details(spark: SparkSession, d: str) -> DataFrame:
    out = sheets.sheet_details(sheets.sheet_sections(sheets.lines(_sheets(spark, d))))
    return out.select(F.col("doc_id").cast("long").alias("l_orderkey"), "skater_no", *[F.col(c).cast("double").alias(c) for c in ("base_value_total", "element_score_total", "deductions")], "judge_count")


@query(f"""
WITH {_SEQ}
SELECT l_orderkey, n AS skater_no, 'Composition' AS component_name, 1::DOUBLE AS factor, l_linenumber::DOUBLE AS score, 2 AS marks, l_linenumber + 0.25::DOUBLE AS highest FROM seq
UNION ALL SELECT l_orderkey, n, 'Presentation', 0.5, l_linenumber / 2, 4, l_linenumber FROM seq WHERE l_returnflag = 'R'
""")
def sheet_components(spark: SparkSession, d: str) -> DataFrame:
    out = sheets.component_rows(sheets.sheet_sections(sheets.lines(_sheets(spark, d))))
    return out.select(F.col("doc_id").cast("long").alias("l_orderkey"), "skater_no", "component_name", F.col("factor").cast("double").alias("factor"), F.col("score").cast("double").alias("score"), F.size("judge_scores").alias("marks"), F.array_max("judge_scores").cast("double").alias("highest"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, array_to_string(list(l_orderkey || ':' || l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)[:50], ',') AS first_lines FROM lineitem GROUP BY 1, 2
""")
def bounded_lists(spark: SparkSession, d: str) -> DataFrame:
    """The fifty dearest lines of each flag and status; a flag holds a third of all rows or more."""
    line = F.concat_ws(":", "l_orderkey", "l_linenumber")
    out = first_listed(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], line, [F.desc("l_extendedprice"), *map(F.asc, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))], 50, "lines")
    return out.select("l_returnflag", "l_linestatus", "n", F.array_join("lines", ",").alias("first_lines"))


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def hot_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey"), ["o_orderstatus"], ["o_totalprice", "o_orderkey"]).select("o_orderstatus", "o_orderkey", F.col("position").cast("long").alias("position"))


#: What hangs on sheets and segments, in SQL.
_JUDGED = _SKATERS + f""", {_SEQ},
digit AS (SELECT DISTINCT o_orderpriority AS category_name, substr(o_orderpriority, 1, 1)::BIGINT AS digit FROM orders),
sheet AS (SELECT app.run * 10000000000 + o_orderkey * 10 + 3 AS sheet_id, (app.run * 10 + digit) * 10 + 1 AS segment_id, digit, skater_key, app.*, tes, pcs FROM app JOIN lines USING (o_orderkey) JOIN digit USING (category_name)
  JOIN dim ON app.skater_name = dim.skater_name AND app.nation_code IS NOT DISTINCT FROM dim.nation_code AND app.club_name IS NOT DISTINCT FROM dim.club_name WHERE o_orderkey % 5 > 0),
el AS (SELECT sheet.*, sheet_id * 100 + n AS element_id, n::INT AS n, '3' || l_returnflag AS base_code, '3' || l_returnflag || CASE WHEN l_returnflag = 'R' THEN '<' ELSE '' END AS code, l_quantity, l_linenumber FROM sheet JOIN seq ON l_orderkey = o_orderkey WHERE digit <> 4),
every AS (SELECT runs.id AS run, runs.root_url, held.*, digit, (runs.id * 10 + digit) * 10 + 1 AS segment_id FROM held JOIN runs USING (ev) JOIN digit ON o_orderpriority = category_name),
panel AS (SELECT DISTINCT run, segment_id, s_suppkey, s_name AS name, repeat(chr(65 + s_nationkey), 3) AS nation_code, CASE s_suppkey % 3 WHEN 0 THEN 'referee' WHEN 1 THEN 'judge' ELSE 'technical_panel' END AS role_group, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 9 + 1 END AS judge_number
  FROM every JOIN supplier ON s_nationkey = c_nationkey WHERE digit <> 5)
"""


def judged_layer(spark: SparkSession, d: str, once: bool = True) -> dict[str, DataFrame]:
    """The tables that ``_JUDGED`` describes."""
    t = layer(spark, d, once)
    held = 10_000_000_000
    sheet = t["pdf_score_summaries"].select("id", (F.floor(F.col("id") % held / 10)).alias("l_orderkey"), (F.floor(F.col("segment_id") / 10) % 10).alias("digit"), "total_program_component_score")
    e = sheet.where("digit <> 4").join(_lines(spark, d), "l_orderkey")
    code = F.concat(F.lit("3"), F.col("l_returnflag"))
    cut = F.col("l_returnflag") == "R"
    elements = e.select(
        (F.col("id") * 100 + F.col("n")).alias("id"), F.col("id").alias("pdf_score_summary_id"), F.col("n").alias("element_no"), F.when(cut, F.concat(code, F.lit("<"))).otherwise(code).alias("element_code"), code.alias("base_element_code"),
        F.when(cut & (F.col("l_linenumber") < 7), F.array(F.lit("<"))).otherwise(F.array().cast("array<string>")).alias("markers"), F.col("l_quantity").alias("base_value"), (F.col("l_quantity") + 1).alias("panel_score"),
    )
    marks = elements.select(F.col("id").alias("pdf_element_id"), "element_no", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("judge_number"))
    marks = marks.select(F.xxhash64("pdf_element_id", "judge_number").alias("id"), "pdf_element_id", "judge_number", ((F.col("element_no") + F.col("judge_number")) % 11 - 5).alias("score"))
    names = F.array(*map(F.lit, ("Composition", "Presentation", "Skating Skills")))
    parts = sheet.select("*", F.posexplode(names).alias("c", "component_name"))
    parts = parts.select((F.col("id") * 10 + F.col("c")).alias("id"), F.col("id").alias("pdf_score_summary_id"), "component_name", F.lit("1.33").alias("factor"), (F.col("total_program_component_score") + F.col("c")).alias("score"))
    digit, nation = F.floor(F.col("segment_id") / 10) % 10, F.floor(F.col("segment_id") / 10_000_000)
    seats = t["segments"].where("name = 'Free Skating'").select(F.col("id").alias("segment_id")).where(digit != 5).join(table(spark, d, "supplier"), nation == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    panel = seats.select(F.xxhash64("segment_id", "s_suppkey").alias("id"), "segment_id", F.col("s_name").alias("name"), F.expr("repeat(char(65 + s_nationkey), 3)").alias("nation_code"), F.when(k % 3 == 0, "referee").when(k % 3 == 1, "judge").otherwise("technical_panel").alias("role_group"), F.when(k % 3 == 1, k % 9 + 1).alias("judge_number"))
    order = F.col("id") % held
    issues = t["category_results"].where(order % 10 == 0).select(F.floor(F.col("id") / held).alias("import_run_id"), F.when(order % 20 == 0, "warning").otherwise("info").alias("level"), F.when(order % 30 == 0, "missing_pdf_elements").otherwise("missing_pdf_scores").alias("code"))
    more = {"pdf_elements": elements, "pdf_element_judge_scores": marks, "pdf_program_components": parts, "official_assignments": panel, "parse_issues": issues}
    return t | {name: registry.shaped(df, name) for name, df in more.items()}


def _doubles(*names: str) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in names]


@query(_JUDGED + """
, codes AS (SELECT row_number() OVER (ORDER BY base, code) AS element_key, * FROM (SELECT DISTINCT '3' || l_returnflag AS base, '3' || l_returnflag || CASE WHEN l_returnflag = 'R' THEN '<' ELSE '' END AS code FROM every JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 > 0 AND digit <> 4))
SELECT element_id AS element_score_key, sheet_id AS segment_score_key, run AS event_key, skater_key, element_key, n AS element_no, el.code AS element_code, l_quantity::DOUBLE AS base_value, (l_quantity + 1)::DOUBLE AS panel_score FROM el JOIN codes ON el.code = codes.code
""")
def mart_element_scores(spark: SparkSession, d: str) -> DataFrame:
    out = mart.fact_element_score(judged_layer(spark, d))
    return out.select("element_score_key", "segment_score_key", "event_key", "skater_key", "element_key", "element_no", "element_code", *_doubles("base_value", "panel_score"))


@query(_JUDGED + "SELECT element_id AS element_score_key, sheet_id AS segment_score_key, run AS event_key, segment_id AS segment_key, skater_key, j AS judge_number, (n + j) % 11 - 5 AS score FROM el, (VALUES (1), (2)) m(j)")
def mart_judge_marks(spark: SparkSession, d: str) -> DataFrame:
    return mart.fact_element_judge_mark(judged_layer(spark, d)).select("element_score_key", "segment_score_key", "event_key", "segment_key", "skater_key", "judge_number", "score")


@query(_JUDGED + "SELECT sheet_id * 10 + c AS component_score_key, sheet_id AS segment_score_key, run * 10 + digit AS category_key, skater_key, name AS component_name, 1.33::DOUBLE AS factor, (pcs + c)::DOUBLE AS score FROM sheet, (VALUES (0, 'Composition'), (1, 'Presentation'), (2, 'Skating Skills')) p(c, name)")
def mart_component_scores(spark: SparkSession, d: str) -> DataFrame:
    return mart.fact_component_score(judged_layer(spark, d)).select("component_score_key", "segment_score_key", "category_key", "skater_key", "component_name", *_doubles("factor", "score"))


@query(_JUDGED + "SELECT row_number() OVER (ORDER BY name, nation_code, role_group) AS official_key, name, nation_code, role_group, count(*) AS assignments FROM panel GROUP BY name, nation_code, role_group")
def mart_officials(spark: SparkSession, d: str) -> DataFrame:
    return mart.dim_official(judged_layer(spark, d)).select("official_key", "name", "nation_code", "role_group", "assignments")


@query(_JUDGED + "SELECT role_group, count(*) AS assignments, count(judge_number) AS with_number, count(DISTINCT name) AS people FROM panel GROUP BY 1")
def report_officials(spark: SparkSession, d: str) -> DataFrame:
    return quality.officials_by_role(judged_layer(spark, d))


@query(_JUDGED + """
, seats AS (SELECT segment_id, count(*) AS officials, count(DISTINCT name) AS people, count(DISTINCT role_group) AS roles, max(judge_number)::INT AS judges FROM panel GROUP BY 1)
SELECT s AS segment_id, run AS import_run_id, coalesce(officials, 0) AS officials, coalesce(people, 0) AS people, coalesce(roles, 0) AS roles, judges FROM (SELECT DISTINCT run, segment_id + x AS s FROM every, (VALUES (0), (1)) v(x)) LEFT JOIN seats ON s = seats.segment_id
""")
def report_source_graph(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_graph(judged_layer(spark, d)).select("segment_id", "import_run_id", "officials", "people", "roles", "judges")


@query(_JUDGED + "SELECT run AS import_run_id, root_url, '<' AS kind, count(*) FILTER (WHERE l_linenumber < 7) AS n FROM el WHERE code LIKE '%<' GROUP BY ALL HAVING n > 0 UNION ALL SELECT NULL, NULL, 'unparsed ' || '3' || l_returnflag || '<', count(*) FROM every JOIN seq ON l_orderkey = o_orderkey WHERE o_orderkey % 5 > 0 AND digit <> 4 AND l_returnflag = 'R' AND l_linenumber >= 7 GROUP BY l_returnflag")
def report_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers by run, and codes whose marker the extraction missed."""
    t = judged_layer(spark, d)
    used = quality.marker_usage(t).select("import_run_id", "root_url", F.col("marker").alias("kind"), F.col("elements").alias("n"))
    lost = quality.unparsed_markers(t).groupBy(F.concat(F.lit("unparsed "), F.col("element_code")).alias("kind")).agg(F.count("*").alias("n"))
    return used.unionByName(lost, allowMissingColumns=True)


_MANY = "(SELECT skater_name AS s, nation_code AS c FROM {0} GROUP BY 1, 2 HAVING count(DISTINCT run) > 1) ON skater_name = s AND nation_code IS NOT DISTINCT FROM c"
_DATED = "CASE WHEN start_date IS NOT NULL THEN '1.7.' || y END AS dates"


@query(_JUDGED + f"""
, r AS (SELECT run * 10000000000 + o_orderkey * 10 + 1 AS id, *, (o_totalprice / 1000)::DECIMAL(10, 3) AS points, {_DATED} FROM app)
SELECT id AS skater_appearance_id, lag(points) OVER w::DOUBLE AS previous_points, (points - lag(points) OVER w)::DOUBLE AS points_delta FROM r JOIN {_MANY.format("app")}
WINDOW w AS (PARTITION BY skater_name, nation_code, category_name ORDER BY dates NULLS LAST, event_name, root_url, id)
""")
def report_category_comparison(spark: SparkSession, d: str) -> DataFrame:
    return quality.category_comparison(judged_layer(spark, d)).select("skater_appearance_id", *_doubles("previous_points", "points_delta"))


@query(_JUDGED + f"""
SELECT score_id, run AS event_id, lag(tss) OVER w::DOUBLE AS previous_tss, (tss - lag(tss) OVER w)::DOUBLE AS tss_delta FROM (SELECT *, {_DATED} FROM score) JOIN {_MANY.format("score")}
WINDOW w AS (PARTITION BY skater_name, nation_code ORDER BY dates NULLS LAST, event_name, root_url, score_id)
""")
def report_segment_comparison(spark: SparkSession, d: str) -> DataFrame:
    return quality.segment_comparison(judged_layer(spark, d)).select("score_id", "event_id", *_doubles("previous_tss", "tss_delta"))


@query(_JUDGED + "SELECT segment_id, count(*) FILTER (WHERE lines.o_orderkey IS NOT NULL AND every.o_orderkey % 5 > 0) AS sheets, count(*) AS results FROM every LEFT JOIN lines ON lines.o_orderkey = every.o_orderkey GROUP BY 1 HAVING sheets <> results AND sheets > 0")
def report_sheet_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.sheet_count_mismatches(judged_layer(spark, d)).select("segment_id", "sheets", "results")


@query(_JUDGED + """
, own AS (SELECT every.*, lines.o_orderkey IS NOT NULL AND every.o_orderkey % 5 > 0 AS scored FROM every LEFT JOIN lines ON lines.o_orderkey = every.o_orderkey WHERE run = (SELECT max(id) FROM runs)),
c AS (SELECT count(*) AS n, count(DISTINCT digit) AS cats, count(*) FILTER (WHERE scored) AS scored, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS issues FROM own)
SELECT 'counts' AS part, label AS a, NULL AS b, v AS n FROM (
  SELECT 'events' AS label, 1 AS v UNION ALL SELECT 'source_documents', 2 UNION ALL SELECT 'parse_issues', issues FROM c UNION ALL SELECT 'source_skater_appearances', 2 * n + scored FROM c UNION ALL SELECT 'categories', cats FROM c UNION ALL SELECT 'segments', 2 * cats FROM c
  UNION ALL SELECT 'category_results', n FROM c UNION ALL SELECT 'segment_results', n FROM c UNION ALL SELECT 'official_assignments', (SELECT count(*) FROM panel WHERE run = (SELECT max(id) FROM runs)) UNION ALL SELECT 'pdf_score_summaries', scored FROM c)
UNION ALL SELECT 'issues', CASE WHEN o_orderkey % 20 = 0 THEN 'warning' ELSE 'info' END, CASE WHEN o_orderkey % 30 = 0 THEN 'missing_pdf_elements' ELSE 'missing_pdf_scores' END, count(*) FROM own WHERE o_orderkey % 10 = 0 GROUP BY 2, 3
UNION ALL SELECT DISTINCT 'missing_segment_officials', o_orderpriority, name, 1 FROM own, (VALUES ('Free Skating'), ('Gala')) s(name) WHERE name = 'Gala' OR segment_id NOT IN (SELECT segment_id FROM panel)
UNION ALL SELECT 'pdf_without_elements', o_orderpriority, 'Free Skating', count(*) FROM own WHERE digit = 4 AND scored GROUP BY 2
""")
def report_last_run(spark: SparkSession, d: str) -> DataFrame:
    """All parts of the report of the run with the greatest id."""
    t = judged_layer(spark, d)
    r = quality.run_report(t, t["import_runs"].agg(F.max("id")).first()[0])
    one = F.lit(1).cast("long").alias("n")
    parts = [("counts", r["counts"].select(F.col("label").alias("a"), F.lit(None).cast("string").alias("b"), F.col("rows").alias("n"))), ("issues", r["issues"].select(F.col("level").alias("a"), F.col("code").alias("b"), F.col("count").alias("n")))]
    parts += [("missing_segment_officials", r["missing_segment_officials"].select(F.col("category_name").alias("a"), F.col("segment_name").alias("b"), one)), ("pdf_without_elements", r["pdf_without_elements"].select(F.col("category_name").alias("a"), F.col("segment_name").alias("b"), F.col("summaries").alias("n")))]
    return reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(name)) for name, df in parts])


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS doc_id, o_orderkey % 4 = 0 AS head FROM orders),
links AS (SELECT doc_id, 'e' || k AS link FROM o WHERE head AND k % 3 > 0 UNION ALL SELECT doc_id, 'r' || k FROM o WHERE head AND k % 5 > 0 UNION ALL SELECT doc_id, 'o' || (k % 8) FROM o WHERE NOT head AND k % 3 > 0 UNION ALL SELECT doc_id, 'd' || k FROM o WHERE NOT head AND k % 7 > 0 UNION ALL SELECT doc_id, 'j' || k FROM o WHERE NOT head AND k % 9 > 0),
x AS (SELECT doc_id, 'error' AS level, 'missing_category_entries' AS code FROM o WHERE head AND k % 3 = 0 UNION ALL SELECT doc_id, 'error', 'missing_category_result' FROM o WHERE head AND k % 5 = 0 UNION ALL SELECT doc_id, 'warning', 'missing_segment_officials' FROM o WHERE NOT head AND k % 3 = 0
  UNION ALL SELECT doc_id, 'error', 'missing_segment_details' FROM o WHERE NOT head AND k % 7 = 0 UNION ALL SELECT doc_id, 'warning', 'missing_segment_judges_scores' FROM o WHERE NOT head AND k % 9 = 0 UNION ALL SELECT doc_id, 'warning', 'duplicate_link' FROM links GROUP BY doc_id, link HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'warning', 'schedule_not_in_index' FROM o WHERE head)
SELECT doc_id, level, code, count(*) AS n FROM x GROUP BY ALL
""")
def report_index_issues(spark: SparkSession, d: str) -> DataFrame:
    """An index for each customer: a line for each order, every fourth of which is a category; the schedule names all of them as segments."""
    k = F.col("o_orderkey")
    head = k % 4 == 0
    link = lambda of, mark, every, n=k: F.when(of & (k % every > 0), F.concat(F.lit(mark), n)).alias({"e": "entries", "r": "result", "o": "officials", "d": "details", "j": "judges_scores"}[mark])
    name = k.cast("string")
    index = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(head, "category").otherwise("segment").alias("kind"), F.lit("Open").alias("category"), name.alias("segment"), link(head, "e", 3), link(head, "r", 5), link(~head, "o", 3, k % 8), link(~head, "d", 7), link(~head, "j", 9))
    index = written(index, "index")
    return quality.index_issues(index, index.select("doc_id", "category", "segment")).groupBy("doc_id", "level", "code").agg(F.count("*").alias("n"))


def _with_profiles(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The layer with events that name their profile; profiles with an odd number have clubs first. Every 17th order's name is a mark of qualification."""
    t = layer(spark, d)
    first = F.when(F.col("id") % 2 == 1, "club").otherwise("nation")
    marked = F.when((F.floor(F.col("id") % 10_000_000_000 / 10) % 17 == 0) & (F.col("normalized_name") != ""), "Q").otherwise(F.col("normalized_name"))
    more = {
        "source_profiles": t["source_profiles"].withColumn("representation_primary", first),
        "events": t["events"].withColumn("source_profile_id", F.floor(F.col("id") / 100_000) % 5),
        "source_skater_appearances": t["source_skater_appearances"].withColumn("normalized_name", marked),
    }
    return t | more


_PROFILED = _JUDGED + """
, kinds AS (SELECT * FROM (VALUES (1, 'category_result'), (2, 'segment_result'), (3, 'pdf_score')) k(i, appearance_type)),
row_ AS (SELECT every.run, every.root_url, every.o_orderkey, o_custkey, o_orderpriority, c_name, i, appearance_type, r_name AS profile_key, CASE WHEN r_regionkey % 2 = 1 THEN 'club' ELSE 'nation' END AS first, CASE WHEN o_custkey % 6 = 0 THEN '' WHEN o_custkey % 11 = 0 THEN 'x' ELSE repeat(chr(65 + c_nationkey), 3) END AS nation,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS club, CASE WHEN o_custkey % 13 = 0 THEN '' WHEN every.o_orderkey % 17 = 0 THEN 'Q' ELSE upper(c_name) END AS shown, run IN (SELECT id FROM latest) AS is_latest
  FROM every CROSS JOIN kinds JOIN region ON r_regionkey = c_nationkey % 5 LEFT JOIN lines ON lines.o_orderkey = every.o_orderkey WHERE i < 3 OR (lines.o_orderkey IS NOT NULL AND every.o_orderkey % 5 > 0))
"""


@query(_PROFILED + """
SELECT first AS representation_primary, count(*) AS appearances, count(nullif(nation, '')) AS with_country, count(nullif(club, '')) AS with_club, count(*) FILTER (WHERE nation = 'x') AS non_iso_nation_codes, count(*) FILTER (WHERE first = 'club' AND club = '') AS club_primary_empty_club
FROM row_ WHERE is_latest AND shown <> '' GROUP BY 1
""")
def view_quality_representation(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_data_quality_representation(_with_profiles(spark, d))
    return out.select("representation_primary", "appearances", "with_country", "with_club", "non_iso_nation_codes", "club_primary_empty_club")


@query(_PROFILED + "SELECT run AS import_run_id, root_url, run * 10000000000 + o_orderkey * 10 + i AS id, appearance_type, c_name AS raw_name, shown AS normalized_name FROM row_ WHERE is_latest AND shown IN ('', 'Q')")
def report_bad_names(spark: SparkSession, d: str) -> DataFrame:
    return quality.bad_names(_with_profiles(spark, d)).drop("raw_source_name")


@query(_PROFILED + """
SELECT run AS event_run_id, profile_key, appearance_type, CASE WHEN club = '' THEN 'missing_club' ELSE 'has_club' END AS club_state, count(*) AS appearances, count(DISTINCT nation) AS nations, count(DISTINCT nullif(club, '')) AS clubs FROM row_ WHERE i = 1 GROUP BY ALL
""")
def report_representation_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.representation_buckets(_with_profiles(spark, d)).drop("representation_type")


@query(_PROFILED + "SELECT run AS event_run_id, profile_key, nation AS nation_code, count(*) AS appearances FROM row_ WHERE i = 1 AND first = 'club' AND club = '' GROUP BY ALL")
def report_missing_clubs(spark: SparkSession, d: str) -> DataFrame:
    return quality.club_primary_without_club_by_nation(_with_profiles(spark, d))


@query(_PROFILED + """
SELECT run AS event_run_id, profile_key, o_orderpriority AS category_name, appearance_type, c_name AS raw_name, nation AS nation_code, 'review: empty club, possible individual/unknown/empty source value' AS validation_status, run * 10000000000 + o_orderkey * 10 + i AS id
FROM row_ WHERE i = 1 AND first = 'club' AND club = '' ORDER BY run, o_orderpriority, c_name, id LIMIT 200
""")
def report_missing_club_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows for a reviewer."""
    return quality.club_primary_without_club(_with_profiles(spark, d)).drop("representation_value")


@query(_PROFILED + """
SELECT run AS event_run_id, profile_key, o_orderpriority AS category_name, c_name AS raw_name, nation AS nation_code, club AS club_name, run * 10000000000 + o_orderkey * 10 + i AS id
FROM row_ WHERE i = 1 AND first = 'nation' AND club <> '' ORDER BY run, profile_key, o_orderpriority, c_name, id LIMIT 200
""")
def report_nation_first_with_club(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows for a reviewer."""
    return quality.nation_primary_with_club(_with_profiles(spark, d))


@query(f"SELECT canonical_name, alias_name AS aliases, uses AS imported_appearance_count, event_count FROM ({ORACLES['view_alias_usage']})")
def mart_clubs(spark: SparkSession, d: str) -> DataFrame:
    return mart.dim_club(layer(spark, d)).select("canonical_name", F.array_join("aliases", ",").alias("aliases"), "imported_appearance_count", "event_count")
