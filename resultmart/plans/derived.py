"""Queries that run the extraction, views, reports and registry plans over tables derived from the supplied ones.

Pages and score sheets are written from the rows of a table and read again by the extraction, so their SQL states what
the rows were. The tables of the source layer are a reading of orders as skaters' results: an event for each nation and
year, a category for each priority, a skater for each customer, a score sheet for each order that has line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resultmart.functions import text as T
from resultmart.operators import latest as L
from resultmart.operators.aggregate import labelled_counts
from resultmart.operators.maintenance import club_id, guard, seeded_aliases, upsert_buckets, write_buckets
from resultmart.operators.windows import ranged_progression
from resultmart.plans import analytics as V
from resultmart.plans import mart, pages, quality, registry, resolution, sheets
from resultmart.plans.queries import day, query, table
from resultmart.sources import tables as S
from resultmart.sources.tables import written

SITE = "http://scores.invalid/"


def _tag(name: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{name}>"))


def _row(*cells: Column) -> Column:
    return _tag("tr", *[_tag("td", c) for c in cells])


def _pages(rows: DataFrame, url: Column, title: Column, headers: tuple[str, ...], row: Column, order: str) -> DataFrame:
    """A page for each url: a title and one table with a row for each row of the input."""
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in headers) + "</tr>"
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"])
    caption = F.concat(F.lit("<caption><h2>Open</h2><h2>"), F.min("title"), F.lit("</h2></caption>"))
    # rows are written before they are gathered, as an aggregate reads its arguments without compiled code
    rows = rows.select(url.alias("url"), title.alias("title"), F.col(order).alias("at"), row.alias("row"))
    return rows.groupBy("url").agg(F.concat(F.lit("<table>"), caption, F.lit(head), F.array_join(texts, ""), F.lit("</table>")).alias("body"))


def _money(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


@query("SELECT c_custkey::INT AS entry_no, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN repeat(chr(65 + c_nationkey), 3) ELSE 'Club ' || c_nationkey END AS nation, c_mktsegment AS category FROM customer")
def page_entries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("nation", F.when(F.col("c_nationkey") % 2 == 0, F.expr("repeat(char(65 + c_nationkey), 3)")).otherwise(F.concat(F.lit("Club "), F.col("c_nationkey"))))
    url = F.concat(F.lit(SITE), F.col("c_mktsegment"), F.lit("/"), F.floor(F.col("c_custkey") / 50), F.lit("/CAT001EN.HTM"))
    name = F.concat(F.lit('<a href="x.htm">'), F.col("c_name"), F.lit("</a>"))
    docs = _pages(c, url, F.col("c_mktsegment"), ("No.", "Name", "Nat."), _row(F.col("c_custkey").cast("string"), name, F.col("nation")), "c_custkey")
    return pages.entry_rows(pages.rows(docs)).select("entry_no", "name", "nation", "category")


@query("""
SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS final_place, 'Order ' || o_orderkey AS name, 'Customer ' || o_custkey AS category,
  round(o_totalprice, 2)::DOUBLE AS points, (o_orderkey % 9)::INT AS sp, CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 9)::INT END AS fs FROM orders
""")
def page_category_results(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(L.Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("string")
    o = table(spark, d, "orders").withColumn("place", place)
    k = F.col("o_orderkey")
    row = _row(F.col("place"), F.concat(F.lit("Order "), k), F.lit("&nbsp;"), _money("o_totalprice"), (k % 9).cast("string"), F.when(k % 4 > 0, (F.col("o_custkey") % 9).cast("string")).otherwise("-"))
    docs = _pages(o, F.concat(F.lit(f"{SITE}c"), F.col("o_custkey"), F.lit("/CAT001RS.HTM")), F.concat(F.lit("Customer "), F.col("o_custkey")), ("FPl.", "Name", "Nation", "Points", "SP", "FS"), row, "o_orderkey")
    out = pages.category_result_rows(pages.rows(docs))
    return out.select("final_place", "name", "category", F.col("points").cast("double").alias("points"), F.try_element_at("segment_places", F.lit("SP")).alias("sp"), F.try_element_at("segment_places", F.lit("FS")).alias("fs"))


@query("""
SELECT l_partkey::INT AS starting_number, 'Line ' || l_orderkey AS name, round(l_extendedprice, 2)::DOUBLE AS tss, l_quantity::DOUBLE AS tes, round(l_tax, 2)::DOUBLE AS pcs, round(l_discount, 2)::DOUBLE AS co, 'Supplier ' || l_suppkey AS category, 'Free Skating' AS segment FROM lineitem
""")
def page_segment_results(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    row = _row(F.lit("1"), F.concat(F.lit("Line "), F.col("l_orderkey")), F.lit("AAA"), *[_money(c) for c in ("l_extendedprice", "l_quantity")], F.lit(""), _money("l_tax"), _money("l_discount"), F.lit("0.00"), F.concat(F.lit("#"), F.col("l_partkey")))
    url = F.concat(F.lit(f"{SITE}s"), F.col("l_suppkey"), F.lit("/"), F.pmod("l_orderkey", F.lit(997)), F.lit("/SEG001.HTM"))
    docs = _pages(line, url, F.concat(F.lit("Supplier "), F.col("l_suppkey"), F.lit(" - Free Skating")), ("Pl.", "Name", "Nation", "TSS<br />=", "TES<br />+", "&nbsp;", "PCS<br />+", "CO", "Deduction<br />-", "StN."), row, "l_orderkey")
    out = pages.segment_result_rows(pages.rows(docs))
    return out.select("starting_number", "name", *[F.col(c).cast("double").alias(c) for c in ("tss", "tes", "pcs")], F.element_at("components", F.lit("co")).cast("double").alias("co"), "category", "segment")


_FUNCTIONS = ("Referee", "Judge No.%d", "Technical Controller", "Assistant Technical Specialist", "Data Operator", "Judges Panel")


@query("""
SELECT s_name AS name, CASE s_suppkey % 6 WHEN 0 THEN 'referee' WHEN 1 THEN 'judge' WHEN 2 THEN 'technical_panel' WHEN 3 THEN 'technical_panel' WHEN 4 THEN 'event_operations' ELSE 'other' END AS role_group,
  CASE WHEN s_suppkey % 6 = 1 THEN (s_suppkey % 9 + 1)::INT END AS judge_number FROM supplier
""")
def page_officials(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.element_at(F.array(*map(F.lit, _FUNCTIONS)), (k % 6 + 1).cast("int"))
    function = F.replace(text, F.lit("%d"), (k % 9 + 1).cast("string"))
    s = table(spark, d, "supplier")
    docs = _pages(s, F.concat(F.lit(f"{SITE}n"), F.col("s_nationkey"), F.lit("/"), F.floor(k / 50), F.lit("/SEG001OF.HTM")), F.lit("Men - Free Skating"), ("Function", "Name", "Nation"), _row(function, F.col("s_name"), F.lit("AAA")), "s_suppkey")
    return pages.official_rows(pages.rows(docs)).select("name", "role_group", "judge_number")


_KINDS = ["pdf", "html_fallback", "site_fallback", "html_wrapper", "html", "html", "html", "meta_refresh", "unknown_html"]


def _fetched(page: DataFrame) -> DataFrame:
    """Documents of each page: its text with what makes it one of the kinds, by the number of the page."""
    k, html = F.col("page_id") % 9, F.replace("html", F.lit("<"), F.lit("&lt;"))
    shell = F.concat(F.lit('<!DOCTYPE html><div id="root"></div><script src="/assets/index-1.js"></script>'), html)
    wrapper = F.concat(F.lit('<script src="scripts/results.js"></script><body> </body>'), html)
    mark = lambda x: F.concat(html, F.lit(x))
    refresh = F.concat(F.lit("<META http-equiv='Refresh' content='0; url="), (F.col("page_id") - 1).cast("string"), F.lit("'>"), html)
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.4 "), html)).when(k == 2, shell).when(k == 3, wrapper).when(k == 4, mark("<p>FS Manager</p>")).when(k == 5, mark("<iframe src='a'></iframe><p>ISUCalcFS</p>")).when(k == 6, mark("<td>JudgesDetailsPerSkater</td>")).when(k == 7, refresh).otherwise(mark("<th>Category</th>"))
    return page.select("page_id", F.concat(F.lit(f"{SITE}docs/"), F.col("page_id"), F.when(k == 1, ".pdf?x=1").otherwise("")).alias("url"), body.alias("body"))


@query(f"SELECT page_id, ({_KINDS!r})[page_id % 9 + 1] AS kind, CASE WHEN page_id % 9 = 7 THEN '{SITE}docs/' || (page_id - 1) END AS refresh_url FROM pages")
def page_preflight(spark: SparkSession, d: str) -> DataFrame:
    return resolution.preflight(_fetched(table(spark, d, "pages"))).select("page_id", F.col("source_class").alias("kind"), "refresh_url")


@query(f"""
WITH k AS (SELECT page_id, ({_KINDS!r})[page_id % 9 + 1] AS kind FROM pages)
SELECT k.page_id, CASE WHEN k.kind = 'meta_refresh' THEN coalesce(t.kind, 'unreachable') ELSE k.kind END AS content_kind, CASE WHEN k.kind IN ('html', 'pdf') OR k.kind = 'meta_refresh' AND t.kind IS NOT NULL THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN k.kind = 'meta_refresh' THEN '{SITE}docs/' || (k.page_id - 1) END AS resolved_url
FROM k LEFT JOIN k t ON t.page_id = k.page_id - 1
""")
def source_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = written(_fetched(table(spark, d, "pages")), "fetched")
    out = resolution.check_sources(docs).join(docs.select("url", "page_id"), "url")
    return out.select("page_id", "content_kind", "status", "resolved_url")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_keys FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT *, o_custkey % 3 = 0 AS ring FROM o)
SELECT o_orderkey, CASE WHEN NOT ring THEN all_keys[n] END AS last_key, CASE WHEN NOT ring THEN (n - 1 - i)::INT END AS hops, ring AS loops, CASE WHEN ring THEN all_keys[(i + 3) % n + 1] ELSE all_keys[least(i + 3, n - 1) + 1] END AS third_key
FROM c WHERE ring OR i < n - 1
""")
def refresh_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each order sends to the customer's next one; with every third customer the last one sends to the first."""
    by = L.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = F.first("o_orderkey").over(by)
    nexts = F.coalesce(F.lead("o_orderkey").over(by), F.when(F.col("o_custkey") % 3 == 0, first))
    links = written(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source"), nexts.cast("string").alias("target")).where("target IS NOT NULL"), "sent")
    end = resolution.follow_links(links).select("source", "target", "hops", "loops")
    third = resolution.walk_links(links, 3).select("source", F.col("target").alias("third"))
    return end.join(third, "source").select(F.col("source").cast("long").alias("o_orderkey"), F.col("target").cast("long").alias("last_key"), "hops", "loops", F.col("third").cast("long").alias("third_key"))


@query("""
WITH o AS (SELECT c_custkey, c_custkey % 5 AS k, count(o_orderkey) FILTER (WHERE o_orderkey % 4 = 0) AS heads, count(o_orderkey) FILTER (WHERE o_orderkey % 4 > 0) AS rest, min(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END) AS first_head FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT o.*, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 > 0 AND o_orderkey > first_head) AS parts FROM o)
SELECT c_custkey, CASE WHEN k = 3 OR k = 1 AND heads > 0 THEN 'old_isucalcfs' ELSE 'fs_manager' END AS parser_profile, CASE k WHEN 2 THEN 'FS Manager' WHEN 3 THEN 'ISUCalcFS' END AS platform,
  CASE WHEN k IN (2, 4) THEN 0 ELSE heads END AS n_categories, CASE WHEN k IN (2, 4) THEN 0 ELSE parts END AS n_segments, CASE WHEN k IN (2, 4) OR heads = 0 THEN 'failed' ELSE 'passed' END AS validation_status
FROM s
""")
def page_readings(spark: SparkSession, d: str) -> DataFrame:
    """An index for each customer: in the new layout (0), in the old one without a mark (1), with the other's mark (2) or its own (3), or without a table (4)."""
    five = lambda a, b: _row(a, b, F.lit("e"), F.lit("r"), F.lit("j"))
    key, k = F.concat(F.lit("Order "), F.col("o_orderkey")), F.col("c_custkey") % 5
    line = F.when(F.col("o_orderkey") % 4 == 0, five(key, F.lit(""))).otherwise(five(F.lit(""), key))
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderkey").isNotNull(), F.struct("o_orderkey", line.alias("row"))))), lambda x: x["row"])
    text = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.array_join(rows, "").alias("rows"))
    head = F.when(k == 0, "<table><tr><td>logo</td></tr></table><table><tr><th>Category</th><th>Segment</th><th>Reports</th></tr>").otherwise("<table><tr><td>Category</td></tr>")
    mark = F.when(k == 2, "FS Manager").when(k == 3, "ISUCalcFS").otherwise("")
    docs = text.select(F.col("c_custkey").cast("string").alias("url"), F.when(k == 4, F.lit("<p>no index</p>")).otherwise(F.concat(head, "rows", F.lit("</table>"), mark)).alias("body"))
    return resolution.choose_parser(docs).select(F.col("url").cast("long").alias("c_custkey"), "parser_profile", "platform", "n_categories", "n_segments", "validation_status")


@query("""
SELECT name, n FROM (
  SELECT 'source_documents' AS name, count(DISTINCT c_nationkey) + count(DISTINCT CASE WHEN c_nationkey % 5 = 0 THEN c_nationkey END) AS n FROM customer
  UNION ALL SELECT 'source_skater_appearances', count(*) FROM customer
  UNION ALL SELECT 'parse_issues', count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 5 = 0
  UNION ALL SELECT 'parse_issues.warning', count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 5 = 0
) WHERE n > 0
""")
def load_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A run over pages of entries, one for each nation, some of which have a broken page beside them: what its record says."""
    c = table(spark, d, "customer")
    folder = F.concat(F.lit(f"{SITE}nation"), F.col("c_nationkey"), F.lit("/"))
    docs = _pages(c, F.concat(folder, F.lit("CAT001EN.HTM")), F.lit("Open"), ("No.", "Name", "Nat."), _row(F.col("c_custkey").cast("string"), F.col("c_name"), F.lit("AAA")), "c_custkey")
    broken = c.where("c_nationkey % 5 = 0").select(F.concat(folder, F.lit("CAT002EN.HTM")).alias("url"), F.lit('<table><tr><th>No.</th><th>Name</th></tr><tr><td><a href="http://[x">1</a></td></tr></table>').alias("body")).distinct()
    docs = written(docs.unionByName(broken).withColumn("link_text", F.lit(None).cast("string")), "run-pages")
    runs = docs.limit(1).select(F.lit(1).cast("long").alias("id"), F.lit(SITE).alias("root_url"), F.lit("started").alias("status"), F.create_map().cast("map<string,string>").alias("stats"), F.lit(None).cast("string").alias("error"))
    closed = registry.load_run(runs, 1, S.shared_path(spark, "runs"), docs)
    return closed.select(F.explode("stats").alias("name", "value")).where("name <> 'path' AND value <> '0'").select("name", F.col("value").cast("long").alias("n"))


def _summary_line() -> Column:
    """Rank, name, nation, start, total, elements, components and deduction of a line item, whose total is the sum of its parts."""
    total = F.format_string("%.2f", F.col("l_quantity") + F.col("l_linenumber"))
    return F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat(F.lit("Part P"), F.col("l_partkey")), F.lit("AAA"), F.col("l_suppkey").cast("string"), total, F.format_string("%.2f", F.col("l_quantity")), F.format_string("%.2f", F.col("l_linenumber").cast("double")), F.lit("0.00"))


@query("""
SELECT l_linenumber::INT AS rank, 'Part P' || l_partkey AS name, l_suppkey::INT AS starting_number, (l_quantity + l_linenumber)::DOUBLE AS total, count(*) AS n FROM lineitem GROUP BY ALL
""")
def sheet_summaries(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.concat_ws("\n", F.lit("OPEN"), F.collect_list(_summary_line()), F.lit("printed")).alias("text"))
    out = sheets.sheet_summaries(text)
    return out.groupBy("rank", "name", "starting_number", F.col("total_segment_score").cast("double").alias("total")).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber::INT AS element_no, count(*) AS n, round(sum(l_quantity), 2) AS base_total, sum(2)::BIGINT AS marks, count(*) FILTER (WHERE l_returnflag = 'R') AS marked FROM lineitem GROUP BY ALL
""")
def sheet_elements(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    code = F.concat(F.lit("3"), flag, F.lit("x"), F.col("l_linestatus"), F.when(flag == "R", "<<").otherwise(""))
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), code, F.format_string("%.2f", F.col("l_quantity")), F.lit("0.10 2 -"), F.format_string("%.2f", F.col("l_quantity") + 0.1))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber"), line.alias("line")).alias("x"))
    text = rows.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.concat_ws("\n", F.lit("1 Skater A AAA 1 2.00 1.00 1.00 0.00"), F.lit("# Executed Elements"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])).alias("text"))
    e = sheets.element_rows(sheets.sheet_sections(sheets.lines(text)))
    part = lambda i: F.regexp_extract("base_element_code", r"^3([A-Z])x([A-Z])\z", i)
    return e.groupBy(part(1).alias("flag"), part(2).alias("status"), "element_no").agg(F.count("*").alias("n"), F.round(F.sum(F.col("base_value").cast("double")), 2).alias("base_total"), F.sum(F.size("judge_scores")).alias("marks"), F.count_if(F.array_contains("markers", "<<")).alias("marked"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + l_linenumber)::DOUBLE AS tss, l_quantity::DOUBLE AS tes, l_linenumber::DOUBLE AS pcs, 0.0::DOUBLE AS deduction FROM lineitem
""")
def compact_split(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(two(q + n), two(q), F.lit(" "), two(n), F.lit("0.00")).alias("packed"))
    out = line.withColumn("s", sheets.split_scores(F.col("packed")))
    return out.where("s IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(f"s.{c}").cast("double").alias(c) for c in ("tss", "tes", "pcs", "deduction")])


#: The source layer in SQL: runs, appearances with their results, and score sheets.
_LAYER = """
WITH held AS (SELECT o.*, c_name, c_nationkey, c_mktsegment, year(o_orderdate)::INT AS y, c_nationkey * 10000 + year(o_orderdate)::INT AS ev FROM orders o JOIN customer ON o_custkey = c_custkey),
runs AS (SELECT DISTINCT ev * 10 + v AS id, 'http://scores.invalid/' || c_nationkey || '/' || y || '/index.htm' AS root_url, CASE WHEN v = 2 AND y % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, c_nationkey, y, ev FROM held, (VALUES (1), (2)) r(v)),
latest AS (SELECT * FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY root_url ORDER BY id DESC) = 1),
app AS (SELECT held.*, latest.id AS run, latest.root_url, 'Open ' || latest.ev AS event_name, CASE WHEN latest.c_nationkey % 3 > 0 THEN make_date(latest.y, 7, 1) END AS start_date, upper(c_name) AS skater_name, CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'x' ELSE repeat(chr(65 + held.c_nationkey), 3) END AS nation_code,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS club_name, o_orderpriority AS category_name FROM held JOIN latest USING (ev) WHERE o_custkey % 13 > 0),
lines AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity)::DECIMAL(10, 3) AS tes, sum(l_linenumber)::DECIMAL(10, 3) AS pcs FROM lineitem GROUP BY 1),
score AS (SELECT run * 10000000000 + o_orderkey * 10 + 3 AS score_id, 'pdf_score_summary' AS score_source, app.*, tes + pcs AS tss FROM app JOIN lines USING (o_orderkey) WHERE o_orderkey % 5 > 0
  UNION ALL SELECT o_orderkey * 10 + 2, 'html_segment_result', app.*, (o_totalprice / 1000)::DECIMAL(10, 3) FROM app WHERE NOT EXISTS (SELECT 1 FROM app a JOIN lines USING (o_orderkey) WHERE a.o_orderkey % 5 > 0 AND a.run = app.run AND a.category_name = app.category_name AND a.skater_name = app.skater_name))
"""


def layer(spark: SparkSession, d: str, once: bool = True) -> dict[str, DataFrame]:
    """The source tables that ``_LAYER`` describes. A blank name is a row without a skater, as pages have them.

    Orders with customer and sheet are written once, and so are their few groups, of which Spark then knows the size: the
    tables of runs and categories are sent to the tasks of the large ones. ``once`` is false for those who read neither.
    """
    keep = written if once else lambda df, _: df
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("decimal(10,3)").alias("tes"), F.sum("l_linenumber").cast("decimal(10,3)").alias("pcs"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("y")).join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = keep(o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("sheet", F.col("l_orderkey").isNotNull()).drop("c_custkey", "l_orderkey").withColumn("ev", (F.col("c_nationkey") * 10000 + F.col("y")).cast("long")), "held")
    k, cust, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    groups = keep(o.select("ev", "c_nationkey", "y", "o_orderpriority").distinct(), "groups")
    two = F.explode(F.array(F.lit(1), F.lit(2)))
    versions = groups.select("ev", "c_nationkey", "y").distinct().select("*", two.alias("v")).withColumn("id", F.col("ev") * 10 + F.col("v"))
    root = F.concat(F.lit(SITE), F.col("c_nationkey"), F.lit("/"), F.col("y"), F.lit("/index.htm"))
    versions = versions.withColumns({"root_url": root, "status": F.when((F.col("v") == 2) & (F.col("y") % 3 == 0), "failed").otherwise("completed")})
    # an event has both versions: its rows need no join
    rows = o.where("ev IS NOT NULL").select("*", two.alias("v")).withColumn("run", F.col("ev") * 10 + F.col("v"))
    name = F.when(cust % 13 == 0, "").otherwise(F.upper("c_name"))
    nation = F.when(cust % 6 == 0, "").when(cust % 11 == 0, "x").otherwise(F.expr("repeat(char(65 + c_nationkey), 3)"))
    club, skater = F.when(cust % 4 == 0, "").otherwise(F.col("c_mktsegment")), F.when(cust % 5 == 0, "").otherwise(cust.cast("string"))
    category = (F.col("run") * 10 + F.substring("o_orderpriority", 1, 1).cast("int")).alias("category_id")
    appearance = lambda i: (F.col("run") * 10_000_000_000 + k * 10 + i).alias("skater_appearance_id")
    scored = rows.where(F.col("sheet") & (k % 5 > 0))
    points = (F.col("o_totalprice") / 1000).cast("decimal(10,3)")
    sheet = F.col("run") * 10_000_000_000 + k * 10 + 3
    parts = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("element_no"), F.concat(F.lit("3"), F.col("l_returnflag"), F.when(F.col("l_returnflag") == "R", "<").otherwise("")).alias("element_code"), F.col("l_quantity").cast("decimal(10,3)").alias("base_value"))
    clubs = table(spark, d, "customer").select(F.col("c_mktsegment").alias("canonical_name")).distinct().select(club_id(F.col("canonical_name")).alias("club_id"), "canonical_name", F.lit("confirmed").alias("status"))

    def who(df: DataFrame, i: int, kind: str) -> DataFrame:
        segment = F.lit(None).cast("long") if i == 1 else (category * 10 + 1)
        return df.select(appearance(i).alias("id"), F.col("run").alias("import_run_id"), F.col("run").alias("event_id"), category, segment.alias("segment_id"), (F.col("run") * 10 + i % 2).alias("source_document_id"), F.lit(kind).alias("appearance_type"), F.col("c_name").alias("raw_name"), name.alias("normalized_name"), nation.alias("nation_code"), club.alias("club_name"), skater.alias("source_skater_id"))

    categories = groups.where("ev IS NOT NULL").select("*", two.alias("v")).withColumn("run", F.col("ev") * 10 + F.col("v")).select(category.alias("id"), F.col("run").alias("event_id"), F.col("o_orderpriority").alias("name"))
    t = {
        "source_profiles": table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("profile_key"), F.lit("nation").alias("representation_primary")),
        "import_runs": versions.select("id", "root_url", "status", (n % 5).cast("long").alias("source_profile_id")),
        "events": versions.select("id", F.col("id").alias("import_run_id"), F.col("root_url").alias("source_url"), F.concat(F.lit("Open "), F.col("ev")).alias("name"), F.when(n % 3 > 0, F.concat(F.lit("1.7."), F.col("y"), F.lit(" - 3.7."), F.col("y"))).alias("date_range")),
        "categories": categories,
        "segments": categories.select((F.col("id") * 10 + 1).alias("id"), F.col("id").alias("category_id"), F.lit("Free Skating").alias("name"), F.lit(1).alias("source_order")).unionByName(categories.select((F.col("id") * 10 + 2).alias("id"), F.col("id").alias("category_id"), F.lit("Gala").alias("name"), F.lit(2).alias("source_order"))),
        "source_documents": versions.select((F.col("id") * 10 + 1).alias("id"), F.col("id").alias("import_run_id"), F.col("root_url").alias("url"), F.lit("html").alias("document_type")).unionByName(versions.select((F.col("id") * 10).alias("id"), F.col("id").alias("import_run_id"), F.replace("root_url", F.lit("index.htm"), F.lit("scores.pdf")).alias("url"), F.lit("judges_scores_pdf").alias("document_type"))),
        "source_skater_appearances": who(rows, 1, "category_result").unionByName(who(rows, 2, "segment_result")).unionByName(who(scored, 3, "pdf_score")),
        "category_results": rows.select((F.col("run") * 10_000_000_000 + k).alias("id"), category, appearance(1), (k % 30 + 1).cast("int").alias("final_place"), points.alias("points")),
        "segment_results": rows.select((k * 10 + 2).alias("id"), (category * 10 + 1).alias("segment_id"), appearance(2), points.alias("tss")),
        "pdf_elements": scored.select("run", "o_orderkey").join(parts, k == F.col("l_orderkey")).select(sheet.alias("pdf_score_summary_id"), sheet.alias("id"), "element_no", "element_code", F.array_compact(F.array(F.when(F.col("element_code").endswith("<"), "<"))).alias("markers"), "base_value"),
        "clubs": clubs,
        "club_aliases": seeded_aliases(clubs.select("canonical_name", F.lower("canonical_name").alias("alias_name"), F.lit("high").alias("confidence")), clubs),
        "pdf_score_summaries": scored.select(sheet.alias("id"), (category * 10 + 1).alias("segment_id"), appearance(3), (F.col("tes") + F.col("pcs")).alias("total_segment_score"), F.col("tes").alias("total_element_score"), F.col("pcs").alias("total_program_component_score")),
    }
    return S.empty_layer(spark) | {name: registry.shaped(df, name) for name, df in t.items()}


@query(_LAYER + "SELECT id AS event_id, root_url, 'Open ' || ev AS event_name, CASE WHEN c_nationkey % 3 > 0 THEN y || '-07-01' END AS start_day FROM latest")
def view_events(spark: SparkSession, d: str) -> DataFrame:
    return V.v_events(layer(spark, d)).select("event_id", "root_url", "event_name", day("event_start_date").alias("start_day"))


@query(_LAYER + "SELECT run * 10000000000 + o_orderkey * 10 + 1 AS skater_appearance_id, skater_name, nation_code, club_name, coalesce(club_name, nation_code) AS display_affiliation, category_name, (o_orderkey % 30 + 1)::INT AS final_place, (o_totalprice / 1000)::DECIMAL(10, 3)::DOUBLE AS points FROM app")
def view_category_results(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_skater_category_results(layer(spark, d))
    return out.select("skater_appearance_id", "skater_name", "nation_code", "club_name", "display_affiliation", "category_name", "final_place", F.col("points").cast("double").alias("points"))


@query(_LAYER + "SELECT score_id, score_source, skater_name, category_name, 'Free Skating' AS segment_name, tss::DOUBLE AS tss FROM score")
def view_segment_scores(spark: SparkSession, d: str) -> DataFrame:
    return V.v_skater_segment_scores(layer(spark, d)).select("score_id", "score_source", "skater_name", "category_name", "segment_name", F.col("tss").cast("double").alias("tss"))


@query(_LAYER + """
SELECT score_id, lag(tss) OVER w::DOUBLE AS previous_tss, (tss - lag(tss) OVER w)::DOUBLE AS tss_delta FROM score
WINDOW w AS (PARTITION BY skater_name, nation_code, club_name ORDER BY start_date NULLS LAST, event_name NULLS LAST, category_name NULLS LAST, score_id)
""")
def view_progression(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_skater_progression(layer(spark, d))
    return out.select("score_id", F.col("previous_tss_same_segment").cast("double").alias("previous_tss"), F.col("tss_delta_same_segment").cast("double").alias("tss_delta"))


@query(_LAYER + "SELECT coalesce(club_name, '(empty club)') AS club_name, skater_name, nation_code, count(DISTINCT run) AS competitions, count(DISTINCT category_name) AS categories_seen, max(tss)::DOUBLE AS best_tss, strftime(min(start_date), '%Y-%m-%d') AS first_day FROM score GROUP BY 1, 2, 3")
def view_club_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.v_club_skater_summary(layer(spark, d)).select("club_name", "skater_name", "nation_code", "competitions", "categories_seen", F.col("best_tss").cast("double").alias("best_tss"), day("first_event_date").alias("first_day"))


_SKATERS = _LAYER + ", dim AS (SELECT row_number() OVER (ORDER BY skater_name, nation_code NULLS LAST, club_name NULLS LAST) AS skater_key, * FROM (SELECT DISTINCT skater_name, nation_code, club_name FROM app))"


@query(_SKATERS + " SELECT score_id AS segment_score_key, run AS event_key, skater_key, tss::DOUBLE AS tss FROM score LEFT JOIN dim ON score.skater_name = dim.skater_name AND score.nation_code IS NOT DISTINCT FROM dim.nation_code AND score.club_name IS NOT DISTINCT FROM dim.club_name")
def mart_segment_scores(spark: SparkSession, d: str) -> DataFrame:
    return mart.fact_segment_score(layer(spark, d)).select("segment_score_key", "event_key", "skater_key", F.col("tss").cast("double").alias("tss"))


@query(_SKATERS + " SELECT skater_key, max(tss)::DOUBLE AS best_tss, count(DISTINCT run) AS competitions FROM score LEFT JOIN dim ON score.skater_name = dim.skater_name AND score.nation_code IS NOT DISTINCT FROM dim.nation_code AND score.club_name IS NOT DISTINCT FROM dim.club_name GROUP BY 1")
def mart_personal_bests(spark: SparkSession, d: str) -> DataFrame:
    return mart.v_skater_personal_bests(layer(spark, d)).select("skater_key", F.col("best_tss").cast("double").alias("best_tss"), "competitions")


@query(_LAYER + """
, e AS (SELECT run, 1 AS kind FROM app UNION ALL SELECT run, 2 FROM app UNION ALL SELECT run, 3 FROM app JOIN lines USING (o_orderkey) WHERE o_orderkey % 5 > 0)
SELECT CASE WHEN kind % 2 = 1 THEN 'html' ELSE 'judges_scores_pdf' END AS document_type, run AS import_run_id, count(*) AS n FROM e GROUP BY 1, 2
""")
def mart_source_evidence(spark: SparkSession, d: str) -> DataFrame:
    return mart.v_skater_source_evidence(layer(spark, d)).groupBy("document_type", "import_run_id").agg(F.count("*").alias("n"))


@query(_LAYER + "SELECT root_url, count(*) AS completed_runs, array_to_string(list(id ORDER BY id DESC), ',') AS run_ids FROM runs WHERE status = 'completed' GROUP BY 1 HAVING count(*) > 1")
def report_duplicate_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_runs(layer(spark, d)).withColumn("run_ids", F.array_join(F.col("run_ids").cast("array<string>"), ","))


@query(_LAYER + """
, seg AS (SELECT DISTINCT latest.id AS import_run_id, latest.root_url, o_orderpriority AS category_name, s.name AS segment_name FROM held JOIN latest USING (ev), (VALUES ('Free Skating'), ('Gala')) s(name)),
done AS (SELECT DISTINCT latest.id AS import_run_id, o_orderpriority AS category_name FROM held JOIN latest USING (ev) JOIN lines USING (o_orderkey) WHERE o_orderkey % 5 > 0)
SELECT import_run_id, root_url, category_name, segment_name, 0::BIGINT AS entry_count, 'empty_category' AS classification FROM seg WHERE segment_name = 'Gala' OR NOT EXISTS (SELECT 1 FROM done WHERE done.import_run_id = seg.import_run_id AND done.category_name = seg.category_name)
""")
def report_missing_results(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_results(layer(spark, d)).select("import_run_id", "root_url", "category_name", "segment_name", "entry_count", "classification")


@query(_LAYER + "SELECT 0::BIGINT AS likely_club_suffix_names, count(*) FILTER (WHERE nation_code = 'x') AS non_iso_nation_codes, 0::BIGINT AS iso_code_as_club_no_nation FROM score")
def report_residue(spark: SparkSession, d: str) -> DataFrame:
    return quality.residue(layer(spark, d))


@query(_LAYER + """
, a AS (SELECT nation_code, club_name, c_nationkey % 5 AS r, root_url, 1 AS n FROM app UNION ALL SELECT nation_code, club_name, c_nationkey % 5, root_url, 1 FROM app UNION ALL SELECT nation_code, club_name, c_nationkey % 5, root_url, 1 FROM app JOIN lines USING (o_orderkey) WHERE o_orderkey % 5 > 0)
SELECT r_name AS profile_key, root_url, count(*) AS appearances, count(nation_code) AS with_country, count(club_name) AS with_club, count(*) FILTER (WHERE nation_code = 'x') AS non_iso_country_values FROM a JOIN region ON r = r_regionkey GROUP BY 1, 2
""")
def report_affiliations(spark: SparkSession, d: str) -> DataFrame:
    return quality.affiliation_summary(layer(spark, d)).select("profile_key", "root_url", "appearances", "with_country", "with_club", "non_iso_country_values")


@query("""
SELECT 'http://scores.invalid/' || lpad(c_custkey::VARCHAR, 9, '0') AS url, CASE WHEN c_custkey % 2 = 0 THEN 'fs_manager' ELSE 'old_isucalcfs' END AS parser_profile FROM customer
WHERE c_nationkey % 3 > 0 AND c_custkey % 7 > 0 AND c_mktsegment LIKE '%MA%' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
ORDER BY c_custkey % 2, url LIMIT 200
""")
def ready_worklist(spark: SparkSession, d: str, limit: int = 200) -> DataFrame:
    url = lambda c: F.concat(F.lit(SITE), F.lpad(F.col(c).cast("string"), 9, "0"))
    sources = table(spark, d, "customer").select(
        url("c_custkey").alias("url"), F.create_map(F.lit("source"), F.concat(F.lit("listing/"), F.col("c_mktsegment"))).alias("summary"), F.when(F.col("c_nationkey") % 3 > 0, "ready_for_import").otherwise("analyzed").alias("status"),
        F.when(F.col("c_custkey") % 7 > 0, "passed").otherwise("failed").alias("validation_status"), F.when(F.col("c_custkey") % 2 == 0, "fs_manager").otherwise("old_isucalcfs").alias("parser_profile"),
    )
    runs = table(spark, d, "orders").select(url("o_custkey").alias("root_url"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("started").alias("status"))
    return registry.ready_worklist(sources, runs, family="MA", limit=limit).select("url", "parser_profile")


@query("""
WITH e AS (SELECT user_id, event_type, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN event_type = 'click' AND clicks > 0 THEN CASE WHEN user_id % 4 = 0 THEN 'analyzed' ELSE 'ready_for_import' END WHEN event_type IN ('click', 'error', 'view') THEN 'skipped' ELSE 'analyzed' END AS status,
  CASE WHEN event_type = 'click' AND clicks > 0 THEN 'passed' WHEN event_type IN ('click', 'error', 'view') THEN 'failed' ELSE 'warning' END AS validation_status FROM e
""")
def source_status(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_type") == "click").alias("n_categories"))
    kind = F.when(F.col("event_type").isin("click", "view"), "html").when(F.col("event_type") == "error", "unknown_html").otherwise("pdf")
    return registry.decide_status(found.withColumns({"content_kind": kind, "imported": F.col("user_id") % 4 == 0})).select("user_id", "event_type", "status", "validation_status")


@query("""
WITH o AS (SELECT c.c_custkey, c_nationkey % 3 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'http://old/' || c_custkey END AS had, CASE WHEN c_nationkey % 3 = 1 THEN 'http://new/' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END AS got FROM customer c)
SELECT c_custkey, coalesce(got, had) AS result_url, CASE WHEN k = 0 THEN 'manual_review' WHEN coalesce(got, had) IS NULL THEN 'catalog_only_needs_result_url' ELSE 'candidate_result_url' END AS discovery_status, k = 0 AS missing FROM o
""")
def catalog_results(spark: SparkSession, d: str) -> DataFrame:
    """An event for each customer: its page is missing, names result pages (one for each order, the first one counts) or has none."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_nationkey") % 3)
    page = F.concat(F.lit("http://detail/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    blank = F.lit(None).cast("string")
    catalog = c.select(F.col("c_custkey").cast("string").alias("event_name"), page.alias("detail_url"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://old/"), "c_custkey")).alias("result_url"), F.lit("new").alias("discovery_status"), F.create_map().cast("map<string,string>").alias("metadata"))
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    named = c.where("k = 1").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    first = F.array_sort("orders")
    several = F.when(F.col("orders").isNull(), F.array(blank)).otherwise(F.array(F.concat(F.lit("http://new/"), F.get(first, F.lit(0))), blank))
    details = named.select(page.alias("detail_url"), F.explode(several).alias("result_url")).unionByName(c.where("k = 2").select(page.alias("detail_url"), blank.alias("result_url")))
    out = registry.resolve_catalog(catalog, details, refresh=True)
    return out.select(F.col("event_name").cast("long").alias("c_custkey"), "result_url", "discovery_status", F.map_contains_key("metadata", "resolve_error").alias("missing"))


@query("""
SELECT page_id AS source_document_id, CASE WHEN lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf' THEN 'judges_scores_pdf' ELSE 'html' END AS document_type, CASE WHEN page_id % 7 = 0 THEN NULL ELSE sha256(html) END AS archive_sha256,
  CASE WHEN page_id % 7 = 0 THEN 'skipped' ELSE 'written' END AS archive_status, CASE WHEN page_id % 7 = 0 THEN 'no text' END AS archive_reason FROM pages
""")
def archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit(1).cast("long").alias("import_run_id"), "url", F.when(F.col("page_id") % 7 > 0, F.col("html")).alias("body"))
    runs = table(spark, d, "region").where("r_regionkey = 0").select(F.lit(1).cast("long").alias("id"), F.lit(SITE).alias("root_url"), F.lit("completed").alias("status"))
    return registry.archive_manifest(docs, runs).select("source_document_id", "document_type", "archive_sha256", "archive_status", "archive_reason")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Elit' || c_nationkey ELSE repeat(chr(65 + c_nationkey), 3) END AS nation, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS club, CASE WHEN c_custkey % 5 < 2 THEN 'nation' ELSE 'club' END AS prim, CASE WHEN c_custkey % 5 = 4 THEN 'club' ELSE 'country' END AS col FROM customer),
m AS (SELECT *, prim = 'club' AND nation LIKE 'Elit%' AND club = '' AND col = 'club' AS moved FROM r)
SELECT c_custkey, CASE WHEN moved OR (prim = 'club' AND nation LIKE 'Elit%') THEN NULL ELSE nation END AS nation_code, CASE WHEN moved THEN nation ELSE club END AS club_name, prim AS representation_type,
  nullif(CASE WHEN moved THEN nation WHEN prim = 'club' THEN club ELSE nation END, '') AS representation_value FROM m
""")
def representation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 3 == 0, F.concat(F.lit("Elit"), F.col("c_nationkey"))).otherwise(F.expr("repeat(char(65 + c_nationkey), 3)")).alias("nation_code"), F.when(k % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("club_name"),
        F.when(k % 5 < 2, "nation").otherwise("club").alias("representation_primary"), F.when(k % 5 == 4, "club").otherwise("country").alias("nation_column"),
    )
    return registry.normalize_representation(rows).select("c_custkey", "nation_code", "club_name", "representation_type", "representation_value")


@query(_LAYER + """
SELECT skater_name, category_name, l_linenumber::INT AS element_no, '3' || l_returnflag || CASE WHEN l_returnflag = 'R' THEN '<' ELSE '' END AS element_code, count(*) AS n, sum(l_quantity)::DOUBLE AS base_total, count(*) FILTER (WHERE l_returnflag = 'R') AS marked
FROM app JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 > 0 GROUP BY ALL
""")
def view_elements(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_skater_elements(layer(spark, d)).groupBy("skater_name", "category_name", "element_no", "element_code")
    return out.agg(F.count("*").alias("n"), F.sum(F.col("base_value").cast("double")).alias("base_total"), F.count_if(F.array_contains("markers", "<")).alias("marked"))


@query(_LAYER + """
, used AS (SELECT c_mktsegment AS club, held.ev, v FROM held JOIN runs USING (ev), LATERAL (SELECT runs.id AS v) x WHERE o_custkey % 4 > 0)
SELECT club AS canonical_name, lower(club) AS alias_name, (count(*) + (SELECT count(*) FROM held h2 JOIN runs r2 USING (ev) WHERE h2.c_mktsegment = used.club AND h2.o_custkey % 4 > 0) + (SELECT count(*) FROM held h3 JOIN runs r3 USING (ev) JOIN lines USING (o_orderkey) WHERE h3.c_mktsegment = used.club AND h3.o_custkey % 4 > 0 AND o_orderkey % 5 > 0))::BIGINT AS uses, count(DISTINCT v) AS event_count FROM used GROUP BY club
""")
def view_alias_usage(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_club_alias_usage(layer(spark, d))
    return out.select("canonical_name", "alias_name", F.col("imported_appearance_count").alias("uses"), "event_count")


@query(_LAYER + "SELECT club_name, lower(club_name) IS NOT NULL AS mapped, count(*) AS n FROM app GROUP BY 1, 2")
def view_results_with_club(spark: SparkSession, d: str) -> DataFrame:
    out = V.v_skater_category_results_with_club(layer(spark, d))
    return out.groupBy("club_name", F.col("canonical_club_id").isNotNull().alias("mapped")).agg(F.count("*").alias("n"))


@query(_LAYER + """
SELECT 'dim_category' AS label, count(DISTINCT (run, category_name)) AS rows FROM app UNION ALL SELECT 'dim_country', count(DISTINCT nation_code) FROM app UNION ALL SELECT 'dim_date', count(DISTINCT start_date) FROM latest l JOIN app ON app.run = l.id
UNION ALL SELECT 'dim_event', count(*) FROM latest UNION ALL SELECT 'dim_skater', count(*) FROM (SELECT DISTINCT skater_name, nation_code, club_name FROM app) UNION ALL SELECT 'dim_source_document', 2 * count(*) FROM runs
""")
def mart_dimensions(spark: SparkSession, d: str) -> DataFrame:
    t = layer(spark, d)
    return labelled_counts(**{n: mart.VIEWS[n](t) for n in ("dim_category", "dim_country", "dim_date", "dim_event", "dim_skater", "dim_source_document")})


@query(_LAYER + "SELECT run * 10000000000 + o_orderkey * 10 + 1 AS competition_result_key, run AS event_key, strftime(start_date, '%Y-%m-%d') AS date_key, (o_totalprice / 1000)::DECIMAL(10, 3)::DOUBLE AS points FROM app")
def mart_competition_results(spark: SparkSession, d: str) -> DataFrame:
    out = mart.fact_competition_result(layer(spark, d)).where("skater_key IS NOT NULL")
    return out.select("competition_result_key", "event_key", day("date_key").alias("date_key"), F.col("points").cast("double").alias("points"))


@query(_LAYER + "SELECT nation_code, count(DISTINCT skater_name) AS skaters, count(DISTINCT run) AS events FROM app WHERE nation_code = 'x' GROUP BY 1")
def report_nonconforming_nations(spark: SparkSession, d: str) -> DataFrame:
    return quality.nonconforming_nation_summary(layer(spark, d)).select("nation_code", "skaters", "events")


@query(_LAYER + "SELECT id AS import_run_id, root_url FROM latest")
def report_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.latest_runs(layer(spark, d))


@query("""
SELECT 'import_runs' AS label, 2 * count(*) AS rows FROM (SELECT DISTINCT c_nationkey, year(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 'categories', 2 * count(*) FROM (SELECT DISTINCT c_nationkey, year(o_orderdate), o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey) UNION ALL SELECT 'source_profiles', count(*) FROM region
""")
def source_layer(spark: SparkSession, d: str) -> DataFrame:
    names, root, t = ["import_runs", "categories", "source_profiles"], S.shared_path(spark, "layer"), layer(spark, d)
    S.write_layer({n: t[n] for n in names}, root)
    return labelled_counts(**S.load_layer(spark, root, names, views=False))


@query("SELECT page_id AS source_document_id, sha256(html) AS archive_sha256, 'written' AS archive_status, 'http://scores.invalid/' AS root_url FROM pages")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit(1).cast("long").alias("import_run_id"), "url", F.col("html").alias("body"))
    runs = table(spark, d, "region").where("r_regionkey = 0").select(F.lit(1).cast("long").alias("id"), F.lit(SITE).alias("root_url"), F.lit("completed").alias("status"))
    root = S.shared_path(spark, "manifest")
    S.write_manifest(registry.archive_manifest(docs, runs), root)
    loaded = registry.load_manifest(S.empty_layer(spark)["source_archive_files"], S.read_manifest_csv(spark, f"{root}/csv"))
    return loaded.select("source_document_id", "archive_sha256", "archive_status", "root_url")


@query("SELECT DISTINCT url FROM pages WHERE url NOT LIKE '#%' AND trim(url) <> ''")
def source_url_list(spark: SparkSession, d: str) -> DataFrame:
    root = S.shared_path(spark, "urls")
    table(spark, d, "pages").select(F.explode(F.array("url", F.lit(""), F.lit("# comment"))).alias("value")).write.text(root)
    return S.read_url_list(spark, root).distinct()


@query("""SELECT '{"orders":[{"n":' || (SELECT count(*) FROM orders) || '}],"customers":[{"n":' || (SELECT count(*) FROM customer) || '}]}' AS report""")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    return S.json_report(**{n: table(spark, d, t).agg(F.count("*").alias("n")) for n, t in (("orders", "orders"), ("customers", "customer"))})


@query("""
SELECT s_name AS event_name, CASE WHEN s_nationkey % 2 = 0 THEN 'registered' ELSE 'found' END AS discovery_status, CASE WHEN s_suppkey % 3 = 0 THEN 'isu_official_catalog' ELSE 'known' END AS kind, 'http://scores.invalid/' || s_suppkey AS result_url FROM supplier
""")
def catalog_load(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    event = [F.lit("list").alias("source_name"), F.col("s_name").alias("event_name")]
    base = registry.shaped(s.where("s_nationkey % 2 = 0").select(*event, F.lit("").alias("city"), F.lit("registered").alias("discovery_status")), "event_discovery_catalog")
    rows = s.select(*event, F.lit("found").alias("discovery_status"), F.when(F.col("s_suppkey") % 3 > 0, "known").alias("kind"), F.concat(F.lit(SITE), F.col("s_suppkey")).alias("result_url"))
    out = registry.load_catalog(base, registry.shaped(rows, "event_discovery_catalog"))
    root = S.shared_path(spark, "catalog")
    S.write_catalog(out, root)
    return spark.read.schema("event_name string, discovery_status string, kind string, result_url string").json(f"{root}/json")


@query(r"""
WITH u AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/') AS p FROM pages),
v AS (SELECT *, CASE WHEN regexp_matches(p, '(?i)/index\.html?$') THEN regexp_replace(p, '(?i)/index\.html?$', '') WHEN lower(p) LIKE '%.pdf' THEN regexp_replace(p, '/[^/]*$', '') ELSE p END AS prefix FROM u)
SELECT page_id, prefix, 'bsf_discovered_' || substr(trim(regexp_replace(lower(prefix), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) || '_' || substr(sha1(prefix), 1, 8) AS profile_key,
  CASE page_id % 4 WHEN 0 THEN 'ISU' WHEN 1 THEN 'DP' ELSE 'club' END AS stream, CASE WHEN page_id % 4 = 0 THEN 'nation' ELSE 'club' END AS representation, CASE WHEN page_id % 3 = 0 OR contains(url, '/2013/') THEN 'old_isucalcfs' ELSE 'fs_manager' END AS parser FROM v
""")
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("result_ISU", "result_DP", "other", "other")]), (F.col("page_id") % 4 + 1).cast("int"))
    profile = F.when(F.col("page_id") % 3 == 0, "old_isucalcfs")
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.path_prefix(u).alias("prefix"), T.profile_key(u).alias("profile_key"), T.stream_of(kind, u).alias("stream"), T.representation_of(kind).alias("representation"), T.parser_of(profile, u).alias("parser"))


_LABELS = ("SHORT PROGRAM", "PATTERN DANCE 2 (WITHOUT KEY POINTS)", "PATTERN DANCE", "GALA")


@query("SELECT s_suppkey, 'OPEN ' || s_nationkey AS before, upper(s_name) || CASE WHEN s_suppkey % 4 = 3 THEN ' GALA' ELSE '' END AS category, CASE s_suppkey % 4 WHEN 0 THEN 'SHORT PROGRAM' WHEN 1 THEN 'PATTERN DANCE 2 (WITHOUT KEY POINTS)' WHEN 2 THEN 'PATTERN DANCE' ELSE '' END AS segment FROM supplier")
def sheet_titles(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("OPEN "), F.col("s_nationkey"), F.lit("\nJUDGES DETAILS PER SKATER "), F.upper("s_name"), F.lit(" "), label, F.lit("\nprinted: now"))
    out = sheets.sheet_titles(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), text.alias("text")))
    title = T.split_sheet_title(F.col("after"))
    return out.select(F.col("doc_id").cast("long").alias("s_suppkey"), "before", title["category"].alias("category"), title["segment"].alias("segment"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN day(o_orderdate) || ' ' || month(o_orderdate) || '.' || year(o_orderdate) || ' – 31.12.' || year(o_orderdate) WHEN 1 THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ' - 31.12.' || year(o_orderdate)
  ELSE year(o_orderdate)::VARCHAR END AS text FROM orders
""")
def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    """A dot that stands alone and an en dash; words that close a date; dots at the end."""
    year, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 3
    apart = F.concat(F.date_format("o_orderdate", "d . M.yyyy"), F.lit("\u00a0 \ufffd–  31.12."), year, F.lit(" "))
    worded = F.concat(F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" г. - 31.12."), year, F.lit(" year"))
    raw = F.when(k == 0, apart).when(k == 1, worded).otherwise(F.concat(year, F.lit(" ..")))
    return table(spark, d, "orders").select("o_orderkey", T.clean_date(raw).alias("text"))


@query("""
SELECT DISTINCT p_brand AS category, p_type AS segment, 'segment' AS kind, 'SEG-' || p_type || '.htm' AS details FROM part UNION ALL SELECT DISTINCT p_brand, NULL, 'category', NULL FROM part
""")
def page_index(spark: SparkSession, d: str) -> DataFrame:
    a = lambda href, text: F.concat(F.lit('<a href="'), href, F.lit(f'">{text}</a>'))
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    segment = _row(F.lit(""), F.col("p_type"), a(F.concat(F.lit("SEG-"), F.col("p_type"), F.lit(".htm")), "Result Details"))
    rows = p.groupBy("p_brand").agg(F.array_join(F.collect_list(segment), "").alias("segments"))
    body = F.concat(F.lit("<title>Open</title><table><tr><th>Category</th><th>Segment</th><th></th></tr>"), _row(F.col("p_brand"), F.lit(""), a(F.lit("CAT001RS.htm"), "Result")), F.col("segments"), F.lit("</table>"))
    docs = rows.select(F.concat(F.lit(f"{SITE}i/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/index.htm")).alias("url"), body.alias("body"))
    return pages.index_rows(pages.cells(docs)).select("category", "segment", "kind", F.col("details.href").alias("details"))


@query("SELECT s_name || ' & Co' AS event_name, 'https://r.invalid/' || s_suppkey AS result_url, 'candidate_result_url' AS discovery_status FROM supplier")
def catalog_details(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('<script>x("{\\"pageinfos\\":{\\"name\\":\\"'), F.col("s_name"), F.lit(' &amp; Co\\",\\"detail_result_url\\":\\"https:\\/\\/r.invalid\\/'), F.col("s_suppkey"), F.lit('\\"}}")</script>'))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("url"), payload.alias("body"))
    return pages.detail_rows(docs).select("event_name", "result_url", "discovery_status")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity)::DECIMAL(10, 3) AS e, sum(l_linenumber)::DECIMAL(10, 3) AS c, count(*) % 2 AS off FROM lineitem GROUP BY 1)
SELECT l_orderkey, (e + c + off)::DOUBLE AS total FROM s WHERE off = 1 AND NOT abs((e + c + off) - (e + c) / 2) <= 0.02
""")
def report_score_mismatches(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("decimal(10,3)").alias("total_element_score"), F.sum("l_linenumber").cast("decimal(10,3)").alias("total_program_component_score"), (F.count("*") % 2).cast("decimal(10,3)").alias("off"))
    s = s.withColumn("total_segment_score", F.col("total_element_score") + F.col("total_program_component_score") + F.col("off")).withColumn("total_deductions", F.lit(None).cast("decimal(10,3)"))
    return quality.score_mismatches(s).select("l_orderkey", F.col("total_segment_score").cast("double").alias("total"))


@query("""
SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT LIKE '%.com' THEN NULL WHEN starts_with(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), 'en') THEN 'english' ELSE 'all' END AS profile_key FROM pages
""")
def attached_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    hosts = p.select(T.url_host(F.col("url")).alias("host")).where("host LIKE '%.com'").distinct()
    profiles = hosts.select("host", F.explode(F.array(F.struct(F.lit("").alias("path_prefix"), F.lit("all").alias("profile_key")), F.struct(F.lit("/en").alias("path_prefix"), F.lit("english").alias("profile_key")))).alias("p")).select("host", "p.*")
    return registry.attach_profiles(p, profiles).select("page_id", "profile_key")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Elit' ELSE 'AAA' END AS nation, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS club FROM customer)
SELECT c_custkey, CASE WHEN nation = 'Elit' THEN NULL ELSE nation END AS nation_code, CASE WHEN nation = 'Elit' AND club = '' THEN 'Elit' ELSE club END AS club_name, CASE WHEN nation = 'Elit' OR club <> '' THEN 'club' ELSE 'nation' END AS representation_type,
  CASE WHEN nation = 'Elit' AND club = '' THEN 'Elit' WHEN club <> '' THEN club ELSE 'AAA' END AS representation_value FROM r WHERE NOT (nation = 'Elit' AND club <> '')
UNION ALL SELECT c_custkey, 'Elit', club, 'club', club FROM r WHERE nation = 'Elit' AND club <> ''
""")
def corrected_appearances(spark: SparkSession, d: str) -> DataFrame:
    """The rules over appearances of club-primary sources in the older layout, whose nation column holds clubs."""
    k, none = F.col("c_custkey"), F.create_map().cast("map<string,string>")
    nation, club = F.when(k % 3 == 0, "Elit").otherwise("AAA"), F.when(k % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", nation.alias("nation_code"), club.alias("club_name"), F.lit("nation").alias("representation_type"), nation.alias("representation_value"), F.lit("old_isucalcfs").alias("parser_profile"), F.lit("club").alias("representation_primary"), F.lit("club").alias("nation_column"), none.alias("raw"))
    return registry.correct_appearances(rows).select("c_custkey", "nation_code", "club_name", "representation_type", "representation_value")


@query("""
WITH e AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 1000000000 ELSE 0 END AS run, o_orderdate::DATE::VARCHAR AS url FROM orders)
SELECT 'import_runs' AS "table", 'domain of status' AS rule, 'odd' AS value, count(*) AS rows FROM customer WHERE c_custkey % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'events', 'unique import_run_id, source_url', run || '|' || url, count(*) FROM e GROUP BY run, url HAVING count(*) > 1
UNION ALL SELECT 'events', 'import_run_id in import_runs', run::VARCHAR, count(*) FROM e WHERE run NOT IN (SELECT c_custkey FROM customer) GROUP BY run
UNION ALL SELECT 'categories', 'unique event_id, name', l_orderkey || '|' || l_returnflag, count(*) FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) > 1
UNION ALL SELECT 'categories', 'event_id in events', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM e) GROUP BY l_orderkey
""")
def report_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, some in no known state; their orders as events, some of unknown runs; line items as categories."""
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 50 == 0, "odd").otherwise("completed").alias("status"))
    run = F.col("o_custkey") + F.when(F.col("o_orderkey") % 100 == 0, 1_000_000_000).otherwise(0)
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), run.alias("import_run_id"), F.col("o_orderdate").cast("date").cast("string").alias("source_url"))
    categories = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("id"))
    return quality.constraint_violations({"import_runs": runs, "events": events, "categories": categories}, references=True)


@query("SELECT o_orderkey, o_orderstatus, lag(o_totalprice) OVER w AS previous_o_totalprice, o_totalprice - lag(o_totalprice) OVER w AS o_totalprice_delta FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)")
def hot_progression(spark: SparkSession, d: str) -> DataFrame:
    """Each order beside the one before it of the same state: few states, so that each holds a good part of all rows."""
    out = ranged_progression(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderdate"], ["o_totalprice"], "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", "previous_o_totalprice", "o_totalprice_delta")


@query("""
WITH u AS (SELECT l_orderkey AS id, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < DATE '1995-01-01' GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN u.id IS NULL OR o_orderstatus = 'F' THEN o_orderstatus ELSE 'R' END AS status, coalesce(u.price, o_totalprice) AS price FROM orders LEFT JOIN u ON u.id = o_orderkey
""")
def upsert_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Orders stored by buckets of their keys, changed in place by their returned lines; the buckets without any stay as they are."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    path = S.shared_path(spark, "orders-by-bucket")
    write_buckets(base, path, ["id"], 16)
    updates = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_shipdate < DATE'1995-01-01'").groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("R").alias("status"), F.max("l_extendedprice").alias("price"))
    schema = ", ".join(f"{c} {kind}" for c, kind in base.dtypes)
    upsert_buckets(path, schema, updates, ["id"], {"status": guard("F")}, 16)
    return spark.read.schema(schema).parquet(path).select("id", "status", "price")
