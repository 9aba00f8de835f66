"""Queries over the reports that reviewers read, the registry's changes and the dimensions of a stored mart.

The tables are those of ``judged.judged_layer`` with what reports look for: profiles of both parsers, pieces of file names
as clubs, results without place or points, points among the segments, texts of documents, archived files, a catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resultmart.functions.text import has_headers
from resultmart.operators import aggregate, joins, maintenance
from resultmart.plans import mart, pages, quality, registry
from resultmart.plans.derived import SITE, _pages, _row
from resultmart.plans.judged import _JUDGED, judged_layer
from resultmart.plans.queries import day, query, table
from resultmart.sources import tables as S

_HELD = 10_000_000_000

#: Appearances of the latest runs in the layer below, and the documents of these runs.
_REVIEWED = _JUDGED + """
, kinds AS (SELECT * FROM (VALUES (1, 'category_result'), (2, 'segment_result'), (3, 'pdf_score')) k(i, appearance_type)),
row_ AS (SELECT every.run, every.root_url, every.o_orderkey AS k, every.run * 10000000000 + every.o_orderkey * 10 + i AS id, i, appearance_type, 'Open ' || ev AS event_name, CASE WHEN c_nationkey % 3 > 0 THEN make_date(y, 7, 1) END AS start_date, upper(c_name) AS skater_name, o_orderpriority AS category_name,
  CASE WHEN o_custkey % 6 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'x' ELSE repeat(chr(65 + c_nationkey), 3) END AS nation_code, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN every.o_orderkey % 7 = 0 THEN lower(substr(c_mktsegment, 1, 3)) ELSE c_mktsegment END AS club_name, c_mktsegment, o_totalprice,
  CASE WHEN every.o_orderkey % 12 > 0 THEN (every.o_orderkey % 30 + 1)::INT END AS final_place, r_name AS profile_key, r_regionkey % 2 = 0 AS newer
  FROM every CROSS JOIN kinds JOIN region ON r_regionkey = c_nationkey % 5 LEFT JOIN lines ON lines.o_orderkey = every.o_orderkey WHERE (i < 3 OR (lines.o_orderkey IS NOT NULL AND every.o_orderkey % 5 > 0)) AND o_custkey % 13 > 0 AND run IN (SELECT id FROM latest)),
doc AS (SELECT id AS run, id * 10 + 1 AS id, root_url AS url, 'html' AS kind, id % 4 > 0 AS has FROM latest UNION ALL SELECT id, id * 10, replace(root_url, 'index.htm', 'scores.pdf'), 'judges_scores_pdf', id % 3 > 0 FROM latest)
"""


def reviewed_layer(spark: SparkSession, d: str, once: bool = True) -> dict[str, DataFrame]:
    """The tables that ``_REVIEWED`` describes."""
    t = judged_layer(spark, d, once)
    k, club = F.floor(F.col("id") % _HELD / 10), F.col("club_name")
    piece = (k % 7 == 0) & (club != "")
    appearances = t["source_skater_appearances"].withColumns({"club_name": F.when(piece, F.lower(F.substring(club, 1, 3))).otherwise(club), "raw": F.create_map(F.lit("club"), club)})
    order = F.col("id") % _HELD
    places = F.create_map(F.when(order % 14 == 0, "Points").otherwise("SP"), "final_place")
    results = t["category_results"].withColumns({"final_place": F.when(order % 12 > 0, F.col("final_place")), "points": F.when(order % 18 > 0, F.col("points")), "segment_places": places})
    n = F.col("id")
    own = F.struct(F.concat(F.lit("kind "), n % 2).alias("event_type"), F.lit("federated").alias("competition_level"), F.struct(*[F.lit(None).cast(x).alias(f"_{i}") for i, x in enumerate(["string"] * 3 + ["boolean"] * 2 + ["string"])]).alias("representation"))
    profiles = t["source_profiles"].withColumns({"parser_profile": F.when(n % 2 == 0, quality.NEW).otherwise(quality.OLD), "competition_stream": F.concat(F.lit("stream "), n), "representation_primary": F.when(n % 2 == 1, "club").otherwise("nation"), "settings": own})
    run = F.col("import_run_id")
    html = F.when(F.floor(run / 10) % 2 == 0, "<tr><th>Category</th>\n<th>Segment</th><th>Reports</th></tr>").otherwise("<tr><th>Segment</th><th>Category</th></tr>")
    text = F.when(F.col("document_type") == "html", F.when(run % 4 > 0, html)).otherwise(F.when(run % 3 > 0, "%PDF-1.4"))
    documents = t["source_documents"].withColumns({"source_profile_id": F.floor(run / 100_000) % 5, "raw_text": text})
    files = registry.archive_manifest(documents.select("id", "import_run_id", "url", F.col("raw_text").alias("body")), t["import_runs"])
    c = table(spark, d, "customer")
    state = F.when(F.col("c_custkey") % 3 == 0, "registered").when(F.col("c_custkey") % 3 == 1, "skipped").otherwise("candidate_result_url")
    catalog = c.select(F.col("c_mktsegment").alias("source_name"), F.col("c_name").alias("event_name"), state.alias("discovery_status"), F.expr("repeat(char(65 + c_nationkey), 3)").alias("country_code"))
    cut = F.col("element_code").endswith("<") & (F.col("base_value") > 40)
    elements = t["pdf_elements"].withColumns({"markers": F.when(cut, F.array(F.lit("<<"))).otherwise(F.col("markers")), "element_code": F.when(cut, F.concat("element_code", F.lit("<"))).otherwise(F.col("element_code"))})
    more = {"source_skater_appearances": appearances, "category_results": results, "source_profiles": profiles, "source_documents": documents, "source_archive_files": files, "event_discovery_catalog": catalog, "pdf_elements": elements}
    return t | {name: registry.shaped(df, name) for name, df in more.items()}


# Reports.


@query(_REVIEWED + "SELECT id AS skater_appearance_id, event_name, skater_name, nation_code, profile_key FROM row_ WHERE nation_code = 'x' ORDER BY start_date NULLS LAST, skater_name, id LIMIT 200")
def report_nonconforming_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows for a reviewer."""
    return quality.nonconforming_nations(reviewed_layer(spark, d)).select("skater_appearance_id", "event_name", "skater_name", "nation_code", "profile_key")


@query(_REVIEWED + "SELECT id AS skater_appearance_id, skater_name, club_name, c_mktsegment AS raw_club FROM row_ WHERE newer AND club_name <> c_mktsegment ORDER BY club_name, skater_name, id LIMIT 200")
def report_club_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows for a reviewer."""
    return quality.club_fragments(reviewed_layer(spark, d)).select("skater_appearance_id", "skater_name", "club_name", "raw_club")


@query("""
SELECT r_name AS profile_key, CASE WHEN r_regionkey % 2 = 0 THEN 'fs_manager' ELSE 'old_isucalcfs' END AS parser_profile, 'stream ' || r_regionkey AS competition_stream, CASE WHEN r_regionkey % 2 = 1 THEN 'club' ELSE 'nation' END AS representation_primary, 'kind ' || (r_regionkey % 2) AS event_type FROM region
""")
def report_profile_settings(spark: SparkSession, d: str) -> DataFrame:
    out = quality.profile_settings(reviewed_layer(spark, d, once=False))
    return out.select("profile_key", "parser_profile", "competition_stream", "representation_primary", F.col("settings.event_type").alias("event_type"))


@query(_REVIEWED + "SELECT id AS skater_appearance_id, skater_name, final_place, CASE WHEN k % 18 > 0 THEN (o_totalprice / 1000)::DECIMAL(10, 3)::DOUBLE END AS points FROM row_ WHERE i = 1 AND (k % 12 = 0 OR k % 18 = 0) ORDER BY start_date NULLS LAST, event_name, category_name, id LIMIT 200")
def report_results_without_score(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows for a reviewer."""
    return quality.results_without_score(reviewed_layer(spark, d)).select("skater_appearance_id", "skater_name", "final_place", F.col("points").cast("double").alias("points"))


@query(_REVIEWED + "SELECT r_name AS profile_key, id AS import_run_id, root_url, 1::BIGINT AS documents FROM latest JOIN region ON r_regionkey = c_nationkey % 5 WHERE r_regionkey % 2 = 1 AND id % 4 > 0 AND y % 2 = 0")
def report_document_layout(spark: SparkSession, d: str) -> DataFrame:
    return quality.documents_with_layout(reviewed_layer(spark, d), ["Category", "Segment", "Reports"], "index").select("profile_key", "import_run_id", "root_url", "documents")


@query(_REVIEWED + "SELECT root_url, event_name, category_name, skater_name, final_place, final_place AS as_points FROM row_ WHERE i = 1 AND k % 14 = 0")
def report_points_as_segment(spark: SparkSession, d: str) -> DataFrame:
    out = quality.points_as_segment(reviewed_layer(spark, d))
    # the layer's place under the wrong name is the one that results had before some lost theirs
    return out.select("root_url", "event_name", "category_name", "skater_name", "final_place", F.when(F.col("final_place").isNotNull(), F.col("segment_places")["Points"]).alias("as_points"))


@query(_JUDGED + "SELECT coalesce(club_name, '(empty club)') AS club_name, skater_name, nation_code, max(tss)::DOUBLE AS best_tss FROM score GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE score_source = 'pdf_score_summary' AND o_orderkey % 8 = 0) = 0 OR max(tss) = 0")
def report_missing_best_scores(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of seven in eight orders have components of 0, and pages have none: skaters whose best is missing."""
    t = judged_layer(spark, d)
    zero = F.when(F.floor(F.col("id") % _HELD / 10) % 8 == 0, F.col("total_program_component_score")).otherwise(0)
    t["pdf_score_summaries"] = t["pdf_score_summaries"].withColumn("total_program_component_score", zero)
    return quality.missing_best_scores(t).select("club_name", "skater_name", "nation_code", F.col("best_tss").cast("double").alias("best_tss"))


@query(_REVIEWED + "SELECT CASE WHEN has THEN 'written' ELSE 'skipped' END AS archive_status, kind AS document_type, count(*) AS source_documents FROM doc GROUP BY 1, 2")
def report_archive_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.archive_counts(reviewed_layer(spark, d))


@query("""
SELECT c_mktsegment AS source_name, CASE c_custkey % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'skipped' ELSE 'candidate_result_url' END AS discovery_status, repeat(chr(65 + c_nationkey), 3) AS country_code, count(*) AS events FROM customer GROUP BY 1, 2, 3
""")
def report_catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.catalog_counts(reviewed_layer(spark, d, once=False))


@query(_REVIEWED + "SELECT count(*) AS rows, count(*) AS with_document, count(*) FILTER (WHERE has) AS with_archive FROM row_ JOIN doc ON doc.id = row_.run * 10 + i % 2")
def report_evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.evidence_coverage(reviewed_layer(spark, d))


@query(_JUDGED + "SELECT element_id, root_url, skater_name, n AS element_no, code || '<' AS element_code, l_quantity::DOUBLE AS base_value FROM el WHERE code LIKE '%<' AND l_quantity > 40 ORDER BY skater_name, n, element_id LIMIT 25")
def report_downgraded(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 examples."""
    return quality.downgraded(reviewed_layer(spark, d)).select("element_id", "root_url", "skater_name", "element_no", "element_code", F.col("base_value").cast("double").alias("base_value"))


@query(_JUDGED + """
SELECT run AS import_run_id, CASE WHEN o_orderkey % 20 = 0 THEN 'warning' ELSE 'info' END AS level, CASE WHEN o_orderkey % 30 = 0 THEN 'missing_pdf_elements' ELSE 'missing_pdf_scores' END AS code, count(*) AS issues FROM every WHERE o_orderkey % 10 = 0 GROUP BY 1, 2, 3
""")
def report_issue_codes(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues_by_code(judged_layer(spark, d))


@query(_REVIEWED + """
SELECT skater_name, nation_code, count(DISTINCT run) AS competitions, count(DISTINCT category_name) AS categories, count(DISTINCT run) AS with_results, string_agg(DISTINCT club_name, ',' ORDER BY club_name) AS clubs, min('1.7.' || year(start_date) || ' - 3.7.' || year(start_date)) AS first_date_text
FROM row_ GROUP BY 1, 2 HAVING count(DISTINCT run) >= 2 ORDER BY competitions DESC, skater_name, nation_code LIMIT 25
""")
def report_returning_skaters(spark: SparkSession, d: str) -> DataFrame:
    """The 25 with most competitions."""
    out = quality.multi_competition_skaters(reviewed_layer(spark, d))
    return out.withColumn("clubs", F.nullif(F.array_join("clubs", ","), F.lit("")))


# The mart as stored.


def _stored(t: dict[str, DataFrame], spark: SparkSession, name: str) -> DataFrame:
    root = S.shared_path(spark, "mart")
    mart.write_mart(t, root, [name])
    return spark.read.parquet(f"{root}/{name}")


@query(_JUDGED + "SELECT DISTINCT y || '-07-01' AS date_key, y AS year, 7 AS month, 1 AS day, y || '/' || (y + 1) AS skating_season FROM latest WHERE c_nationkey % 3 > 0")
def mart_dates(spark: SparkSession, d: str) -> DataFrame:
    return _stored(judged_layer(spark, d), spark, "dim_date").select(day("date_key").alias("date_key"), "year", "month", "day", "skating_season")


@query(_JUDGED + """
, seen AS (SELECT app.*, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey IN (SELECT o_orderkey FROM lines) THEN 3 ELSE 2 END AS n FROM app)
SELECT skater_key, dim.skater_name, dim.nation_code, dim.club_name, sum(n)::BIGINT AS source_appearances, strftime(min(start_date), '%Y-%m-%d') AS first_seen, strftime(max(start_date), '%Y-%m-%d') AS latest_seen
FROM dim JOIN seen ON seen.skater_name = dim.skater_name AND seen.nation_code IS NOT DISTINCT FROM dim.nation_code AND seen.club_name IS NOT DISTINCT FROM dim.club_name GROUP BY 1, 2, 3, 4
""")
def mart_skaters(spark: SparkSession, d: str) -> DataFrame:
    out = _stored(judged_layer(spark, d), spark, "dim_skater")
    return out.select("skater_key", "skater_name", "nation_code", "club_name", "source_appearances", day("first_seen_date").alias("first_seen"), day("latest_seen_date").alias("latest_seen"))


@query(_JUDGED + "SELECT DISTINCT run * 10 + digit AS category_key, run AS event_key, category_name FROM app JOIN digit USING (category_name)")
def mart_categories(spark: SparkSession, d: str) -> DataFrame:
    return _stored(judged_layer(spark, d), spark, "dim_category").select("category_key", "event_key", "category_name")


@query(_JUDGED + "SELECT DISTINCT (run * 10 + digit) * 10 + 1 AS segment_key, run * 10 + digit AS category_key, 'Free Skating' AS segment_name FROM app JOIN digit USING (category_name)")
def mart_segments(spark: SparkSession, d: str) -> DataFrame:
    return _stored(judged_layer(spark, d), spark, "dim_segment").select("segment_key", "category_key", "segment_name")


@query(_JUDGED + "SELECT DISTINCT nation_code AS country_key, nation_code FROM app WHERE nation_code IS NOT NULL")
def mart_countries(spark: SparkSession, d: str) -> DataFrame:
    return _stored(judged_layer(spark, d), spark, "dim_country").select("country_key", "nation_code")


@query(_REVIEWED + """
SELECT runs.id * 10 + one AS source_document_key, runs.root_url, CASE WHEN one = 1 THEN runs.root_url ELSE replace(runs.root_url, 'index.htm', 'scores.pdf') END AS url, CASE WHEN one = 1 THEN 'html' ELSE 'judges_scores_pdf' END AS document_type, CASE WHEN doc.id IS NOT NULL THEN CASE WHEN has THEN 'written' ELSE 'skipped' END END AS archive_status
FROM runs CROSS JOIN (VALUES (0), (1)) v(one) LEFT JOIN doc ON doc.id = runs.id * 10 + one
""")
def mart_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all runs; those of the latest ones are archived."""
    return _stored(reviewed_layer(spark, d), spark, "dim_source_document").select("source_document_key", "root_url", "url", "document_type", "archive_status")


@query("SELECT DISTINCT p_type AS legend_group, p_brand AS code, CASE p_brand WHEN 'Brand#23' THEN 1 WHEN 'Brand#11' THEN 2 ELSE 99 END AS sort_order FROM part WHERE p_type IN ('STANDARD', 'PROMO')")
def mart_legend(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select(F.col("p_type").alias("legend_group"), F.col("p_brand").alias("code")).distinct()
    out = mart.legend({"validation_legend": registry.shaped(entries, "validation_legend")}, ["STANDARD", "PROMO"], ["Brand#23", "Brand#11"])
    return out.select("legend_group", "code", "sort_order")


# Changes of the registry, removals and updates.


def _url(key: str) -> Column:
    return F.concat(F.lit(SITE), F.col(key))


@query("""
WITH c AS (SELECT *, c_custkey % 3 > 0 AS old, c_custkey % 4 > 0 AS new FROM customer)
SELECT c_custkey, CASE WHEN old AND c_custkey % 3 = 1 THEN 'imported' WHEN new THEN 'analyzed' ELSE 'pending' END AS status, CASE WHEN old AND c_custkey % 3 = 1 THEN 'passed' WHEN new THEN 'warning' ELSE 'not_checked' END AS validation_status,
  concat_ws('|', CASE WHEN old THEN 'old' END, CASE WHEN new THEN 'new ' || c_nationkey END) AS notes, CASE WHEN new THEN 'new' ELSE 'old' END AS source, CASE WHEN old THEN '1' END AS a, CASE WHEN old AND c_custkey % 2 = 0 THEN c_custkey % 5 WHEN new THEN 9 END AS source_profile_id, CASE WHEN old THEN 'f' END AS family
FROM c WHERE old OR new
""")
def registry_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a registry, decisions on them and on others."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    base = c.where(k % 3 > 0).select(
        _url("c_custkey").alias("url"), F.lit("f").alias("family"), F.when(k % 3 == 1, "imported").otherwise("pending").alias("status"), F.when(k % 3 == 1, "passed").otherwise("not_checked").alias("validation_status"), F.lit("old").alias("notes"),
        F.create_map(F.lit("a"), F.lit("1"), F.lit("source"), F.lit("old")).alias("summary"), F.when(k % 2 == 0, k % 5).alias("source_profile_id"),
    )
    decided = c.where(k % 4 > 0).select(_url("c_custkey").alias("url"), F.lit("analyzed").alias("status"), F.lit("warning").alias("validation_status"), F.concat(F.lit("new "), "c_nationkey").alias("notes"), F.create_map(F.lit("source"), F.lit("new")).alias("summary"), F.lit(9).cast("long").alias("source_profile_id"))
    out = registry.register(registry.shaped(base, "source_url_registry"), decided)
    key = F.replace("url", F.lit(SITE), F.lit("")).cast("long").alias("c_custkey")
    return out.select(key, "status", "validation_status", F.replace("notes", F.lit("\n"), F.lit("|")).alias("notes"), F.col("summary")["source"].alias("source"), F.try_element_at("summary", F.lit("a")).alias("a"), "source_profile_id", "family")


@query("""
SELECT c_custkey, CASE WHEN done THEN 'imported' ELSE 'ready_for_import' END AS status, CASE WHEN c_custkey % 2 = 0 AND NOT done THEN 'failed' WHEN c_custkey % 2 = 0 THEN 'passed' ELSE 'warning' END AS validation_status
FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS done FROM customer)
""")
def registry_refresh(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "customer").select(_url("c_custkey").alias("url"), F.lit("ready_for_import").alias("status"), F.when(F.col("c_custkey") % 2 == 0, "failed").otherwise("warning").alias("validation_status"))
    runs = table(spark, d, "orders").select(_url("o_custkey").alias("root_url"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("started").alias("status"))
    out = maintenance.refresh_registry(entries, runs)
    return out.select(F.replace("url", F.lit(SITE), F.lit("")).cast("long").alias("c_custkey"), "status", "validation_status")


_FED, _FAMILIES, _FOREIGN = "fed.invalid", ("isu_", "world_"), "('ISU', 'NonISU', 'ISUCS')"


@query(f"""
WITH p AS (SELECT c_custkey AS k, (['isu_', 'world_', 'local_', 'town_', 'found_'])[c_custkey % 5 + 1] || c_custkey AS profile_key, CASE WHEN c_custkey % 3 > 0 THEN '{_FED}' ELSE 'other.invalid' END AS host, (['amateur/', 'cup/', 'open/'])[c_custkey % 7 % 3 + 1] AS path, CASE WHEN c_custkey % 2 = 0 THEN 'fs_manager' ELSE 'old_isucalcfs' END AS parser,
  (['ISU', 'DP', 'club', NULL])[c_nationkey % 4 + 1] AS stream, CASE WHEN c_custkey % 11 < 7 THEN 'club' ELSE 'nation' END AS first, c_custkey % 5 = 4 AS discovered, 'kind' AS kind, 'level' AS level, 'none' AS col, true AS nation, true AS club, 'drop' AS empty FROM customer),
a AS (SELECT *, profile_key LIKE 'isu\\_%' ESCAPE '\\' OR profile_key LIKE 'world\\_%' ESCAPE '\\' OR coalesce(discovered AND stream IN {_FOREIGN} AND NOT (path = 'cup/' AND stream <> 'ISU'), false) AS hit FROM p),
b AS (SELECT k, profile_key, host, path, parser, CASE WHEN hit THEN coalesce(stream, 'international') ELSE stream END AS stream, CASE WHEN hit THEN 'nation' ELSE first END AS first, CASE WHEN hit THEN 'international' ELSE kind END AS kind, CASE WHEN hit THEN 'federated' ELSE level END AS level, CASE WHEN hit THEN 'country' ELSE col END AS col, nation, club AND NOT hit AS club, empty FROM a),
c AS (SELECT k, profile_key, host, path, parser, CASE WHEN path = 'amateur/' THEN 'club_amateur' ELSE stream END AS stream, CASE WHEN path = 'amateur/' THEN 'club' ELSE first END AS first, CASE WHEN path = 'amateur/' THEN 'club' ELSE kind END AS kind, CASE WHEN path = 'amateur/' THEN 'amateur' ELSE level END AS level, col, nation, club, CASE WHEN path = 'amateur/' THEN 'preserve_empty_review' ELSE empty END AS empty FROM b),
e AS (SELECT *, host = '{_FED}' AND parser = 'old_isucalcfs' AND first = 'club' AS hit FROM c),
f AS (SELECT k, host, path, parser, CASE WHEN hit THEN CASE WHEN path = 'cup/' THEN 'international' ELSE 'national' END ELSE stream END AS stream, first, CASE WHEN hit THEN CASE WHEN path = 'cup/' THEN 'international' ELSE 'national' END ELSE kind END AS kind, CASE WHEN hit THEN 'federated' ELSE level END AS level, CASE WHEN hit THEN 'club' ELSE col END AS col, nation AND NOT hit AS nation, club, empty FROM e),
g AS (SELECT *, coalesce(host = '{_FED}' AND parser <> 'old_isucalcfs' AND ((first = 'club' AND stream NOT IN {_FOREIGN}) OR (path = 'cup/' AND stream <> 'ISU')), false) AS hit FROM f)
SELECT k AS c_custkey, CASE WHEN hit THEN 'club' ELSE first END AS representation_primary, stream AS competition_stream, CASE WHEN hit AND path = 'cup/' THEN 'international' ELSE kind END AS event_type, CASE WHEN hit AND path = 'cup/' THEN 'federated' ELSE level END AS competition_level, CASE WHEN hit THEN 'country' ELSE col END AS nation_column, nation AS store_nation, club AS store_club, empty AS empty_club_policy FROM g
""")
def ruled_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of two hosts, three paths, both parsers and four streams, one for each customer, after the four rules."""
    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n + 1).cast("int"))
    profiles = table(spark, d, "customer").select(
        "c_custkey", F.concat(pick(k % 5, *_FAMILIES, "local_", "town_", "found_"), k).alias("profile_key"), F.when(k % 3 > 0, _FED).otherwise("other.invalid").alias("host"), pick(k % 7 % 3, "amateur/", "cup/", "open/").alias("path_prefix"), F.when(k % 2 == 0, "fs_manager").otherwise("old_isucalcfs").alias("parser_profile"),
        pick(F.col("c_nationkey") % 4, "ISU", "DP", "club", None).alias("competition_stream"), F.when(k % 11 < 7, "club").otherwise("nation").alias("representation_primary"), (k % 5 == 4).alias("discovered"), F.lit("kind").alias("event_type"), F.lit("level").alias("competition_level"), F.lit("none").alias("nation_column"),
        F.lit(True).alias("store_nation"), F.lit(True).alias("store_club"), F.lit("drop").alias("empty_club_policy"),
    )
    out = maintenance.apply_rules(profiles, registry.profile_rules(_FAMILIES, "amateur/", _FED, "cup/"))
    return out.select("c_custkey", "representation_primary", "competition_stream", "event_type", "competition_level", "nation_column", "store_nation", "store_club", "empty_club_policy")


@query(_JUDGED + """
, dead AS (SELECT every.*, lines.o_orderkey IS NOT NULL AND every.o_orderkey % 5 > 0 AS scored FROM every LEFT JOIN lines ON lines.o_orderkey = every.o_orderkey WHERE run IN (SELECT id FROM runs WHERE status = 'failed')),
c AS (SELECT count(*) AS n, count(DISTINCT run) AS r, count(DISTINCT (run, digit)) AS cats, count(*) FILTER (WHERE scored) AS scored, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS issues FROM dead),
e AS (SELECT count(*) AS els FROM dead JOIN seq ON l_orderkey = o_orderkey WHERE scored AND digit <> 4),
o AS (SELECT count(*) AS officials FROM panel WHERE run IN (SELECT run FROM dead))
SELECT label, removed FROM (SELECT unnest(['import_runs', 'source_documents', 'parse_issues', 'events', 'categories', 'segments', 'source_skater_appearances', 'category_results', 'segment_results', 'official_assignments', 'pdf_score_summaries', 'pdf_elements', 'pdf_element_judge_scores', 'pdf_program_components']) AS label,
  unnest([r, 2 * r, issues, r, cats, 2 * cats, 2 * n + scored, n, n, officials, scored, els, 2 * els, 3 * scored]) AS removed FROM c, e, o)
""")
def removed_runs(spark: SparkSession, d: str) -> DataFrame:
    """What goes with failed runs, table by table."""
    t = judged_layer(spark, d)
    names = ["import_runs", *[n for n in maintenance.REFERENCES if n in ("source_documents", "parse_issues", "events", "categories", "segments", "source_skater_appearances", "category_results", "segment_results", "official_assignments", "pdf_score_summaries", "pdf_elements", "pdf_element_judge_scores", "pdf_program_components")]]
    before = {n: S.written(t[n], n) for n in names}
    return maintenance.removed_counts(before, maintenance.cascade_delete(before, before["import_runs"].where("status = 'failed'").select("id")))


@query(_JUDGED + ", judge AS (SELECT segment_id, judge_number, min(name) AS official FROM panel WHERE role_group = 'judge' GROUP BY 1, 2) SELECT element_id AS element_score_key, j AS judge_number, official FROM el CROSS JOIN (VALUES (1), (2)) m(j) LEFT JOIN judge ON judge.segment_id = el.segment_id AND judge_number = j")
def marks_with_officials(spark: SparkSession, d: str) -> DataFrame:
    """The judge behind each mark, where the panel has one of that number."""
    t = judged_layer(spark, d)
    marks = mart.fact_element_judge_mark(t).withColumnRenamed("segment_key", "segment_id")
    out = joins.assign_officials(marks, t["official_assignments"].select("segment_id", "role_group", "judge_number", F.col("name").alias("official_id")))
    return out.select("element_score_key", "judge_number", F.col("official_id").alias("official"))


@query("""
WITH o AS (SELECT o_custkey, max(o_totalprice) AS top, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_acctbal ELSE top END AS c_acctbal, CASE WHEN o_custkey IS NULL OR c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' ' || p END AS c_mktsegment FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def updated_customers(spark: SparkSession, d: str) -> DataFrame:
    """Columns of customers set from their finished orders; the others stay as they are."""
    source = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderpriority").alias("c_mktsegment"))
    segment = lambda old, new: F.when(F.col("c_custkey") % 2 == 0, old).otherwise(F.concat_ws(" ", old, new))
    return joins.update_from(table(spark, d, "customer"), source, ["c_custkey"], {"c_acctbal": lambda old, new: new, "c_mktsegment": segment}).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("""
SELECT 'orders' AS kind, c_custkey AS id, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT 'lines', s_suppkey, count(l_orderkey) FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_linenumber = 7 GROUP BY s_suppkey
""")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = aggregate.count_children(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), ["id"], "children")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_suppkey").alias("id"))
    return aggregate.union_tagged("kind", orders=orders, lines=aggregate.count_children(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), lines, ["id"], "children"))


# Sources and pages.


@query("SELECT 'tables' AS form, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages UNION ALL SELECT 'files', count(*), 33 * count(*) FROM pages")
def source_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a table of documents, and files with a hash a line as documents."""
    page, root = table(spark, d, "pages"), S.shared_path(spark, "corpus")
    page.select("url", F.col("html").alias("body")).write.parquet(f"{root}/tables")
    page.select(F.md5("html")).write.text(f"{root}/files")
    size = F.sum(F.octet_length("body")).alias("bytes")
    held = S.read_documents(spark, f"{root}/tables").agg(F.count("*").alias("n"), size)
    lines = F.regexp_count(F.col("body").cast("string"), F.lit("\n"))
    files = S.read_documents(spark, f"{root}/files", "*.txt").agg(F.sum(lines).cast("long").alias("n"), size)
    return aggregate.union_tagged("form", tables=held, files=files)


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment)::INT - 1 AS ordinal, c_mktsegment || c_nationkey AS profile_key, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)")
def source_profiles_file(spark: SparkSession, d: str) -> DataFrame:
    """Profiles in one JSON file, one for each nation and segment of customers."""
    found = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    entry = F.struct("c_nationkey", "c_mktsegment", F.concat("c_mktsegment", "c_nationkey").alias("profile_key"), "n")
    root = S.shared_path(spark, "profiles")
    found.agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("profiles"))).alias("value")).write.text(root)
    return S.read_profiles(spark, root).select("ordinal", "profile_key", "n")


@query("""
SELECT s_nationkey, s_name AS event_name, (s_suppkey % 28 + 1) || ' Oct - 30 Oct 2020' AS date_range, 'City ' || s_suppkey AS city, repeat(chr(65 + s_nationkey), 3) AS country_code, '/eventdetail/' || s_suppkey AS detail_url FROM supplier WHERE s_suppkey % 3 > 0
""")
def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    """A listing for each nation; every third event of it is of another discipline and has no detail page."""
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    tag = lambda *parts: F.concat(F.lit("<p>"), *parts, F.lit("</p>"))
    link = F.when(k % 3 > 0, F.concat(F.lit('<a href="/eventdetail/'), k, F.lit('">details</a>'))).otherwise("")
    row = F.concat(tag((k % 28 + 1).cast("string"), F.lit(" Oct - 30  Oct 2020")), tag("s_name"), tag(F.lit("City "), k, F.lit(" / "), F.expr("repeat(char(65 + s_nationkey), 3)")), tag(F.when(k % 3 > 0, "Figure Skating").otherwise("Speed")), link)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"])
    docs = s.groupBy(F.col("s_nationkey").cast("string").alias("url")).agg(F.concat(F.lit("<script>1 Oct 2020</script>"), F.array_join(rows, "")).alias("body"))
    return pages.catalog_rows(docs).select(F.col("doc_id").cast("long").alias("s_nationkey"), "event_name", "date_range", "city", "country_code", "detail_url")


@query("SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'entry_no|name|nation' ELSE 'name|nation|entry_no' END AS headers, count(*) AS entries FROM customer GROUP BY 1")
def page_headers(spark: SparkSession, d: str) -> DataFrame:
    """The names of the headers of a page of entries for each nation, in one of two orders, with the number of rows under them."""
    c = table(spark, d, "customer")
    k, name, nation = F.col("c_custkey").cast("string"), F.col("c_name"), F.lit("AAA")
    of = lambda rest, order, row: _pages(c.where(F.col("c_nationkey") % 2 == rest), F.concat(F.lit(SITE), F.col("c_nationkey"), F.lit("/CAT001EN.HTM")), F.lit("Open"), order, row, "c_custkey")
    rows = S.written(pages.rows(of(0, ("No.", "Name", "Nat."), _row(k, name, nation)).unionByName(of(1, ("Name", "Nat.", "No."), _row(name, nation, k)))), "rows")
    heads = pages.header_map(rows).where(has_headers(F.col("headers"), ["nation", "entry_no"]))
    counts = pages.entry_rows(rows).groupBy("doc_id").agg(F.count("*").alias("entries"))
    return heads.join(counts, "doc_id").select(F.regexp_extract("doc_id", r"/(\d+)/[^/]*$", 1).cast("long").alias("c_nationkey"), F.array_join("headers", "|").alias("headers"), "entries")
