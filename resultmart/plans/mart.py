"""The star mart: dimensions, facts, personal bests and source evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.functions.arrays import agg_ordered
from resultmart.functions.text import season
from resultmart.operators.joins import null_safe_join
from resultmart.operators.windows import dense_key
from resultmart.plans import analytics as V
from resultmart.sources.tables import written

Tables = dict[str, DataFrame]
SKATER = ["skater_name", "nation_code", "club_name"]


@V.view
def dim_date(t: Tables) -> DataFrame:
    d = F.col("event_start_date")
    return V.v_events(t).where(d.isNotNull()).select(d.alias("date_key"), F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), season(d).alias("skating_season")).distinct()


@V.view
def dim_skater(t: Tables) -> DataFrame:
    """Skaters by name, nation and club, never by name alone."""
    found = V.v_skater_appearances_clean(t).where("skater_name IS NOT NULL").groupBy(*SKATER).agg(F.count_distinct("skater_appearance_id").alias("source_appearances"), F.min("event_start_date").alias("first_seen_date"), F.max("event_start_date").alias("latest_seen_date"))
    return dense_key(found, SKATER, "skater_key")


@V.view
def dim_event(t: Tables) -> DataFrame:
    return V.v_events(t).withColumnRenamed("event_id", "event_key").drop("raw")


@V.view
def dim_category(t: Tables) -> DataFrame:
    return V.v_skater_appearances_clean(t).where("category_id IS NOT NULL").select(F.col("category_id").alias("category_key"), F.col("event_id").alias("event_key"), "category_name").distinct()


@V.view
def dim_segment(t: Tables) -> DataFrame:
    return V.v_skater_appearances_clean(t).where("segment_id IS NOT NULL").select(F.col("segment_id").alias("segment_key"), F.col("category_id").alias("category_key"), "segment_name").distinct()


@V.view
def dim_country(t: Tables) -> DataFrame:
    return V.v_skater_appearances_clean(t).where("nation_code IS NOT NULL").select(F.col("nation_code").alias("country_key"), "nation_code").distinct()


@V.view
def dim_club(t: Tables) -> DataFrame:
    """Clubs with the use of all their aliases; an event that two aliases name counts twice."""
    return V.v_club_alias_usage(t).groupBy(F.col("club_id").alias("club_key"), "canonical_name", "country_code", "status").agg(agg_ordered(F.col("alias_name"), F.col("alias_name")).alias("aliases"), F.sum("imported_appearance_count").alias("imported_appearance_count"), F.sum("event_count").alias("event_count"))


@V.view
def dim_element(t: Tables) -> DataFrame:
    return dense_key(t["pdf_elements"].groupBy("base_element_code", "element_code").agg(F.count("*").alias("observed_count")), ["base_element_code", "element_code"], "element_key")


@V.view
def dim_official(t: Tables) -> DataFrame:
    key = ["name", "nation_code", "role_group"]
    return dense_key(t["official_assignments"].groupBy(*key).agg(F.count("*").alias("assignments")), key, "official_key")


@V.view
def dim_source_document(t: Tables) -> DataFrame:
    docs = t["source_documents"].select(F.col("id").alias("source_document_key"), "import_run_id", "url", "document_type", "parser_profile", "content_hash", "fetched_at", "parse_status", "metadata")
    runs = t["import_runs"].select(F.col("id").alias("import_run_id"), "root_url")
    files = t["source_archive_files"].select(F.col("source_document_id").alias("source_document_key"), "archive_path", "archive_sha256", "archive_status", "archive_reason")
    return docs.join(runs, "import_run_id").join(files, "source_document_key", "left")


def _skater_keys(t: Tables) -> DataFrame:
    """Skaters with their keys alone: the dimension counts and dates them too, for which all appearances are shuffled."""
    if "view:dim_skater" in t:
        return t["view:dim_skater"].select("skater_key", *SKATER)
    return dense_key(V.v_skater_appearances_clean(t).where("skater_name IS NOT NULL").select(*SKATER).distinct(), SKATER, "skater_key")


def _with_skater(df: DataFrame, t: Tables) -> DataFrame:
    return null_safe_join(df, _skater_keys(t), SKATER)


@V.view
def fact_competition_result(t: Tables) -> DataFrame:
    out = _with_skater(V.v_skater_category_results(t), t)
    return out.select(F.col("skater_appearance_id").alias("competition_result_key"), F.col("event_id").alias("event_key"), F.col("category_id").alias("category_key"), "skater_key", F.col("event_start_date").alias("date_key"), *SKATER, "final_place", "points", "segment_places", "raw")


@V.view
def fact_segment_score(t: Tables) -> DataFrame:
    out = _with_skater(V.v_skater_segment_scores(t), t)
    return out.select(
        F.col("score_id").alias("segment_score_key"), "score_source", "skater_appearance_id", F.col("event_id").alias("event_key"), F.col("category_id").alias("category_key"), F.col("segment_id").alias("segment_key"), "skater_key", F.col("event_start_date").alias("date_key"),
        *SKATER, "place", "tss", "score_total", "tes", "pcs", "deduction", "base_value_total", "element_score_total", "judge_count", "raw",
    )


@V.view
def fact_element_score(t: Tables) -> DataFrame:
    # codes are few: written, their size is known
    codes = written(dim_element(t).select("element_key", "base_element_code", "element_code"), "element-keys")
    elements = null_safe_join(V.elements_of(t, _with_skater(V.sheets_clean(t), t)), codes, ["base_element_code", "element_code"])
    return elements.select(
        F.col("element_id").alias("element_score_key"), F.col("score_id").alias("segment_score_key"), "skater_appearance_id", F.col("event_id").alias("event_key"), "category_name", "segment_name", "skater_key", "element_key", F.col("event_start_date").alias("date_key"),
        *SKATER, "element_no", "element_code", "base_element_code", "raw_element", "info", "markers", "base_value", "goe", "bonus", "panel_score", "raw",
    )


def _sheets(t: Tables) -> DataFrame:
    """Score sheets with event, category, segment and skater."""
    who = V.v_skater_appearances_clean(t).select("skater_appearance_id", "event_id", "category_id", "segment_id", *SKATER)
    sheets = t["pdf_score_summaries"].select(F.col("id").alias("segment_score_key"), "skater_appearance_id").join(who, "skater_appearance_id")
    return _with_skater(sheets, t).select("segment_score_key", F.col("event_id").alias("event_key"), F.col("category_id").alias("category_key"), F.col("segment_id").alias("segment_key"), "skater_key")


@V.view
def fact_element_judge_mark(t: Tables) -> DataFrame:
    marks = t["pdf_element_judge_scores"].select(F.col("id").alias("element_judge_mark_key"), F.col("pdf_element_id").alias("element_score_key"), "official_assignment_id", "judge_number", "score")
    elements = t["pdf_elements"].select(F.col("id").alias("element_score_key"), F.col("pdf_score_summary_id").alias("segment_score_key"))
    # marks are the most: they meet elements that have all of their sheet
    of = elements.join(_sheets(t), "segment_score_key")
    return marks.join(of, "element_score_key").select("segment_score_key", "element_score_key", *[c for c in marks.columns if c != "element_score_key"], *[c for c in of.columns if c not in elements.columns])


@V.view
def fact_component_score(t: Tables) -> DataFrame:
    parts = t["pdf_program_components"].select(F.col("id").alias("component_score_key"), F.col("pdf_score_summary_id").alias("segment_score_key"), "component_name", "factor", "score", "raw")
    return parts.join(_sheets(t), "segment_score_key")


@V.view
def v_skater_personal_bests(t: Tables) -> DataFrame:
    best = [F.max(c).alias(f"best_{c}") for c in ("tss", "tes", "pcs", "score_total")]
    return fact_segment_score(t).groupBy("skater_key", *SKATER).agg(*best, F.min("date_key").alias("first_score_date"), F.max("date_key").alias("latest_score_date"), F.count_distinct("event_key").alias("competitions"))


@V.view
def v_skater_source_evidence(t: Tables) -> DataFrame:
    who = V.v_skater_appearances_clean(t).select(*SKATER, "event_name", "event_start_date", "category_name", "segment_name", "appearance_type", "skater_appearance_id", F.col("source_document_id").alias("source_document_key"), "root_url", "import_run_id")
    docs = t["source_documents"].select(F.col("id").alias("source_document_key"), F.col("url").alias("source_url"), "document_type", "content_hash", "metadata")
    files = t["source_archive_files"].select(F.col("source_document_id").alias("source_document_key"), "archive_path", "archive_sha256", "archive_status")
    return who.join(docs, "source_document_key", "left").join(files, "source_document_key", "left")


def legend(t: Tables, groups: list[str], order: list[str]) -> DataFrame:
    """The legend of some groups; codes in ``order`` come first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("code"))
    return t["validation_legend"].where(F.col("legend_group").isin(*groups)).withColumn("sort_order", F.when(place > 0, place).otherwise(F.lit(99))).orderBy("legend_group", "sort_order", "code")


VIEWS = {f.__name__: f for f in (V.v_latest_import_runs, V.v_events, V.v_skater_appearances_clean, V.v_skater_category_results, V.v_skater_segment_scores, V.v_skater_elements, V.v_skater_progression, V.v_club_skater_summary, V.v_data_quality_representation, V.v_club_alias_usage, V.v_skater_appearances_with_club, V.v_skater_category_results_with_club, dim_date, dim_skater, dim_event, dim_category, dim_segment, dim_country, dim_club, dim_element, dim_official, dim_source_document, fact_competition_result, fact_segment_score, fact_element_score, fact_element_judge_mark, fact_component_score, v_skater_personal_bests, v_skater_source_evidence)}


def write_mart(t: Tables, root: str, names: list[str] | None = None) -> None:
    """Materialise views as Parquet, in the order of ``VIEWS``: later ones read earlier ones instead of computing them again, so facts have the keys that the dimensions have."""
    held = dict(t)
    for name in names or VIEWS:
        df = VIEWS[name](held)
        df.write.parquet(f"{root}/{name}")
        held[f"view:{name}"] = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
