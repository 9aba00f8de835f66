"""Analytics views over the latest completed run of every source. Each takes the tables by name and gives a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.functions.arrays import agg_ordered
from resultmart.functions.text import blank_to_null, first_filled, non_blank, normalize_alias, not_iso3, parse_event_start
from resultmart.operators.joins import prefer_source
from resultmart.operators.latest import latest_per_key
from resultmart.operators.windows import progression
from resultmart.sources.tables import written

Tables = dict[str, DataFrame]

RUN = ["root_url", "profile_key", "parser_profile", "competition_stream", "representation_primary", "event_type", "competition_level"]
CONTEXT = ["skater_appearance_id", "import_run_id", "event_id", "root_url", "event_name", "event_start_date", "date_range", "event_type", "competition_level", "competition_stream"]
WHO = ["skater_name", "nation_code", "club_name", "display_affiliation"]


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """A view that was materialised stands among the tables as ``view:`` and its name, and is read from there."""

    @functools.wraps(f)
    def run(t: Tables) -> DataFrame:
        held = f"view:{f.__name__}"
        return t[held] if held in t else f(t)

    return run


@view
def v_latest_import_runs(t: Tables) -> DataFrame:
    runs = latest_per_key(t["import_runs"], ["root_url"], ["id"], F.col("status") == "completed")
    p = t["source_profiles"].select(F.col("id").alias("source_profile_id"), "profile_key", "parser_profile", "competition_stream", "representation_primary", F.col("settings.event_type").alias("event_type"), F.col("settings.competition_level").alias("competition_level"), F.col("settings").alias("source_profile_settings"))
    return runs.withColumnRenamed("id", "import_run_id").drop("error").join(p, "source_profile_id", "left")


@view
def v_events(t: Tables) -> DataFrame:
    e = t["events"].select(F.col("id").alias("event_id"), "import_run_id", F.col("name").alias("event_name"), "location", "venue", "date_range", parse_event_start(F.col("date_range")).alias("event_start_date"), "event_protocol_url", "raw")
    return e.join(v_latest_import_runs(t).select("import_run_id", *RUN), "import_run_id")


@view
def v_skater_appearances_clean(t: Tables) -> DataFrame:
    a = t["source_skater_appearances"].where(non_blank(F.col("normalized_name"))).withColumnsRenamed({"id": "skater_appearance_id", "normalized_name": "skater_name"})
    blank = {c: blank_to_null(F.col(c)) for c in ("nation_code", "club_name", "representation_value")}
    a = a.withColumn("display_affiliation", first_filled(F.col("club_name"), F.col("nation_code"))).withColumns(blank).drop("import_run_id")
    # events are few beside appearances; written, their size is known, and they are sent to the tasks where they are small
    events = written(v_events(t).select("event_id", "import_run_id", "event_name", "event_start_date", "date_range", *RUN), "events")
    categories = t["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    segments = t["segments"].select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"))
    return a.join(events, "event_id").join(categories, "category_id", "left").join(segments, "segment_id", "left")


@view
def v_skater_category_results(t: Tables) -> DataFrame:
    results = t["category_results"].select("skater_appearance_id", "final_place", "points", "segment_places", "raw")
    return results.join(v_skater_appearances_clean(t).select(*CONTEXT, "category_id", "category_name", *WHO), "skater_appearance_id")


def _scored(t: Tables) -> DataFrame:
    return v_skater_appearances_clean(t).select(*CONTEXT, "category_id", "category_name", "segment_id", "segment_name", *WHO, "source_skater_id")


@view
def v_skater_segment_scores(t: Tables) -> DataFrame:
    """Score sheets, and the page's row where no sheet has that skater in that segment under a compatible id."""
    none = lambda kind: F.lit(None).cast(kind)
    sheets = t["pdf_score_summaries"].select(
        F.col("id").alias("score_id"), F.lit("pdf_score_summary").alias("score_source"), F.col("segment_id").alias("_segment"), "skater_appearance_id", F.col("rank").alias("place"), F.col("total_segment_score").alias("tss"), F.col("total_segment_score").alias("score_total"),
        F.col("total_element_score").alias("tes"), F.col("total_program_component_score").alias("pcs"), F.col("total_deductions").alias("deduction"), "base_value_total", "element_score_total", "judge_count", "raw",
    )
    pages = t["segment_results"].select(
        F.col("id").alias("score_id"), F.lit("html_segment_result").alias("score_source"), F.col("segment_id").alias("_segment"), "skater_appearance_id", "place", "tss", F.coalesce("tss", "tes").alias("score_total"),
        "tes", "pcs", "deduction", none("decimal(10,3)").alias("base_value_total"), none("decimal(10,3)").alias("element_score_total"), none("int").alias("judge_count"), "raw",
    )
    who = _scored(t)
    other = lambda a, b: blank_to_null(a("source_skater_id")).isNull() | blank_to_null(b("source_skater_id")).isNull() | (a("source_skater_id") == b("source_skater_id"))
    out = prefer_source(sheets.join(who, "skater_appearance_id"), pages.join(who, "skater_appearance_id"), ["_segment", "skater_name"], compatible=other)
    return out.drop("_segment", "source_skater_id")


def sheets_clean(t: Tables) -> DataFrame:
    """Score sheets by their id with what their appearances say."""
    s = t["pdf_score_summaries"].select(F.col("id").alias("score_id"), "skater_appearance_id")
    return s.join(v_skater_appearances_clean(t).select(*CONTEXT, "category_name", "segment_name", *WHO), "skater_appearance_id")


def elements_of(t: Tables, sheets: DataFrame) -> DataFrame:
    """Elements with the columns of their sheets. Sheets are complete before they meet their elements, which are many more and move once."""
    e = t["pdf_elements"].select(F.col("id").alias("element_id"), F.col("pdf_score_summary_id").alias("score_id"), "element_no", "element_code", "base_element_code", "raw_element", "info", "markers", "base_value", "goe", "bonus", "panel_score", "raw")
    return e.join(sheets, "score_id").select("skater_appearance_id", "score_id", *[c for c in e.columns if c != "score_id"], *[c for c in sheets.columns if c not in ("skater_appearance_id", "score_id")])


@view
def v_skater_elements(t: Tables) -> DataFrame:
    return elements_of(t, sheets_clean(t))


@view
def v_skater_progression(t: Tables) -> DataFrame:
    """Scores with the ones before them in the same segment. Ties in date, event and category fall to the score's id."""
    scores = v_skater_segment_scores(t)
    out = progression(scores, ["skater_name", "nation_code", "club_name", "segment_name"], ["event_start_date", "event_name", "category_name"], ["tss", "tes", "pcs"], "score_id")
    return out.withColumnsRenamed({f"previous_{m}": f"previous_{m}_same_segment" for m in ("tss", "tes", "pcs")} | {f"{m}_delta": f"{m}_delta_same_segment" for m in ("tss", "tes", "pcs")})


@view
def v_club_skater_summary(t: Tables) -> DataFrame:
    club = F.coalesce("club_name", F.lit("(empty club)")).alias("club_name")
    return v_skater_segment_scores(t).where("skater_name IS NOT NULL").groupBy(club, "skater_name", "nation_code").agg(
        F.count_distinct("event_id").alias("competitions"), F.count_distinct("category_name").alias("categories_seen"), F.min("event_start_date").alias("first_event_date"), F.max("event_start_date").alias("latest_event_date"),
        *[F.max(c).alias(f"best_{c}") for c in ("tss", "score_total", "tes", "pcs")], agg_ordered(F.col("event_type"), distinct=True).alias("event_types_seen"),
    )


@view
def v_data_quality_representation(t: Tables) -> DataFrame:
    return v_skater_appearances_clean(t).groupBy("event_type", "competition_level", "representation_primary", "competition_stream").agg(
        F.count("*").alias("appearances"), F.count("nation_code").alias("with_country"), F.count("club_name").alias("with_club"),
        F.count_if(not_iso3(F.col("nation_code"))).alias("non_iso_nation_codes"), F.count_if((F.col("representation_primary") == "club") & F.col("club_name").isNull()).alias("club_primary_empty_club"),
    )


@view
def v_club_alias_usage(t: Tables) -> DataFrame:
    """How often each alias occurs in all runs. Appearances are counted by alias before they meet the registry."""
    events = t["events"].select(F.col("id").alias("event_id"), "source_url", F.col("name").alias("event_name"))
    used = t["source_skater_appearances"].select(normalize_alias(F.col("club_name")).alias("alias_normalized"), F.col("id").alias("appearance_id"), "event_id").where("alias_normalized IS NOT NULL")
    counts = used.join(events, "event_id", "left").groupBy("alias_normalized").agg(
        F.count("appearance_id").alias("imported_appearance_count"), F.count_distinct("event_id").alias("event_count"), F.count_distinct("source_url").alias("source_event_url_count"),
        F.min("event_name").alias("sample_event_name"), F.min("source_url").alias("sample_event_url"),
    )
    registry = t["club_aliases"].select("alias_name", "alias_normalized", "club_id", F.col("source").alias("alias_source"), F.col("confidence").alias("alias_confidence")).join(t["clubs"].withColumnRenamed("confidence", "club_confidence"), "club_id")
    return registry.join(counts, "alias_normalized", "left").fillna(0, ["imported_appearance_count", "event_count", "source_event_url_count"]).drop("alias_normalized")


def _with_club(df: DataFrame, t: Tables) -> DataFrame:
    clubs = t["clubs"].select("club_id", F.col("canonical_name").alias("canonical_club_name"), F.col("country_code").alias("canonical_club_country_code"), F.col("status").alias("canonical_club_status"))
    known = t["club_aliases"].select("alias_normalized", "club_id", F.col("confidence").alias("club_alias_confidence")).join(clubs, "club_id").withColumnRenamed("club_id", "canonical_club_id")
    return df.withColumn("alias_normalized", normalize_alias(F.col("club_name"))).join(known, "alias_normalized", "left").drop("alias_normalized")


@view
def v_skater_appearances_with_club(t: Tables) -> DataFrame:
    return _with_club(v_skater_appearances_clean(t), t)


@view
def v_skater_category_results_with_club(t: Tables) -> DataFrame:
    return _with_club(v_skater_category_results(t), t)
