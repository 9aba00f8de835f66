"""Schemas of the source tables, as DDL text. Scores are decimals; JSON columns are maps or structs."""

from __future__ import annotations

SCORE = "decimal(10,3)"
RAW = "raw map<string,string>"
PROFILE_SETTINGS = "struct<event_type:string,competition_level:string,representation:struct<primary:string,nation_column:string,club_column:string,store_nation:boolean,store_club:boolean,empty_club_policy:string>>"

TABLES: dict[str, str] = {
    "source_profiles": f"id long, profile_key string, host string, path_prefix string, parser_profile string, competition_stream string, representation_primary string, settings {PROFILE_SETTINGS}",
    "import_runs": "id long, source_profile_id long, root_url string, status string, started_at timestamp, finished_at timestamp, stats map<string,string>, error string",
    "source_documents": "id long, import_run_id long, source_profile_id long, url string, document_type string, parser_profile string, content_hash string, fetched_at timestamp, parse_status string, raw_text string, metadata map<string,string>",
    "parse_issues": "import_run_id long, source_document_id long, level string, code string, message string, context map<string,string>",
    "events": f"id long, import_run_id long, source_profile_id long, source_url string, name string, location string, venue string, date_range string, event_protocol_url string, {RAW}",
    "categories": f"id long, event_id long, name string, source_order int, {RAW}",
    "segments": f"id long, category_id long, name string, source_order int, judges_scores_pdf_url string, {RAW}",
    "schedule_items": f"id long, event_id long, scheduled_date string, scheduled_time string, category_name string, segment_name string, {RAW}",
    "source_skater_appearances": f"id long, import_run_id long, event_id long, category_id long, segment_id long, source_document_id long, appearance_type string, source_row_order int, raw_name string, normalized_name string, nation_code string, club_name string, representation_type string, representation_value string, bio_url string, source_skater_id string, {RAW}",
    "category_results": f"id long, category_id long, skater_appearance_id long, final_place int, points {SCORE}, segment_places map<string,int>, source_order int, {RAW}",
    "segment_results": f"id long, segment_id long, skater_appearance_id long, place int, tss {SCORE}, tes {SCORE}, pcs {SCORE}, deduction {SCORE}, starting_number int, components map<string,{SCORE}>, source_order int, {RAW}",
    "official_assignments": f"id long, segment_id long, source_document_id long, function_text string, role_group string, judge_number int, name string, nation_code string, source_order int, {RAW}",
    "pdf_score_summaries": f"id long, segment_id long, source_document_id long, skater_appearance_id long, rank int, starting_number int, total_segment_score {SCORE}, total_element_score {SCORE}, total_program_component_score {SCORE}, total_deductions {SCORE}, judge_count int, base_value_total {SCORE}, element_score_total {SCORE}, {RAW}",
    "pdf_elements": f"id long, pdf_score_summary_id long, element_no int, element_code string, base_element_code string, raw_element string, info string, markers array<string>, base_value {SCORE}, goe {SCORE}, bonus {SCORE}, panel_score {SCORE}, {RAW}",
    "pdf_element_judge_scores": "id long, pdf_element_id long, judge_number int, official_assignment_id long, score int",
    "pdf_program_components": f"id long, pdf_score_summary_id long, component_name string, factor {SCORE}, score {SCORE}, {RAW}",
    "pdf_component_judge_scores": f"id long, pdf_program_component_id long, judge_number int, official_assignment_id long, score {SCORE}",
    "clubs": "club_id string, canonical_name string, country_code string, status string, confidence string",
    "club_aliases": "alias_name string, alias_normalized string, club_id string, source string, confidence string",
    "source_archive_files": "source_document_id long, import_run_id long, root_url string, url string, document_type string, parser_profile string, content_hash string, archive_path string, archive_sha256 string, archive_status string, archive_reason string, parse_status string, fetched_at timestamp",
    "source_url_registry": "url string, family string, status string, validation_status string, notes string, summary map<string,string>, resolved_url string, source_profile_id long, parser_profile string, competition_stream string",
    "event_discovery_catalog": "source_name string, event_name string, date_range string, city string, country_code string, season string, kind string, detail_url string, result_url string, discovery_status string, metadata map<string,string>",
    "validation_legend": "legend_group string, code string, label string, description string",
}
