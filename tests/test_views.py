"""Views and reports on a small set of runs."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from resultmart.operators.maintenance import cascade_delete, removed_counts
from resultmart.plans import analytics as V
from resultmart.plans import mart, quality
from resultmart.sources.schemas import TABLES
from resultmart.sources.tables import empty_layer


def rows(spark, name, *dicts):
    schema = spark.createDataFrame([], TABLES[name]).schema
    return spark.createDataFrame([tuple(d.get(f.name, {} if f.dataType.typeName() == "map" else None) for f in schema) for d in dicts], schema)


@pytest.fixture(scope="module")
def t(spark):
    out = empty_layer(spark)
    appearance = lambda i, e, name, kind="segment_result", **x: dict(id=i, import_run_id=e, event_id=e * 10, category_id=e * 100, segment_id=e * 1000, appearance_type=kind, raw_name=name, normalized_name=name, source_document_id=e) | x
    out |= {
        n: rows(spark, n, *v)
        for n, v in {
            "source_profiles": [dict(id=1, profile_key="p", parser_profile="fs_manager", competition_stream="s", representation_primary="club", settings=("national", "federated", None))],
            "import_runs": [dict(id=1, source_profile_id=1, root_url="u1", status="completed"), dict(id=2, source_profile_id=1, root_url="u1", status="completed"), dict(id=3, root_url="u1", status="failed"), dict(id=4, source_profile_id=1, root_url="u2", status="completed")],
            "source_documents": [dict(id=i, import_run_id=i, url=f"d{i}", document_type="html") for i in (1, 2, 4)],
            "events": [dict(id=10, import_run_id=1, source_profile_id=1, source_url="u1", name="A", date_range="29.11.2013 - 1.12.2013"), dict(id=20, import_run_id=2, source_profile_id=1, source_url="u1", name="A", date_range="29.11.2013 - 1.12.2013"), dict(id=40, import_run_id=4, source_profile_id=1, source_url="u2", name="B", date_range="11/26/2014")],
            "categories": [dict(id=i * 100, event_id=i * 10, name="Men") for i in (1, 2, 4)],
            "segments": [dict(id=i * 1000, category_id=i * 100, name="Short", source_order=1) for i in (1, 2, 4)],
            "source_skater_appearances": [
                appearance(11, 1, "OLD RUN"), appearance(21, 2, "ANN", nation_code="BUL", club_name="", source_skater_id="x"), appearance(22, 2, "ANN", "pdf_score", nation_code="BUL", source_skater_id=""), appearance(23, 2, "BOB", nation_code="Elit", club_name="  Elit "),
                appearance(24, 2, "", nation_code="BUL"), appearance(41, 4, "ANN", nation_code="BUL"), appearance(42, 4, "EVE", "pdf_score", source_skater_id="a"), appearance(43, 4, "EVE", source_skater_id="b"), appearance(25, 2, "ANN", "category_result", nation_code="BUL"),
            ],
            "category_results": [dict(id=1, category_id=200, skater_appearance_id=25, final_place=1, points=D("90.96"), segment_places={"SP": 2})],
            "segment_results": [dict(id=1, segment_id=2000, skater_appearance_id=21, tss=D("1.000")), dict(id=2, segment_id=2000, skater_appearance_id=23, tss=None, tes=D("5.000"), pcs=D("0.000")), dict(id=3, segment_id=4000, skater_appearance_id=41, tss=D("12.500"), tes=D("6.000"), pcs=D("6.500")), dict(id=4, segment_id=4000, skater_appearance_id=43, tss=D("7.000")), dict(id=5, segment_id=1000, skater_appearance_id=11, tss=D("9.000"))],
            "pdf_score_summaries": [dict(id=1, segment_id=2000, skater_appearance_id=22, total_segment_score=D("10.000"), total_element_score=D("5.000"), total_program_component_score=D("6.000"), total_deductions=D("1.000")), dict(id=2, segment_id=4000, skater_appearance_id=42, total_segment_score=D("8.000"), total_element_score=D("3.000"), total_program_component_score=D("4.000"))],
            "pdf_elements": [dict(id=1, pdf_score_summary_id=1, element_no=1, element_code="3T<<", base_element_code="3T", raw_element="3T<<", markers=["<<"]), dict(id=2, pdf_score_summary_id=1, element_no=2, element_code="2A!", base_element_code=None, raw_element="2A!", markers=[])],
            "pdf_element_judge_scores": [dict(id=1, pdf_element_id=1, judge_number=1, score=-3)],
            "pdf_program_components": [dict(id=1, pdf_score_summary_id=1, component_name="Composition", factor=D("1.670"), score=D("7.670"))],
            "official_assignments": [dict(id=1, segment_id=2000, function_text="Judge No.1", role_group="judge", judge_number=1, name="J")],
            "clubs": [dict(club_id="c", canonical_name="Elit", status="active")],
            "club_aliases": [dict(alias_name="Elit", alias_normalized="elit", club_id="c"), dict(alias_name="none", alias_normalized="none", club_id="c")],
        }.items()
    }
    return out


def test_latest_runs_and_dates(t):
    assert {r.import_run_id for r in V.v_latest_import_runs(t).collect()} == {2, 4}
    assert {(r.event_id, str(r.event_start_date), r.event_type) for r in V.v_events(t).collect()} == {(20, "2013-11-29", "national"), (40, "2014-11-26", "national")}


def test_appearances(t):
    out = {r.skater_appearance_id: r for r in V.v_skater_appearances_clean(t).collect()}
    assert set(out) == {21, 22, 23, 25, 41, 42, 43} and out[21].club_name is None and out[21].display_affiliation == "BUL"


def test_sheets_are_preferred(t):
    out = {(r.score_source[:4], r.score_id) for r in V.v_skater_segment_scores(t).collect()}
    assert out == {("pdf_", 1), ("pdf_", 2), ("html", 2), ("html", 3), ("html", 4)}  # ids of EVE conflict, so both stay


def test_progression(t):
    out = {(r.skater_name, r.score_id): r for r in V.v_skater_progression(t).collect()}
    ann = out["ANN", 3]
    assert (ann.previous_tss_same_segment, ann.tss_delta_same_segment) == (D("10.000"), D("2.500")) and out["ANN", 1].tss_delta_same_segment is None


def test_summaries(t):
    out = {(r.club_name, r.skater_name): r for r in V.v_club_skater_summary(t).collect()}
    assert out["(empty club)", "ANN"].competitions == 2 and out["(empty club)", "ANN"].event_types_seen == ["national"] and out["  Elit ", "BOB"].best_score_total == D("5.000")
    q = V.v_data_quality_representation(t).first()
    assert (q.appearances, q.non_iso_nation_codes, q.with_club, q.club_primary_empty_club) == (7, 1, 1, 6)


def test_clubs(t):
    out = {r.alias_name: r for r in V.v_club_alias_usage(t).collect()}
    assert (out["Elit"].imported_appearance_count, out["Elit"].event_count, out["none"].imported_appearance_count) == (1, 1, 0)
    assert {r.skater_name: r.canonical_club_name for r in V.v_skater_appearances_with_club(t).collect()}["BOB"] == "Elit"
    assert V.v_skater_category_results_with_club(t).first().canonical_club_name is None
    assert mart.dim_club(t).first().aliases == ["Elit", "none"]


def test_mart(t):
    skaters = mart.dim_skater(t).orderBy("skater_key").collect()
    assert [(r.skater_key, r.skater_name) for r in skaters] == [(1, "ANN"), (2, "BOB"), (3, "EVE")]
    facts = mart.fact_segment_score(t).collect()
    assert len(facts) == V.v_skater_segment_scores(t).count() and all(r.skater_key for r in facts)
    assert {(r.element_code, r.element_key) for r in mart.fact_element_score(t).collect()} == {("3T<<", 1), ("2A!", 2)}
    assert mart.fact_element_judge_mark(t).first().skater_key == 1 and mart.fact_component_score(t).count() == 1
    assert mart.fact_competition_result(t).first().skater_key == 1
    assert {r.skater_name: r.best_tss for r in mart.v_skater_personal_bests(t).collect()}["ANN"] == D("12.500")
    assert mart.v_skater_source_evidence(t).count() == 7 and mart.dim_source_document(t).count() == 3
    assert {r.skating_season for r in mart.dim_date(t).collect()} == {"2013/2014", "2014/2015"}
    for name, view in mart.VIEWS.items():
        assert view(t).columns, name


def test_reports(t, spark):
    assert [r.run_ids for r in quality.duplicate_runs(t).collect()] == [[2, 1]]
    assert [r.nation_code for r in quality.nonconforming_nations(t).collect()] == ["Elit"]
    assert quality.nonconforming_nation_summary(t).first().skaters == 1
    assert {r.validation_status[:18] for r in quality.club_primary_without_club(t).collect()} == {"review: empty club"}
    assert quality.missing_results(t).count() == 0 and quality.bad_names(t).count() == 1
    assert quality.results_without_score(t).count() == 0 and quality.points_as_segment(t).count() == 0
    assert [r.id for r in quality.score_mismatches(t["pdf_score_summaries"]).collect()] == [2]
    assert [r.id for r in quality.unparsed_markers(t).collect()] == [2] and quality.downgraded(t).count() == 1 and quality.marker_usage(t).first().marker == "<<"
    assert quality.constraint_violations(t).count() == 0 and quality.sheet_count_mismatches(t).count() == 2
    report = quality.run_report(t, 2)
    assert {r.label: r["rows"] for r in report["counts"].collect()}["segment_results"] == 2
    assert report["missing_segment_officials"].count() == 0 and report["pdf_without_elements"].count() == 0
    assert {r.skater_name for r in quality.segment_comparison(t).where("tss_delta IS NOT NULL").collect()} == {"ANN"}
    assert quality.category_comparison(t).count() == 0 and quality.multi_competition_skaters(t).first().skater_name == "ANN"
    assert quality.evidence_coverage(t).first().with_document == 7 and quality.missing_best_scores(t).count() == 1
    for check in (quality.latest_runs, quality.identity_collisions, quality.club_fragments, quality.club_primary_without_club_by_nation, quality.affiliation_summary, quality.representation_buckets, quality.nation_primary_with_club, quality.profile_settings, quality.mart_counts, quality.archive_counts, quality.catalog_counts, quality.residue, quality.officials_by_role, quality.issues_by_code, quality.source_graph):
        check(t).collect()
    assert quality.documents_with_layout(t, ["Club", "Nation"]).count() == 0


def test_cascade_leaves_no_orphans(t):
    dead = t["import_runs"].where("id IN (1, 3)").select("id")
    tables = {n: df for n, df in t.items() if "id" in df.columns or n in ("parse_issues",)}
    tables = {n: (df if "id" in df.columns else df.withColumn("id", F.lit(0).cast("long"))) for n, df in tables.items()}
    after = cascade_delete(tables, dead)
    gone = {r.label: r.removed for r in removed_counts(tables, after).collect()}
    assert gone["import_runs"] == 2 and gone["events"] == 1 and gone["segment_results"] == 1 and gone["pdf_elements"] == 0 and gone["source_skater_appearances"] == 1
    assert after["segments"].join(after["categories"], F.col("category_id") == after["categories"].id, "left_anti").count() == 0
