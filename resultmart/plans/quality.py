"""Data-quality checks and audit reports. Each gives a DataFrame; for checks, no rows mean that all is well."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.functions.arrays import agg_ordered
from resultmart.functions.text import blank_to_null, choose_by, has_header_sequence, has_key, has_marker, has_suffix, lower_fragment, missing_or_zero, not_iso3
from resultmart.operators.aggregate import labelled_counts
from resultmart.operators.joins import prefer_source
from resultmart.operators.latest import latest_per_key, top
from resultmart.plans import analytics as V
from resultmart.plans import mart
from resultmart.sources.tables import written

Tables = dict[str, DataFrame]
WHERE = ["event_start_date", "event_name", "root_url", "category_name", "skater_name", "nation_code", "club_name"]
LISTED = ("entry", "category_result")
OLD, NEW = "old_isucalcfs", "fs_manager"


def _latest(t: Tables) -> DataFrame:
    return latest_per_key(t["import_runs"], ["root_url"], ["id"], F.col("status") == "completed").select(F.col("id").alias("import_run_id"), "root_url")


def _segments(t: Tables) -> DataFrame:
    """Segments with category, event and run."""
    s = t["segments"].select(F.col("id").alias("segment_id"), "category_id", F.col("name").alias("segment_name"))
    c = t["categories"].select(F.col("id").alias("category_id"), "event_id", F.col("name").alias("category_name"))
    return s.join(c, "category_id").join(t["events"].select(F.col("id").alias("event_id"), "import_run_id"), "event_id")


def duplicate_runs(t: Tables) -> DataFrame:
    """Q1: URLs with several completed runs."""
    return t["import_runs"].where("status = 'completed'").groupBy("root_url").agg(F.count("*").alias("completed_runs"), F.reverse(agg_ordered(F.col("id"), F.col("id"))).alias("run_ids")).where("completed_runs > 1")


def latest_runs(t: Tables) -> DataFrame:
    """Q2."""
    return _latest(t)


def identity_collisions(t: Tables) -> DataFrame:
    """Q3: events with the same name and dates from several URLs."""
    key = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(f"{c}_key") for c in ("event_name", "date_range")]
    return V.v_events(t).groupBy(*key).agg(F.count_distinct("root_url").alias("urls"), agg_ordered(F.col("root_url"), distinct=True).alias("root_urls"), agg_ordered(F.col("event_id"), F.col("event_id")).alias("event_ids")).where("urls > 1")


def nonconforming_nations(t: Tables, limit: int = 200) -> DataFrame:
    """Q4: rows whose nation isn't three capitals."""
    return top(V.v_skater_appearances_clean(t).where(not_iso3(F.col("nation_code"))).select(*WHERE, "profile_key", "skater_appearance_id", "raw"), [F.col("event_start_date").asc_nulls_last(), F.asc("skater_name")], limit, ["skater_appearance_id"])


def nonconforming_nation_summary(t: Tables, limit: int = 50) -> DataFrame:
    """Q4, counted."""
    found = V.v_skater_appearances_clean(t).where(not_iso3(F.col("nation_code"))).groupBy("nation_code")
    return top(found.agg(F.count_distinct("skater_name").alias("skaters"), F.count_distinct("event_id").alias("events"), agg_ordered(F.col("profile_key"), distinct=True).alias("profiles")), [F.desc("skaters"), F.desc("events")], limit, ["nation_code"])


def club_fragments(t: Tables, limit: int = 200) -> DataFrame:
    """Q5: clubs of three small letters, pieces of a file name."""
    found = V.v_skater_appearances_clean(t).where((F.col("parser_profile") == NEW) & lower_fragment(F.col("club_name")))
    return top(found.select(*WHERE, "skater_appearance_id", F.element_at("raw", F.lit("club")).alias("raw_club")), [F.asc("club_name"), F.asc("skater_name")], limit, ["skater_appearance_id"])


def _appearances(t: Tables) -> DataFrame:
    """Entries and results of all runs with their profile."""
    p = t["source_profiles"].select(F.col("id").alias("source_profile_id"), "profile_key", "representation_primary")
    e = t["events"].select(F.col("id").alias("event_id"), F.col("import_run_id").alias("event_run_id"), "source_profile_id").join(p, "source_profile_id", "left")
    c = t["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return t["source_skater_appearances"].where(F.col("appearance_type").isin(*LISTED)).join(e, "event_id").join(c, "category_id", "left")


def club_primary_without_club(t: Tables, limit: int = 200) -> DataFrame:
    """Q6: rows that should have a club, with what a reviewer should look at. The two texts of the review."""
    found = _appearances(t).where((F.col("representation_primary") == "club") & (F.coalesce("club_name", F.lit("")) == ""))
    status = choose_by([(F.coalesce("representation_value", F.lit("")) != "", "review: empty club but representation_value is filled")], "review: empty club, possible individual/unknown/empty source value")
    return top(found.select("event_run_id", "profile_key", "category_name", "appearance_type", "raw_name", "nation_code", "representation_value", status.alias("validation_status"), "id"), [F.asc("event_run_id"), F.asc("category_name"), F.asc("raw_name")], limit, ["id"])


def club_primary_without_club_by_nation(t: Tables) -> DataFrame:
    """Q6, counted."""
    return _appearances(t).where((F.col("representation_primary") == "club") & (F.coalesce("club_name", F.lit("")) == "")).groupBy("event_run_id", "profile_key", "nation_code").agg(F.count("*").alias("appearances"))


def affiliation_summary(t: Tables) -> DataFrame:
    """Q7: by profile and source."""
    a, club = V.v_skater_appearances_clean(t), F.col("club_name")
    return a.groupBy("event_type", "competition_level", "competition_stream", "profile_key", "root_url").agg(
        F.count("*").alias("appearances"), F.count("nation_code").alias("with_country"), F.count("club_name").alias("with_club"), F.count_if(not_iso3(F.col("nation_code"))).alias("non_iso_country_values"),
        F.count_if((F.col("parser_profile") == NEW) & lower_fragment(club)).alias("lowercase_three_char_clubs"), F.count_if((F.col("representation_primary") == "club") & club.isNull()).alias("club_primary_missing_club"),
    )


def representation_buckets(t: Tables) -> DataFrame:
    """Q8."""
    state = choose_by([(F.coalesce("club_name", F.lit("")) == "", "missing_club")], "has_club").alias("club_state")
    return _appearances(t).groupBy("event_run_id", "profile_key", "appearance_type", state, "representation_type").agg(F.count("*").alias("appearances"), F.count_distinct("nation_code").alias("nations"), F.count_distinct(blank_to_null(F.col("club_name"))).alias("clubs"))


def nation_primary_with_club(t: Tables, limit: int = 200) -> DataFrame:
    """Q9."""
    found = _appearances(t).where((F.coalesce("representation_primary", F.lit("nation")) == "nation") & (F.coalesce("club_name", F.lit("")) != ""))
    return top(found.select("event_run_id", "profile_key", "category_name", "raw_name", "nation_code", "club_name", "id"), [F.asc("event_run_id"), F.asc("profile_key"), F.asc("category_name"), F.asc("raw_name")], limit, ["id"])


def profile_settings(t: Tables) -> DataFrame:
    """Q10."""
    return t["source_profiles"].select("profile_key", "parser_profile", "competition_stream", "representation_primary", "settings").orderBy("profile_key")


def missing_results(t: Tables) -> DataFrame:
    """Q11: segments of latest runs without a score sheet, by whether anybody entered."""
    sheets = t["pdf_score_summaries"].groupBy("segment_id").agg(F.count("*").alias("pdf_summary_count"))
    entries = t["source_skater_appearances"].groupBy("category_id").agg(F.count_if(F.col("appearance_type") == "entry").alias("entry_count"))
    urls = t["segments"].select(F.col("id").alias("segment_id"), "judges_scores_pdf_url")
    out = _segments(t).join(_latest(t), "import_run_id").join(urls, "segment_id").join(sheets, "segment_id", "left").join(entries, "category_id", "left").fillna(0, ["entry_count", "pdf_summary_count"])
    state = choose_by([(F.col("entry_count") == 0, "empty_category")], "missing_results_with_entries").alias("classification")
    return out.where("pdf_summary_count = 0").select("import_run_id", "root_url", "category_name", "segment_name", "entry_count", "pdf_summary_count", state, "judges_scores_pdf_url")


def bad_names(t: Tables) -> DataFrame:
    """Q12: blank names and those that are a qualification mark."""
    a = t["source_skater_appearances"].join(_latest(t), "import_run_id")
    return a.where((F.coalesce("normalized_name", F.lit("")) == "") | (F.col("normalized_name") == "Q")).select("import_run_id", "root_url", "id", "appearance_type", "raw_name", "normalized_name", F.element_at("raw", F.lit("name")).alias("raw_source_name"))


def results_without_score(t: Tables, limit: int = 200) -> DataFrame:
    """Q13."""
    found = V.v_skater_category_results(t).where(F.col("final_place").isNull() | F.col("points").isNull())
    return top(found.select(*WHERE, "final_place", "points", "skater_appearance_id"), [F.col("event_start_date").asc_nulls_last(), F.asc("event_name"), F.asc("category_name")], limit, ["skater_appearance_id"])


def documents_with_layout(t: Tables, headers: Sequence[str], url_pattern: str | None = None, parser: str = OLD) -> DataFrame:
    """Q14: latest runs with documents whose tables have these headers in this order."""
    docs = t["source_documents"].select("import_run_id", "url", "raw_text", "source_profile_id").join(_latest(t), "import_run_id").join(t["source_profiles"].where(F.col("parser_profile") == parser).select(F.col("id").alias("source_profile_id"), "profile_key"), "source_profile_id")
    if url_pattern:
        docs = docs.where(F.col("url").rlike(url_pattern))
    return docs.where(has_header_sequence(F.col("raw_text"), [f">{h}" for h in headers])).groupBy("import_run_id", "root_url", "profile_key").agg(F.count("*").alias("documents"))


def points_as_segment(t: Tables) -> DataFrame:
    """Q15: points mistaken for a segment's place."""
    return V.v_skater_category_results(t).where(has_key(F.col("segment_places"), "Points")).select(*WHERE, "final_place", "points", "segment_places")


def missing_best_scores(t: Tables) -> DataFrame:
    """Q16."""
    return V.v_club_skater_summary(t).where(missing_or_zero(F.col("best_tss"), F.col("best_score_total"), F.col("best_pcs")))


def mart_counts(t: Tables) -> DataFrame:
    """Q17: rows of the mart."""
    return labelled_counts(**{n: f(t) for n, f in mart.VIEWS.items() if n.startswith(("dim_", "fact_")) or n in ("v_skater_personal_bests", "v_skater_source_evidence")})


def archive_counts(t: Tables) -> DataFrame:
    """Q17: archived files by state and kind."""
    return t["source_archive_files"].groupBy("archive_status", "document_type").agg(F.count("*").alias("source_documents"))


def catalog_counts(t: Tables) -> DataFrame:
    """Q17: events of the discovery catalog by source, state and country."""
    return t["event_discovery_catalog"].groupBy("source_name", "discovery_status", "country_code").agg(F.count("*").alias("events"))


def evidence_coverage(t: Tables) -> DataFrame:
    """Q17: how much of the evidence has a document and an archived file."""
    return mart.v_skater_source_evidence(t).agg(F.count("*").alias("rows"), F.count("source_document_key").alias("with_document"), F.count("archive_path").alias("with_archive"))


#: Clubs that stand at the end of a name where a page ran both together.
CLUB_SUFFIXES = ("VARNA", "ELIT", "LEDENI ISKRI", "ICE PEAK", "DANCE ON ICE DS")


def residue(t: Tables, suffixes: Sequence[str] = CLUB_SUFFIXES) -> DataFrame:
    """Q17: segment scores whose name ends in a club, whose nation is no code, or whose club is a code without a nation."""
    nation, club = F.col("nation_code"), F.col("club_name")
    counts = {"likely_club_suffix_names": has_suffix(F.col("skater_name"), list(suffixes)), "non_iso_nation_codes": not_iso3(nation), "iso_code_as_club_no_nation": ~not_iso3(club) & nation.isNull()}
    return V.v_skater_segment_scores(t).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def run_report(t: Tables, run_id: int) -> dict[str, DataFrame]:
    """Q18: counts, issues, segments without officials, and segments whose sheets have no elements."""
    seg = _segments(t).where(F.col("import_run_id") == run_id)
    own = lambda n: t[n].where(F.col("import_run_id") == run_id)
    below = lambda n: t[n].join(seg.select("segment_id"), "segment_id", "left_semi")
    categories = t["categories"].join(own("events").select(F.col("id").alias("event_id")), "event_id", "left_semi")
    results = t["category_results"].join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    counts = labelled_counts(**{n: own(n) for n in ("events", "source_documents", "parse_issues", "source_skater_appearances")}, categories=categories, segments=seg, category_results=results, **{n: below(n) for n in ("segment_results", "official_assignments", "pdf_score_summaries")})
    sheets = below("pdf_score_summaries").select("segment_id", F.col("id").alias("pdf_score_summary_id"))
    elements = t["pdf_elements"].groupBy("pdf_score_summary_id").agg(F.count("*").alias("elements"))
    empty = sheets.join(elements, "pdf_score_summary_id", "left").groupBy("segment_id").agg(F.count("*").alias("summaries"), F.coalesce(F.sum("elements"), F.lit(0)).alias("elements")).where("elements = 0")
    return {
        "counts": counts,
        "issues": own("parse_issues").groupBy("level", "code").agg(F.count("*").alias("count")),
        "missing_segment_officials": seg.join(t["official_assignments"].select("segment_id"), "segment_id", "left_anti").select("category_name", "segment_name"),
        "pdf_without_elements": seg.join(empty, "segment_id").select("category_name", "segment_name", "summaries"),
    }


def index_issues(index: DataFrame, schedule: DataFrame) -> DataFrame:
    """Q19: an index page whose categories or segments lack a link, repeat one, or aren't in its schedule.

    ``index`` has doc_id, kind (``category`` or ``segment``), category, segment and the links entries, result, officials,
    details and judges_scores; ``schedule`` has doc_id, category and segment.
    """
    columns = ["doc_id", "level", "code", "category", "segment"]

    def missing(kind: str, link: str, level: str) -> DataFrame:
        rows = index.where((F.col("kind") == kind) & F.col(link).isNull())
        return rows.select("doc_id", F.lit(level).alias("level"), F.lit(f"missing_{kind}_{link}").alias("code"), "category", "segment")

    parts = [missing("category", c, "error") for c in ("entries", "result")] + [missing("segment", c, "error" if c == "details" else "warning") for c in ("officials", "details", "judges_scores")]
    links = index.select("doc_id", F.explode(F.filter(F.array("entries", "result", "officials", "details", "judges_scores"), lambda x: x.isNotNull())).alias("link"))
    repeated = links.groupBy("doc_id", "link").agg(F.count("*").alias("n")).where("n > 1")
    parts.append(repeated.select("doc_id", F.lit("warning").alias("level"), F.lit("duplicate_link").alias("code"), F.col("link").alias("category"), F.lit(None).cast("string").alias("segment")))
    known = index.where("kind = 'segment'").select("doc_id", "category", "segment").distinct()
    parts.append(schedule.join(known, ["doc_id", "category", "segment"], "left_anti").select("doc_id", F.lit("warning").alias("level"), F.lit("schedule_not_in_index").alias("code"), "category", "segment"))
    return reduce(DataFrame.unionByName, [p.select(columns) for p in parts])


def score_mismatches(sheets: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """Q20: totals that neither the sum nor the average of their parts explains."""
    limit = F.lit(tolerance).cast("decimal(4,2)")
    parts = F.coalesce("total_element_score", F.lit(0)) + F.coalesce("total_program_component_score", F.lit(0))
    d, total = F.coalesce("total_deductions", F.lit(0)), F.col("total_segment_score")
    near = lambda c: F.abs(total - c) <= limit
    return sheets.where(~(near(parts - d) | near(parts / 2 - d)))


def marker_usage(t: Tables) -> DataFrame:
    """Q21: markers by run."""
    runs = V.v_skater_elements(t).select("import_run_id", "root_url", F.explode("markers").alias("marker"))
    return runs.groupBy("import_run_id", "root_url", "marker").agg(F.count("*").alias("elements"))


def downgraded(t: Tables, limit: int = 25) -> DataFrame:
    """Q21: examples."""
    e = V.v_skater_elements(t).where(has_marker(F.col("markers"), "<<"))
    return top(e.select("root_url", "skater_name", "element_no", "element_code", "markers", "base_value", "panel_score", "element_id"), [F.asc("skater_name"), F.asc("element_no")], limit, ["element_id"])


def unparsed_markers(t: Tables, marks: Sequence[str] = ("<<", "<", "!", "*")) -> DataFrame:
    """Q21: markers in a code that the markers column lacks."""
    lost = reduce(Column.__or__, [F.col("element_code").contains(m) & ~has_marker(F.col("markers"), m) for m in marks])
    return t["pdf_elements"].where(lost & ~(F.col("element_code").contains("<<") & has_marker(F.col("markers"), "<<"))).select("id", "element_code", "markers")


def officials_by_role(t: Tables) -> DataFrame:
    """Q22."""
    return t["official_assignments"].groupBy("role_group").agg(F.count("*").alias("assignments"), F.count_if(F.col("judge_number").isNotNull()).alias("with_number"), F.count_distinct("name").alias("people"))


def issues_by_code(t: Tables) -> DataFrame:
    """Q22."""
    return t["parse_issues"].groupBy("import_run_id", "level", "code").agg(F.count("*").alias("issues"))


def multi_competition_skaters(t: Tables, min_competitions: int = 2, sample: int = 25) -> DataFrame:
    """Q23."""
    a = V.v_skater_appearances_clean(t)
    found = a.groupBy("skater_name", "nation_code").agg(
        F.count_distinct("event_id").alias("competitions"), F.count_distinct("category_name").alias("categories"), F.count_distinct(F.when(F.col("appearance_type") == "category_result", F.col("event_id"))).alias("with_results"),
        agg_ordered(F.col("club_name"), distinct=True).alias("clubs"), F.min("date_range").alias("first_date_text"),
    ).where(F.col("competitions") >= min_competitions)
    return top(found, [F.desc("competitions")], sample, ["skater_name", "nation_code"])


def category_comparison(t: Tables, min_competitions: int = 2) -> DataFrame:
    """Q23: points against the time before, by name, nation and category, in the order of the dates' text."""
    r = V.v_skater_category_results(t)
    many = r.groupBy("skater_name", "nation_code").agg(F.count_distinct("event_id").alias("n")).where(F.col("n") >= min_competitions)
    many = many.select(F.col("skater_name").alias("_s"), F.col("nation_code").alias("_n"))
    w = Window.partitionBy("skater_name", "nation_code", "category_name").orderBy(*[F.col(c).asc_nulls_last() for c in ("date_range", "event_name", "root_url", "skater_appearance_id")])
    out = r.join(many, F.col("skater_name").eqNullSafe(F.col("_s")) & F.col("nation_code").eqNullSafe(F.col("_n")), "left_semi")
    return out.withColumns({"previous_points": F.lag("points").over(w), "points_delta": F.col("points") - F.lag("points").over(w)})


def segment_comparison(t: Tables, min_competitions: int = 2) -> DataFrame:
    """Q23: the same for segment scores, where a sheet replaces a page's row of the same name and nation."""
    who = V.v_skater_appearances_clean(t).select("skater_appearance_id", "skater_name", "nation_code", "event_id", "event_name", "root_url", "date_range", "segment_name")
    tss = lambda n, c: t[n].select(F.col("id").alias("score_id"), F.col("segment_id").alias("_segment"), "skater_appearance_id", F.col(c).alias("tss")).join(who, "skater_appearance_id")
    s = prefer_source(tss("pdf_score_summaries", "total_segment_score"), tss("segment_results", "tss"), ["_segment", "skater_name"], null_safe=["nation_code"]).drop("_segment")
    many = s.groupBy("skater_name", "nation_code").agg(F.count_distinct("event_id").alias("n")).where(F.col("n") >= min_competitions).select(F.col("skater_name").alias("_s"), F.col("nation_code").alias("_n"))
    w = Window.partitionBy("skater_name", "nation_code", "segment_name").orderBy(*[F.col(c).asc_nulls_last() for c in ("date_range", "event_name", "root_url", "score_id")])
    out = s.join(many, F.col("skater_name").eqNullSafe(F.col("_s")) & F.col("nation_code").eqNullSafe(F.col("_n")), "left_semi")
    return out.withColumns({"previous_tss": F.lag("tss").over(w), "tss_delta": F.col("tss") - F.lag("tss").over(w)})


def sheet_count_mismatches(t: Tables) -> DataFrame:
    """Q24: segments with sheets for another number of skaters than have results."""
    n = lambda table, name: t[table].groupBy("segment_id").agg(F.count("*").alias(name))
    both = n("pdf_score_summaries", "sheets").join(n("segment_results", "results"), "segment_id", "full").fillna(0, ["sheets", "results"])
    return both.where("sheets <> results AND sheets > 0")


#: Values that columns may have.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("import_runs", "status"): ("started", "completed", "failed"),
    ("parse_issues", "level"): ("info", "warning", "error"),
    ("source_skater_appearances", "appearance_type"): ("entry", "category_result", "segment_result", "pdf_score"),
    ("source_archive_files", "archive_status"): ("written", "skipped"),
    ("source_url_registry", "status"): ("pending", "analyzed", "ready_for_import", "imported", "skipped", "failed"),
    ("source_url_registry", "validation_status"): ("not_checked", "passed", "warning", "failed"),
}
#: Columns that identify a row.
UNIQUE: dict[str, tuple[str, ...]] = {
    "source_profiles": ("profile_key",),
    "source_documents": ("import_run_id", "url"),
    "events": ("import_run_id", "source_url"),
    "categories": ("event_id", "name"),
    "segments": ("category_id", "source_order"),
    "official_assignments": ("segment_id", "function_text", "name", "nation_code"),
    "pdf_element_judge_scores": ("pdf_element_id", "judge_number"),
    "pdf_component_judge_scores": ("pdf_program_component_id", "judge_number"),
    "club_aliases": ("alias_normalized",),
    "source_url_registry": ("url",),
}


#: Columns that name a row of another table by its id.
REFERENCES: dict[tuple[str, str], tuple[str, str]] = {
    ("source_documents", "import_run_id"): ("import_runs", "id"),
    ("events", "import_run_id"): ("import_runs", "id"),
    ("categories", "event_id"): ("events", "id"),
    ("segments", "category_id"): ("categories", "id"),
    ("category_results", "category_id"): ("categories", "id"),
    ("segment_results", "segment_id"): ("segments", "id"),
    ("official_assignments", "segment_id"): ("segments", "id"),
    ("pdf_elements", "pdf_score_summary_id"): ("pdf_score_summaries", "id"),
    ("pdf_element_judge_scores", "pdf_element_id"): ("pdf_elements", "id"),
    ("pdf_program_components", "pdf_score_summary_id"): ("pdf_score_summaries", "id"),
    ("pdf_component_judge_scores", "pdf_program_component_id"): ("pdf_program_components", "id"),
    ("club_aliases", "club_id"): ("clubs", "club_id"),
}


def _key_text(key: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])


def _rules(t: Tables, references: bool) -> dict[str, list[tuple[str, str, int, Column]]]:
    """By table: (rule, its table, kind, value) of what one scan of it has to look at. Kinds: 0 outside a domain, 1 a key, 2 a reference, 3 what may be referred to."""
    found: dict[str, list] = {name: [] for name in t}
    for (name, column), values in DOMAINS.items():
        if name in t:
            found[name].append((f"domain of {column}", name, 0, F.when(~F.col(column).isin(*values), F.col(column))))
    for name, key in UNIQUE.items():
        if name in t:
            found[name].append(("unique " + ", ".join(key), name, 1, _key_text(key)))
    for (name, column), (parent, ids) in REFERENCES.items() if references else ():
        if name in t and parent in t:
            rule = f"{column} in {parent}"
            found[name].append((rule, name, 2, F.col(column).cast("string")))
            found[parent].append((rule, name, 3, F.col(ids).cast("string")))
    return {name: rules for name, rules in found.items() if rules}


def _looked_at(df: DataFrame, rules: list[tuple[str, str, int, Column]]) -> DataFrame:
    """A row for each rule and row of a table: rule, table, kind, value; those without a value say nothing."""
    parts = [F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("table"), F.lit(kind).alias("kind"), value.alias("value")) for rule, name, kind, value in rules]
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("value IS NOT NULL")


def constraint_violations(t: Tables, references: bool = False) -> DataFrame:
    """Q25: values outside their domain, repeated keys and, with ``references``, ids that name no row: table, rule, value, rows.

    Each table is scanned once for all of its rules. What is looked at goes on as two hashes and is counted by them, so
    a scan's rows shrink before they are shuffled. Only tables and rules with a suspect are read again, for the values
    themselves, which are then counted exactly. Tables that aren't there are left out.
    """
    rules = _rules(t, references)
    parts = [_looked_at(t[name], held).select("rule", "table", "kind", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(7), "value").alias("h2")) for name, held in rules.items()]
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = reduce(DataFrame.unionByName, parts).groupBy("rule", "table", "h1", "h2").agg(n(0).alias("outside"), n(1).alias("keys"), n(2).alias("naming"), n(3).alias("named"))
    suspects = written(counted.where("outside > 0 OR keys > 1 OR (naming > 0 AND named = 0)").select("rule", "table", "h1", "h2"), "suspects")
    wanted = {(r.rule, r.table) for r in suspects.select("rule", "table").distinct().collect()}  # at most one for each rule
    again = {name: [x for x in held if x[2] < 3 and (x[0], x[1]) in wanted] for name, held in rules.items()}
    values = [_looked_at(t[name], held) for name, held in again.items() if held]
    if not values:
        return suspects.select("table", "rule", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("rows")).limit(0)
    seen = reduce(DataFrame.unionByName, values).withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(7), "value")}).join(suspects, ["rule", "table", "h1", "h2"], "left_semi")
    return seen.groupBy("table", "rule", "kind", "value").agg(F.count("*").alias("rows")).where("kind <> 1 OR rows > 1").select("table", "rule", "value", "rows")


def source_graph(t: Tables) -> DataFrame:
    """Q26: per segment its roles, people and judges."""
    o = t["official_assignments"].groupBy("segment_id").agg(F.count("*").alias("officials"), F.count_distinct("name").alias("people"), F.count_distinct("role_group").alias("roles"), F.max("judge_number").alias("judges"))
    return _segments(t).join(o, "segment_id", "left").fillna(0, ["officials", "people", "roles"])
