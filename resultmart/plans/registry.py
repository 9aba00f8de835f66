"""Representation rules, and the pipelines around imports: registry, discovery, archive, load."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from resultmart.functions.arrays import merge_map
from resultmart.functions.text import ISO3, archive_path, blank_to_null, catalog_kind, choose_by, content_hash, document_type, keep_imported, normalize_name, raw_path, split_sheet_title, url_host
from resultmart.operators.joins import longest_prefix_join
from resultmart.operators.latest import latest_per_key
from resultmart.operators.maintenance import Rule, apply_rules, close_run, guard, issue_rows, upsert
from resultmart.plans import pages, sheets
from resultmart.sources.schemas import TABLES
from resultmart.sources.tables import written


#: The levels of issues.
LEVELS = ["error", "warning", "info"]


def _blank() -> Column:
    return F.lit(None).cast("string")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _no_nation(c: str = "nation_code") -> Column:
    return _filled(c) & ~F.col(c).rlike(ISO3)


def normalize_representation(rows: DataFrame) -> DataFrame:
    """Add representation_type and representation_value and move misplaced affiliations.

    ``rows`` has nation_code, club_name, and the profile's representation_primary and nation_column. In a club-primary
    source whose nation column holds clubs, a nation that is no code becomes the club of a row without one; any other
    nation that is no code goes. The type follows the profile; a club's value is the club as it came in, or null.
    """
    club_primary = F.col("representation_primary") == "club"
    moved = club_primary & _no_nation() & ~_filled("club_name") & (F.col("nation_column") == "club")
    dropped = club_primary & _no_nation() & ~moved
    note = F.when(moved, "nation column held a club").when(dropped, "nation is not a code")
    out = {
        "club_name": F.when(moved, F.col("nation_code")).otherwise(F.col("club_name")),
        "nation_code": F.when(moved | dropped, _blank()).otherwise(F.col("nation_code")),
        "representation_type": F.when(club_primary, "club").otherwise("nation"),
        "representation_value": blank_to_null(F.when(moved, F.col("nation_code")).when(club_primary, F.col("club_name")).otherwise(F.col("nation_code"))),
        "representation_note": note,
    }
    return rows.withColumns(out)


def profile_rules(nation_families: Sequence[str], amateur_path: str, federation_host: str, cup_path: str, nation_streams: Sequence[str] = ("ISU", "NonISU", "ISUCS")) -> list[Rule]:
    """The four rules over source profiles (profile_key, host, path_prefix, parser_profile, competition_stream, representation_primary, event_type, competition_level, nation_column, store_nation, store_club, empty_club_policy, discovered)."""
    key, path, stream = F.col("profile_key"), F.col("path_prefix"), F.col("competition_stream")
    cup = path.startswith(cup_path)
    family = choose_by([(key.startswith(x), "y") for x in nation_families]).isNotNull()
    old = F.col("parser_profile") == "old_isucalcfs"
    here, club = F.col("host") == federation_host, F.col("representation_primary") == "club"
    foreign_cup = cup & (stream != "ISU")
    kind = choose_by([(cup, "international")], "national")
    return [
        Rule("nation_primary", family | (F.col("discovered") & stream.isin(*nation_streams) & ~foreign_cup), {"representation_primary": F.lit("nation"), "competition_stream": F.coalesce(stream, F.lit("international")), "event_type": F.lit("international"), "competition_level": F.lit("federated"), "nation_column": F.lit("country"), "store_club": F.lit(False)}),
        Rule("amateur_club", path.startswith(amateur_path), {"representation_primary": F.lit("club"), "competition_stream": F.lit("club_amateur"), "event_type": F.lit("club"), "competition_level": F.lit("amateur"), "empty_club_policy": F.lit("preserve_empty_review")}),
        Rule("federation_old", here & old & club, {"competition_stream": kind, "event_type": kind, "competition_level": F.lit("federated"), "nation_column": F.lit("club"), "store_nation": F.lit(False)}),
        Rule("federation_new", here & ~old & ((club & ~stream.isin(*nation_streams)) | foreign_cup), {"representation_primary": F.lit("club"), "event_type": F.when(cup, "international").otherwise(F.col("event_type")), "competition_level": F.when(cup, "federated").otherwise(F.col("competition_level")), "nation_column": F.lit("country")}),
    ]


def appearance_rules() -> list[Rule]:
    """The four corrections of appearances (with parser_profile, representation_primary and nation_column of their profile)."""
    club, new = F.col("representation_primary") == "club", F.col("parser_profile") == "fs_manager"
    as_club = {"representation_type": F.lit("club"), "representation_value": F.col("nation_code")}
    fragment = F.col("club_name").rlike(r"^[a-z]{3}\z")
    corrected = F.map_contains_key("raw", "nation_not_a_code")
    return [
        Rule("nation_holds_club", (F.col("nation_column") == "club") & _no_nation() & ~_filled("club_name"), {"club_name": F.col("nation_code"), "nation_code": _blank()} | as_club, ["nation_code"]),
        Rule("nation_not_a_code", club & new & (F.coalesce("nation_column", F.lit("country")) == "country") & _no_nation(), {"nation_code": _blank(), "representation_value": blank_to_null(F.col("club_name"))}, ["nation_code"]),
        Rule("club_is_fragment", club & new & fragment & corrected, {"club_name": _blank(), "representation_value": _blank()}, ["club_name"]),
        Rule("club_represents", club & _filled("club_name") & ~(F.col("representation_type").eqNullSafe(F.lit("club")) & F.col("representation_value").eqNullSafe(F.col("club_name"))), {"representation_type": F.lit("club"), "representation_value": F.col("club_name")}),
    ]


def correct_appearances(rows: DataFrame) -> DataFrame:
    return apply_rules(rows, appearance_rules())


def decide_status(candidates: DataFrame) -> DataFrame:
    """R1: states of checked candidates (content_kind, n_categories and, where it is known, imported).

    Fixed values: what can't be parsed is skipped and has failed, a PDF is analyzed with a warning, an index with
    categories has passed and is ready for import unless its URL is imported already.
    """
    imported = F.coalesce(F.col("imported"), F.lit(False)) if "imported" in candidates.columns else F.lit(False)
    pdf = F.col("content_kind").eqNullSafe("pdf")
    passed = F.col("content_kind").eqNullSafe("html") & (F.coalesce("n_categories", F.lit(0)) > 0)
    status = F.when(pdf | (passed & imported), "analyzed").when(passed, "ready_for_import").otherwise("skipped")
    return candidates.withColumns({"status": status, "validation_status": F.when(pdf, "warning").when(passed, "passed").otherwise("failed")})


def register(registry: DataFrame, decided: DataFrame) -> DataFrame:
    """Upsert decisions; imported URLs keep both states, a profile stays, notes are added, summaries merged, the rest is as last decided."""
    held = {c: F.lit(None).cast(kind) for c, kind in registry.dtypes if c not in decided.columns}
    of_imported = lambda old, new: F.when(F.col("_o_status") == "imported", old).otherwise(F.coalesce(new, old))  # noqa: E731  the state before the upsert
    policy = {"family": "coalesce", "status": keep_imported, "validation_status": of_imported, "source_profile_id": lambda old, new: F.coalesce(old, new), "notes": "append", "summary": "merge"}
    return upsert(registry, decided.withColumns(held) if held else decided, ["url"], policy)


def ready_worklist(registry: DataFrame, runs: DataFrame, family: str | None = None, limit: int | None = None) -> DataFrame:
    """R2: URLs that are ready for import, have passed and have no completed run, those of the newer parser first, then by URL.

    ``family`` is a part of the ``source`` that a URL's summary names.
    """
    done = runs.where("status = 'completed'").select(F.col("root_url").alias("url"))
    out = registry.where("status = 'ready_for_import' AND validation_status = 'passed'").join(done, "url", "left_anti")
    if family is not None:
        out = out.where(F.coalesce(F.try_element_at("summary", F.lit("source")), F.lit("")).contains(family))
    out = out.orderBy(F.when(F.col("parser_profile") == "fs_manager", 0).otherwise(1), "url")
    return out if limit is None else out.limit(limit)


def resolve_catalog(catalog: DataFrame, details: DataFrame, refresh: bool = False) -> DataFrame:
    """R3: give events their result URL from the pages that describe them; those whose page is missing need a person.

    Of several details of one page the first result URL counts. A page without a link leaves an event its URL; one that
    has none then waits for it.
    """
    todo = F.col("detail_url").isNotNull() & (F.lit(refresh) | F.col("result_url").isNull())
    found = details.groupBy("detail_url").agg(F.min("result_url").alias("_result"), F.lit(True).alias("_read"))
    out = catalog.join(found, "detail_url", "left")
    result = F.when(todo, F.coalesce("_result", "result_url")).otherwise(F.col("result_url"))
    status = F.when(~todo, F.col("discovery_status")).when(F.col("_read").isNull(), "manual_review").when(result.isNotNull(), "candidate_result_url").otherwise("catalog_only_needs_result_url")
    error = F.when(todo & F.col("_read").isNull(), F.create_map(F.lit("resolve_error"), F.lit("detail page is missing")))
    return out.withColumns({"discovery_status": status, "result_url": result, "metadata": merge_map(F.col("metadata"), error)}).select(catalog.columns)


#: The columns that identify an event of the catalog; null and blank are the same.
CATALOG_KEY = ["source_name", "event_name", "date_range", "city", "country_code", "season"]


def load_catalog(catalog: DataFrame, rows: DataFrame, protect: Sequence[str] = ("registered", "skipped")) -> DataFrame:
    """D2: upsert events by an expression key, with states that stay. Kinds follow from names where there are none."""
    key = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in CATALOG_KEY}
    named = rows.withColumn("kind", F.coalesce("kind", catalog_kind(F.col("event_name"))))
    policy = {c: "coalesce" for c in catalog.columns} | {"discovery_status": guard(*protect), "metadata": "merge"}
    return upsert(catalog.withColumns(key), named.withColumns(key), list(key), policy).select(catalog.columns)


def archive_manifest(documents: DataFrame, runs: DataFrame, latest_only: bool = True) -> DataFrame:
    """R4: every document with its path, hash and whether it can be written; PDFs without a body are skipped.

    ``documents`` has id, import_run_id, url and body; parser_profile, content_hash, parse_status and fetched_at are
    passed on where it has them.
    """
    runs = latest_per_key(runs, ["root_url"], ["id"], F.col("status") == "completed") if latest_only else runs
    docs = documents.join(runs.select(F.col("id").alias("import_run_id"), "root_url"), "import_run_id")
    has = F.coalesce(F.length("body"), F.lit(0)) > 0
    kind = document_type(F.col("url"))
    reason = F.when(~has & (kind == "judges_scores_pdf"), "pdf without a body").when(~has, "no text")
    out = docs.select(
        F.col("id").alias("source_document_id"), "import_run_id", "root_url", "url", kind.alias("document_type"), F.when(has, archive_path(F.col("url"))).alias("archive_path"), F.when(has, content_hash(F.col("body"))).alias("archive_sha256"),
        F.when(has, "written").otherwise("skipped").alias("archive_status"), reason.alias("archive_reason"), *[c for c in ("parser_profile", "content_hash", "parse_status", "fetched_at") if c in docs.columns],
    )
    return shaped(out, "source_archive_files")


def load_manifest(base: DataFrame, manifest: DataFrame) -> DataFrame:
    """R5."""
    rows = manifest.select([F.col(c).cast(kind).alias(c) for c, kind in base.dtypes])
    return upsert(base, rows.where("source_document_id IS NOT NULL"), ["source_document_id"], {})


def attach_profiles(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Give every document the profile of its host with the longest prefix of its path; prefixes have no outer slashes."""
    rows = documents.withColumns({"host": url_host(F.col("url")), "path": F.btrim(raw_path(F.col("url")), F.lit("/"))})
    return longest_prefix_join(rows, profiles.withColumn("path_prefix", F.btrim(F.coalesce("path_prefix", F.lit("")), F.lit("/"))), ["url"], "host", "path", "path_prefix")


def key_of(*columns: str | Column) -> Column:
    """The id of a row from what identifies it, the same in every attempt."""
    return F.xxhash64(*columns)


def segment_rows(index: DataFrame, run: Column) -> DataFrame:
    """Segments of index rows (with folder): folder, category, segment, source_order, segment_id and the urls of their pages.

    Names repeat inside a category, so a segment is known by its place there. Pages that list a name as often as others
    of their folder mean the same segments.
    """
    seen = Window.partitionBy("doc_id", "category", "segment").orderBy("table_no", "row_no")
    rows = index.where("kind = 'segment'").withColumn("nth", F.row_number().over(seen))
    urls = F.array_distinct(F.flatten(F.collect_list(F.array("details.url", "officials.url", "judges_scores.url"))))
    rows = rows.groupBy("folder", "category", "segment", "nth").agg(F.min(F.struct("table_no", "row_no")).alias("at"), F.transform(F.filter(urls, lambda u: u.isNotNull()), bare_url).alias("urls"), F.max("judges_scores").alias("judges_scores"))
    rows = rows.withColumn("source_order", F.row_number().over(Window.partitionBy("folder", "category").orderBy("at", "segment", "nth")))
    return rows.withColumn("segment_id", key_of(run, "folder", "category", "source_order"))


def bare_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def attach_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Give rows of pages (doc_id, folder, category, segment by title) the segment_id, folder and names of the segment that links their page.

    A page that none links takes the one segment of its title in its folder; where there is none or several it has no id.
    """
    linked = segments.select("segment_id", F.col("folder").alias("_folder"), F.col("category").alias("_category"), F.col("segment").alias("_segment"), F.explode("urls").alias("_url")).distinct()
    named = segments.groupBy("folder", "category", "segment").agg(F.when(F.count("*") == 1, F.min("segment_id")).alias("_named"))
    out = rows.join(linked, bare_url(F.col("doc_id")) == F.col("_url"), "left").join(named, ["folder", "category", "segment"], "left")
    held = {"segment_id": F.coalesce("segment_id", "_named")} | {c: F.coalesce(f"_{c}", c) for c in ("folder", "category", "segment")}
    return out.withColumns(held).drop("_url", "_named", "_folder", "_category", "_segment")


def folder_profiles(documents: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """(folder, source_profile_id, representation_primary, nation_column) of the events among the documents (with page_type and folder)."""
    index = documents.where("page_type = 'index'").select("url", "folder")
    if profiles is None:
        return index.select("folder", F.lit(None).cast("long").alias("source_profile_id"), F.lit("nation").alias("representation_primary"), F.lit("country").alias("nation_column")).distinct()
    held = profiles.select("host", "path_prefix", F.col("id").alias("source_profile_id"), "representation_primary", F.col("settings.representation.nation_column").alias("nation_column"))
    found = attach_profiles(index, held).groupBy("folder").agg(F.min_by(F.struct("source_profile_id", "representation_primary", "nation_column"), "url").alias("p"))
    return found.select("folder", "p.source_profile_id", F.coalesce("p.representation_primary", F.lit("nation")).alias("representation_primary"), F.coalesce("p.nation_column", F.lit("country")).alias("nation_column"))


#: How the codes of issues name the types of pages.
PAGES = {"index": "index", "entries": "entry", "category_result": "category_result", "segment_result": "segment_result", "officials": "officials"}


def import_batch(documents: DataFrame, run_id: int, profiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """E20: all documents (url, link_text, body) of one run as rows of the target tables, in one pass over the pages.

    Pages of every event are read together; what a page lacks becomes an issue and stops nothing else. Events are the
    index pages, and pages belong to the index in their folder. Ids are hashes of natural keys; segments are known by
    their place in their category, and pages find theirs by the links of the index. What skaters stand for follows from
    the profile of their event; without ``profiles`` it is the nation.
    """
    docs = pages.route(documents).withColumn("folder", F.regexp_replace("url", r"[^/]*\z", ""))
    html = docs.where("page_type <> 'score_sheet'")
    read = written(pages.read_pages(html), "cells").join(html.select(F.col("url").alias("doc_id"), "page_type", "folder"), "doc_id")
    unread = pages.page_issues(read, F.concat(F.element_at(F.create_map(*[F.lit(x) for pair in PAGES.items() for x in pair]), F.col("page_type")), F.lit("_page_parse_failed")))
    found = read.where("kind <> 'error'")
    of = lambda kind: found.where(F.col("page_type") == kind)
    folders = html.select(F.col("url").alias("doc_id"), "folder")
    run = F.lit(run_id).cast("long")
    doc = key_of(run, F.col("doc_id")).alias("source_document_id")

    events = pages.event_rows(of("index")).join(folders, "doc_id").select(key_of(run, "folder").alias("id"), run.alias("import_run_id"), F.col("doc_id").alias("source_url"), "name", "location", "venue", "date_range", "folder")
    settings = written(folder_profiles(docs, profiles), "folder-profiles")
    events = events.join(settings.select("folder", "source_profile_id"), "folder", "left")
    rows = {
        "entry": pages.entry_rows(of("entries")), "category_result": pages.category_result_rows(of("category_result")), "segment_result": pages.segment_result_rows(of("segment_result")),
    }
    event, category = key_of(run, "folder"), key_of(run, "folder", "category")
    index = pages.index_rows(of("index")).join(folders, "doc_id")
    segments = segment_rows(index, run)
    rows = {k: df.join(folders, "doc_id") for k, df in rows.items()}
    rows = {k: attach_segments(df, segments) if k == "segment_result" else df.withColumn("segment_id", F.lit(None).cast("long")) for k, df in rows.items()}
    categories = index.where("kind = 'category'").groupBy("folder", "category").agg(F.min("row_no").alias("source_order")).select(category.alias("id"), event.alias("event_id"), F.col("category").alias("name"), "source_order")
    appearance = lambda kind: key_of(run, "doc_id", F.lit(kind), "row_no", "segment_id")
    appearances = None
    for kind, df in rows.items():
        part = df.select(
            appearance(kind).alias("id"), run.alias("import_run_id"), event.alias("event_id"), category.alias("category_id"), "segment_id", doc, F.lit(kind).alias("appearance_type"),
            F.col("row_no").alias("source_row_order"), F.col("name").alias("raw_name"), normalize_name(F.col("name")).alias("normalized_name"), F.col("nation").alias("nation_code"), F.col("club").alias("club_name"), "source_skater_id", "folder",
        )
        appearances = part if appearances is None else appearances.unionByName(part)
    appearances = normalize_representation(appearances.join(settings, "folder", "left").fillna({"representation_primary": "nation", "nation_column": "country"}))
    officials = attach_segments(pages.official_rows(of("officials")).join(folders, "doc_id"), segments)
    unlinked = rows["segment_result"].select("doc_id", "segment_id").unionByName(officials.select("doc_id", "segment_id")).where("segment_id IS NULL").select("doc_id").distinct()
    empty = of("category_result").select("doc_id").distinct().join(rows["category_result"].select("doc_id"), "doc_id", "left_anti")
    return {
        "source_documents": docs.select(key_of(run, "url").alias("id"), run.alias("import_run_id"), "url", document_type(F.col("url")).alias("document_type"), content_hash(F.col("body")).alias("content_hash")),
        "events": events.drop("folder"),
        "categories": categories,
        "segments": segments.select(F.col("segment_id").alias("id"), category.alias("category_id"), F.col("segment").alias("name"), "source_order", F.col("judges_scores.url").alias("judges_scores_pdf_url")),
        "schedule_items": pages.schedule_rows(of("index")).join(folders, "doc_id").select(key_of(run, "doc_id", "row_no").alias("id"), event.alias("event_id"), F.col("date").alias("scheduled_date"), F.col("time").alias("scheduled_time"), F.col("category").alias("category_name"), F.col("segment").alias("segment_name")),
        "source_skater_appearances": shaped(appearances.withColumn("raw", F.map_filter(F.create_map(F.lit("representation"), F.col("representation_note")), lambda _, v: v.isNotNull())), "source_skater_appearances"),
        "category_results": rows["category_result"].select(key_of(run, "doc_id", "row_no").alias("id"), category.alias("category_id"), appearance("category_result").alias("skater_appearance_id"), "final_place", "points", "segment_places", F.col("row_no").alias("source_order")),
        "segment_results": rows["segment_result"].select(key_of(run, "doc_id", "row_no", "segment_id").alias("id"), "segment_id", appearance("segment_result").alias("skater_appearance_id"), "place", "tss", "tes", "pcs", "deduction", "starting_number", "components", F.col("row_no").alias("source_order")),
        "official_assignments": officials.select(key_of(run, "doc_id", "function", "name", "segment_id").alias("id"), "segment_id", doc, F.col("function").alias("function_text"), "role_group", "judge_number", "name", F.col("nation").alias("nation_code"), F.col("row_no").alias("source_order")),
        "parse_issues": issue_rows(empty.select(F.lit("empty_category_result").alias("code"), F.col("doc_id").alias("url")).unionByName(unlinked.select(F.lit("page_without_segment").alias("code"), F.col("doc_id").alias("url"))).unionByName(unread, allowMissingColumns=True)).withColumn("import_run_id", run),
    }


def write_observed(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write tables and count their rows in the pass that writes them, issues also by their level (``parse_issues.warning``)."""
    stats = {}
    for name, df in tables.items():
        seen = Observation(name)
        levels = {f"parse_issues.{x}": F.count_if(F.col("level") == x) for x in LEVELS} if name == "parse_issues" else {}
        df.observe(seen, F.count(F.lit(1)).alias(name), *[c.alias(k) for k, c in levels.items()]).write.parquet(f"{root}/{name}")
        stats |= {k: int(n) for k, n in seen.get.items()}
    return stats


def load_run(runs: DataFrame, run_id: int, root: str, documents: DataFrame, profiles: DataFrame | None = None, sheet_text: DataFrame | None = None) -> DataFrame:
    """R6: import pages and sheets of a started run, write their tables in the shapes of the schemas, and give back the runs with this one closed.

    Its record holds the rows of every table, issues also by level, and ``path``: a new folder under ``root`` for each
    try, so that what a try left behind stops no later one. A page that can't be read is an issue; a run that fails
    holds the error instead, and other runs stay as they are.
    """
    path = f"{root.rstrip('/')}/run-{run_id}-{uuid.uuid4().hex}"
    try:
        tables = import_batch(documents, run_id, profiles)
        if sheet_text is not None:
            for name, df in import_sheets(sheet_text, run_id, documents, profiles=profiles).items():
                tables[name] = tables[name].unionByName(df, allowMissingColumns=True) if name in tables else df
        stats = write_observed({name: shaped(df, name) for name, df in tables.items() if name in TABLES}, path)
    except Exception as error:  # a page's fault is an issue; what comes here stops this run alone
        return close_run(runs, run_id, "failed", error=f"{type(error).__name__}: {error}"[:2000])
    return close_run(runs, run_id, "completed", {**stats, "path": path})


def sheet_links(documents: DataFrame, run_id: int) -> DataFrame:
    """The sheets that index pages among the documents link as judges' scores: doc_id, link_text, and the event, category and segment they belong to."""
    run = F.lit(run_id).cast("long")
    index = pages.route(documents).where("page_type = 'index'").withColumn("folder", F.regexp_replace("url", r"[^/]*\z", ""))
    rows = pages.index_rows(pages.cells(index)).join(index.select(F.col("url").alias("doc_id"), "folder"), "doc_id")
    found = segment_rows(rows, run).where("judges_scores IS NOT NULL")
    return found.select(bare_url(F.col("judges_scores.url")).alias("doc_id"), F.col("judges_scores.text").alias("link_text"), key_of(run, "folder").alias("event_id"), key_of(run, "folder", "category").alias("category_id"), "segment_id", F.col("category").alias("category_name"), F.col("segment").alias("segment_name"))


def shaped(df: DataFrame, table: str) -> DataFrame:
    """The columns of a source table in their types; those that are missing are null."""
    empty = df.sparkSession.createDataFrame([], TABLES[table])
    return df.select([(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in empty.dtypes])


def import_sheets(sheet_text: DataFrame, run_id: int, documents: DataFrame | None = None, test_cells: DataFrame | None = None, profiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Score sheets (doc_id: their URL, text) as appearances, summaries, elements, components and marks with hashed keys.

    ``documents`` are those of ``import_batch``: their index pages link sheets to segments, and a sheet that several
    segments link is loaded for each. Sheets that no segment links stay without one; a link that doesn't name judges'
    scores and a linked body that is no PDF are issues, and their sheets aren't loaded. ``test_cells`` (doc_id, row_no,
    cells) are rows of beginners' tests; their sheets have no summaries. sheet_metadata has category and segment of each
    sheet, from the index where its title has none.
    """
    run = F.lit(run_id).cast("long")
    spark = sheet_text.sparkSession
    if documents is None:
        links = spark.createDataFrame([], "doc_id string, link_text string, event_id long, category_id long, segment_id long, category_name string, segment_name string")
        issues = issue_rows(spark.createDataFrame([], "url string, link_text string, code string, level string"))
    else:
        links = sheet_links(documents, run_id)
        bodies = documents.select(bare_url(F.col("url")).alias("url"), "body")
        linked = links.select(F.col("doc_id").alias("url"), "link_text").distinct().join(bodies, "url")
        refused = sheets.gate_sheets(linked)[1]
        links = links.join(refused.select(F.col("url").alias("doc_id"), "link_text"), ["doc_id", "link_text"], "left_anti")
        gone = refused.select(F.col("url").alias("_gone")).join(links.select(F.col("doc_id").alias("_gone")), "_gone", "left_anti").distinct()
        sheet_text = sheet_text.join(gone, bare_url(F.col("doc_id")) == F.col("_gone"), "left_anti")
        issues = issue_rows(refused)
    links = written(links, "sheet-links").withColumnRenamed("doc_id", "_url")
    parents = lambda df: df.join(links, bare_url(F.col("doc_id")) == F.col("_url"), "left").drop("_url", "link_text")
    doc = key_of(run, "doc_id").alias("source_document_id")

    scored = sheet_text if test_cells is None else sheet_text.join(test_cells.select("doc_id").distinct(), "doc_id", "left_anti")
    found = sheets.prefer_sheet_source(text=sheets.sheet_summaries(scored), blocks=sheets.sheet_blocks(scored))
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    found = written(found, "sheet-summaries").withColumns({"skater_no": F.row_number().over(by_line), "skaters": F.count("*").over(Window.partitionBy("doc_id"))})
    starts = found.where("sheet_source = 'text'").groupBy("doc_id").agg(F.collect_list("line_no").alias("starts"))
    sections = sheets.sheet_sections(sheets.lines(scored).join(starts, "doc_id", "left"), "starts")
    sections = written(sections, "sheet-sections")
    # lines of a sheet with one skater are theirs, wherever the summary stands
    alone = found.where("skaters = 1").select("doc_id", F.lit(1).alias("only"))
    of_skater = lambda df: df.join(alone, "doc_id", "left").withColumn("skater_no", F.coalesce("only", "skater_no")).drop("only")
    details = of_skater(sheets.sheet_details(sections)).select("doc_id", "skater_no", "base_value_total", "element_score_total", "judge_count")
    summary = key_of(run, "doc_id", "line_no", "segment_id")
    appearance = key_of(run, "doc_id", F.lit("pdf_score"), "line_no", "segment_id")
    summaries = parents(found.join(details, ["doc_id", "skater_no"], "left")).withColumns({"id": summary, "skater_appearance_id": appearance})
    owner = summaries.select("doc_id", "skater_no", F.col("id").alias("pdf_score_summary_id"))
    owned = lambda df: of_skater(df).join(owner, ["doc_id", "skater_no"], "left")
    elements = owned(sheets.element_rows(sections)).withColumn("id", key_of(run, "doc_id", "skater_no", "element_no", "raw_element", "pdf_score_summary_id"))
    components = owned(sheets.component_rows(sections)).withColumn("id", key_of(run, "doc_id", "skater_no", "component_name", "pdf_score_summary_id"))
    marks = lambda df, name: df.select(F.col("id").alias(name), F.posexplode("judge_scores").alias("n", "score")).select(key_of(name, "n").alias("id"), name, (F.col("n") + 1).alias("judge_number"), "score")
    lost = elements.select("doc_id", "pdf_score_summary_id").unionByName(components.select("doc_id", "pdf_score_summary_id")).where("pdf_score_summary_id IS NULL").select(F.lit("score_without_skater").alias("code"), F.col("doc_id").alias("url")).distinct()
    docs = documents if documents is not None else spark.createDataFrame([], "url string, body string")
    routed = pages.route(docs).withColumn("folder", F.regexp_replace("url", r"[^/]*\z", ""))
    settings = folder_profiles(routed, profiles).select(key_of(run, "folder").alias("event_id"), "representation_primary", "nation_column")
    who = summaries.join(settings, "event_id", "left").fillna({"representation_primary": "nation", "nation_column": "country"}).select(
        "representation_primary", "nation_column", F.lit(None).cast("string").alias("club_name"), F.col("skater_appearance_id").alias("id"), run.alias("import_run_id"), "event_id", "category_id", "segment_id", doc, F.lit("pdf_score").alias("appearance_type"), F.col("skater_no").alias("source_row_order"),
        F.col("name").alias("raw_name"), normalize_name(F.col("name")).alias("normalized_name"), F.col("nation").alias("nation_code"),
    )
    title = split_sheet_title(F.col("after"))
    titled = parents(sheets.sheet_titles(sheet_text)).withColumns({"category": F.coalesce(blank_to_null(title["category"]), "category_name"), "segment": F.coalesce(blank_to_null(title["segment"]), "segment_name")})
    tests = sheets.test_rows(test_cells if test_cells is not None else spark.createDataFrame([], "doc_id string, row_no int, cells array<string>"))
    tests = parents(tests)
    return {
        "source_skater_appearances": shaped(normalize_representation(who), "source_skater_appearances"),
        "pdf_score_summaries": shaped(summaries.withColumn("source_document_id", doc), "pdf_score_summaries"),
        "pdf_elements": shaped(elements, "pdf_elements"),
        "pdf_element_judge_scores": shaped(marks(elements, "pdf_element_id"), "pdf_element_judge_scores"),
        "pdf_program_components": shaped(components, "pdf_program_components"),
        "pdf_component_judge_scores": shaped(marks(components, "pdf_program_component_id"), "pdf_component_judge_scores"),
        "pdf_test_results": tests.select(key_of(run, "doc_id", "row_no", "segment_id").alias("id"), "segment_id", doc, F.col("row_no").alias("source_order"), F.col("number").alias("rank"), F.col("name").alias("skater_name"), normalize_name(F.col("name")).alias("normalized_name"), F.col("club").alias("club_name"), F.col("result").alias("result_text"), "passed"),
        "sheet_metadata": titled.select(doc, "segment_id", "category", "segment"),
        "parse_issues": issues.unionByName(issue_rows(lost), allowMissingColumns=True),
    }
