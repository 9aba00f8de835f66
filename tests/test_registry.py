"""Rules, upserts, registry and load."""

import hashlib
import os

from pyspark.sql import functions as F

from resultmart.functions import arrays as A
from resultmart.functions import text as T
from resultmart.operators import joins as J
from resultmart.operators import maintenance as M
from resultmart.operators.windows import dense_key
from resultmart.plans import registry as R
from resultmart.sources.schemas import TABLES
from resultmart.sources.tables import json_report, load_layer, read_manifest_csv, read_profiles, read_url_list, write_manifest
from tests.test_pages import PAGES, U


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_text_semantics(spark):
    x = F.col("x")
    assert [str(v) for v in values(spark, T.parse_event_start(x), ["29.11.2013 - 1.12.2013", "27/11/2018 - 02/12/2018", "11/26/2021", "18-19.04.2026", "18.04 - 19.04.2026", "31.02.2020", None])] == ["2013-11-29", "2018-11-27", "2021-11-26", "None", "2026-04-18", "None", "None"]
    assert values(spark, T.normalize_name(x), [" a  b ", "straße", None]) == ["A B", "STRASSE", None]
    assert values(spark, T.not_iso3(x), ["BUL", "BUL\n", "Elit", None]) == [False, True, True, None]
    assert values(spark, T.to_int(x), ["#4 ", "x", "1.5", "", None]) == [4, None, None, None, None]
    assert values(spark, T.nation_code(x), ["BUL", "Name GER", "bul", "ABCD"]) == ["BUL", "GER", None, None]
    assert values(spark, T.has_header_sequence(x, ["Club", "Nation"]), ["<th>Club</th>\n<th>Nation", "Nation Club"]) == [True, False]
    assert values(spark, T.split_sheet_title(x)["segment"], ["NOVICE BOYS SHORT PROGRAM", "A  B", "A"]) == ["SHORT PROGRAM", "B", ""]
    assert values(spark, T.archive_path(x), ["http://A.test/x/", "http://a.test/p?a=1&b"]) == ["A.test/x/index.html", "a.test/p/index.html__query_a-1_b-"]
    assert values(spark, T.season(x), ["2013-06-30", "2013-07-01"], "string") == ["2012/2013", "2013/2014"]


def test_aggregates_and_maps(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, None, 1), (1, "a", None), (1, "a", 3)], "k int, v string, o int")
    row = df.groupBy("k").agg(A.agg_ordered(F.col("v"), F.col("o")).alias("o"), A.agg_ordered(F.col("v"), distinct=True).alias("d"), A.agg_ordered(F.col("v"), where=F.col("o") > 9).alias("n"), A.agg_ordered(F.col("v"), F.col("o"), keep_null=False).alias("f")).first()
    assert (row.o, row.d, row.n, row.f) == ([None, "b", "a", "a"], ["a", "b", None], None, ["b", "a", "a"])
    m = spark.range(1).select(A.merge_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), A.zip_map(F.array(F.lit("x"), F.lit(""), F.lit("x"), F.lit("z")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("z")).first()
    assert m.m == {"a": "1", "b": "3"} and m.z == {"x": "3"}


def test_dense_key_is_a_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")).dropDuplicates().repartition(7)
    got = [(r.a, r.b) for r in dense_key(df, ["a", "b"], "k").orderBy("k").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1] is None, r[1] or 0)) and dense_key(df, ["a", "b"], "k").agg(F.max("k")).first()[0] == len(got)


def test_dense_key_numbers_many_rows_once(spark):
    """A set of keys that grows with the table, in rows wider than the sort columns."""
    n = 200_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("a"), F.col("id").alias("b"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = dense_key(df, ["a"], "k")
    assert out.columns == ["k", *df.columns]
    assert out.agg(F.count("*"), F.count_distinct("k"), F.count_distinct("b"), F.min("k"), F.max("k")).first()[:] == (n, n, n, 1, n)
    pairs = out.select("k", "a", "wide")
    after = pairs.select((F.col("k") - 1).alias("k"), F.col("a").alias("next"))
    assert pairs.join(after, "k").where("next <= a").count() == 0 and dense_key(df.limit(0), ["a"], "k").count() == 0


def test_representation(spark):
    rows = [(1, "Elit", "", "club", "club"), (2, "Elit", "X", "club", "country"), (3, "BUL", "X", "club", "country"), (4, "BUL", "", "nation", "country"), (5, "BUL", "", "club", "country")]
    out = {r.id: (r.nation_code, r.club_name, r.representation_type, r.representation_value) for r in R.normalize_representation(spark.createDataFrame(rows, "id int, nation_code string, club_name string, representation_primary string, nation_column string")).collect()}
    assert out == {1: (None, "Elit", "club", "Elit"), 2: (None, "X", "club", "X"), 3: ("BUL", "X", "club", "X"), 4: ("BUL", "", "nation", "BUL"), 5: ("BUL", "", "club", None)}


def test_rules(spark):
    schema = "id int, nation_code string, club_name string, representation_primary string, nation_column string, parser_profile string, representation_type string, representation_value string, raw map<string,string>"
    rows = [(1, "Elit", "", "club", "club", "old_isucalcfs", None, None, {}), (2, "Var", "abc", "club", None, "fs_manager", "club", "abc", {}), (3, "BUL", "Varna", "club", "country", "fs_manager", "nation", "BUL", {}), (4, "BUL", "abc", "club", "country", "fs_manager", "club", "abc", {})]
    out = {r.id: r for r in R.correct_appearances(spark.createDataFrame(rows, schema)).collect()}
    assert (out[1].nation_code, out[1].club_name, out[1].representation_value) == (None, "Elit", "Elit") and "nation_holds_club" in out[1].raw
    assert (out[2].nation_code, out[2].club_name, out[2].representation_value) == (None, None, None) and "Var" in out[2].raw["nation_not_a_code"]
    assert (out[3].representation_type, out[3].representation_value) == ("club", "Varna") and out[4].club_name == "abc"
    profile = "profile_key string, host string, path_prefix string, parser_profile string, competition_stream string, representation_primary string, event_type string, competition_level string, nation_column string, store_nation boolean, store_club boolean, empty_club_policy string, discovered boolean"
    made = [("fam_x", "h", "/a", "fs_manager", None, "club", None, None, None, True, True, None, False), ("k", "fed", "/p/cup1", "fs_manager", "NonISU", "nation", None, None, None, True, True, None, True), ("o", "fed", "/z", "old_isucalcfs", "x", "club", None, None, None, True, True, None, False)]
    got = {r.profile_key: r for r in M.apply_rules(spark.createDataFrame(made, profile), R.profile_rules(["fam_"], "/amateur", "fed", "/p/cup1")).collect()}
    assert (got["fam_x"].representation_primary, got["fam_x"].competition_stream) == ("nation", "international")
    assert (got["k"].representation_primary, got["k"].event_type) == ("club", "international") and (got["o"].nation_column, got["o"].store_nation) == ("club", False)


def test_upserts(spark):
    base = spark.createDataFrame([("u1", "f", "imported", "passed", "a", {"k": "1"}, None, 7, "old_isucalcfs", "x"), ("u2", None, "ready_for_import", "passed", None, {}, "r", 8, None, None)], TABLES["source_url_registry"])
    new = spark.createDataFrame([("u1", None, "ready_for_import", "failed", "b", {"j": "2"}, "to", 9, "fs_manager", "y"), ("u2", None, "skipped", "failed", None, {}, None, 9, None, None), ("u3", "f", "ready_for_import", "passed", None, {"source": "a listing/x"}, None, None, "old_isucalcfs", None), ("u4", "f", "ready_for_import", "passed", None, {"source": "b"}, None, None, "fs_manager", None), ("u5", "f", "ready_for_import", "failed", None, {}, None, None, "fs_manager", None)], TABLES["source_url_registry"])
    out = {r.url: r for r in R.register(base, new).collect()}
    assert (out["u1"].status, out["u1"].validation_status, out["u1"].notes, out["u1"].summary, out["u1"].family) == ("imported", "passed", "a\nb", {"k": "1", "j": "2"}, "f") and len(out) == 5
    assert (out["u1"].resolved_url, out["u1"].source_profile_id, out["u1"].parser_profile, out["u1"].competition_stream) == ("to", 7, "fs_manager", "y")
    assert (out["u2"].status, out["u2"].validation_status, out["u2"].resolved_url, out["u2"].source_profile_id) == ("skipped", "failed", None, 8)
    runs = spark.createDataFrame([(1, "u2", "completed")], "id long, root_url string, status string")
    assert [r.url for r in R.ready_worklist(R.register(base, new), runs).collect()] == ["u4", "u3"]
    assert [r.url for r in R.ready_worklist(R.register(base, new), runs, family="listing").collect()] == ["u3"] and R.ready_worklist(base, runs).isEmpty()
    failed = base.withColumn("validation_status", F.lit("failed"))
    assert {r.url: r.validation_status for r in M.refresh_registry(failed, runs).collect()}["u2"] == "passed"
    catalog = spark.createDataFrame([("s", "Adult Competition", None, "", None, None, None, "d1", None, "registered", {}), ("s", "B", "x", None, None, None, "k", "d2", None, "new", {}), ("s", "C", "x", None, None, None, "k", "d3", None, "new", {})], TABLES["event_discovery_catalog"])
    rows = spark.createDataFrame([("s", "Adult Competition", "", None, "", "", None, "d1", "r", "new", {"a": "b"})], TABLES["event_discovery_catalog"])
    got = {r.event_name: r for r in R.load_catalog(catalog, rows).collect()}
    assert len(got) == 3 and got["Adult Competition"].discovery_status == "registered" and got["Adult Competition"].result_url == "r" and got["Adult Competition"].kind == "isu_adult_catalog"
    details = spark.createDataFrame([("d2", "http://r")], "detail_url string, result_url string")
    done = {r.event_name: r for r in R.resolve_catalog(catalog, details).collect()}
    assert (done["B"].result_url, done["B"].discovery_status, done["C"].discovery_status) == ("http://r", "candidate_result_url", "manual_review")
    held = catalog.withColumn("result_url", F.when(F.col("event_name") == "B", "http://had"))
    empty = spark.createDataFrame([("d1", None), ("d2", None), ("d3", "http://z"), ("d3", "http://y")], "detail_url string, result_url string")
    again = {r.event_name: (r.discovery_status, r.result_url) for r in R.resolve_catalog(held, empty, refresh=True).collect()}
    assert again == {"Adult Competition": ("catalog_only_needs_result_url", None), "B": ("candidate_result_url", "http://had"), "C": ("candidate_result_url", "http://y")}
    clubs, aliases = (spark.createDataFrame([], s) for s in ("club_id string, canonical_name string, status string", "alias_name string, alias_normalized string, club_id string, confidence string"))
    seen = spark.createDataFrame([("Elit",), (" elit ",), ("",), (None,), ("Varna",)], "club string")
    once = M.register_missing_aliases(seen, clubs, aliases)
    again = M.register_missing_aliases(seen, *once)
    assert [df.count() for df in once] == [2, 2] == [df.count() for df in again]


def test_runs_and_issues(spark):
    runs = spark.createDataFrame([(1, "u", "started", None, None), (2, "u", "started", None, None)], "id long, root_url string, status string, stats map<string,string>, error string")
    out = {r.id: r for r in M.close_run(runs, 1, "failed", {"events": 1}, "boom").collect()}
    assert (out[1].status, out[1].error, out[1].stats, out[2].status) == ("failed", "boom", {"events": "1"}, "started")
    issue = M.issue_rows(spark.createDataFrame([("x", 1)], "code string, n int")).first()
    assert (issue.level, issue.code, issue.message, issue.context) == ("warning", "x", "", {"n": "1"})


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"profiles": [{"profile_key": "a", "host": "h"}, {"profile_key": "b", "host": "h"}]}')
    assert [(r.ordinal, r.profile_key) for r in read_profiles(spark, f"{tmp_path}/p.json").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "u.txt").write_text("# x\n\nhttp://a \n")
    assert [r.url for r in read_url_list(spark, f"{tmp_path}/u.txt").collect()] == ["http://a"]
    docs = spark.createDataFrame([(1, 7, "http://h/a.htm", b"x"), (2, 7, "http://h/b.pdf", None), (3, 6, "http://h/a.htm", b"y")], "id long, import_run_id long, url string, body binary")
    runs = spark.createDataFrame([(6, "r", "completed"), (7, "r", "completed")], "id long, root_url string, status string")
    manifest = R.archive_manifest(docs, runs)
    write_manifest(manifest, f"{tmp_path}/m")
    assert {(r.source_document_id, r.archive_status, r.archive_reason) for r in manifest.collect()} == {(1, "written", None), (2, "skipped", "pdf without a body")}
    base = spark.createDataFrame([], TABLES["source_archive_files"])
    full = spark.read.option("header", True).csv(f"{tmp_path}/m/csv")
    assert R.load_manifest(base, full).count() == 2 and read_manifest_csv(spark, f"{tmp_path}/m/csv").columns[0] == "source_document_id"
    assert '"n":2' in json_report(counts=manifest.agg(F.count("*").alias("n"))).first().report


def ridge(spark, *more):
    """The documents of one invented event."""
    return spark.createDataFrame([(U + n, b.encode("windows-1252", "replace")) for n, b in PAGES.items() if n.startswith("ridge/")] + [(U + "ridge/" + n, b) for n, b in more], "url string, body binary")


PROFILES = [("a", "scores.invalid", "open", "fs_manager", "nation", "country"), ("b", "scores.invalid", "open/ridge", "fs_manager", "club", "country"), ("c", "other.invalid", "open/ridge", "fs_manager", "nation", "country")]


def profiles(spark):
    settings = lambda primary, column: (None, None, (primary, column, None, True, True, None))
    return spark.createDataFrame([(i, key, host, path, parser, None, primary, settings(primary, column)) for i, (key, host, path, parser, primary, column) in enumerate(PROFILES)], TABLES["source_profiles"])


def test_import(spark):
    docs = ridge(spark, ("CAT010RS.htm", b"<table></table>"), ("d20.pdf", b"%PDF"))
    out = R.import_batch(docs, 5, profiles(spark))
    assert out["events"].count() == 1 and out["events"].first().source_profile_id == 1 and out["categories"].first()["name"] == "Pairs"
    assert [r.judges_scores_pdf_url for r in out["segments"].collect()] == [U + "ridge/d20.pdf"]
    linked = out["source_skater_appearances"].join(out["events"].select(F.col("id").alias("event_id")), "event_id")
    assert {(r.appearance_type, r.normalized_name, r.source_skater_id, r.representation_type, r.representation_value) for r in linked.collect()} == {
        ("entry", "UNA REED", "isufs00700700", "club", None), ("entry", "ODO FENN", "isufs00700701", "club", "Spur"), ("segment_result", "ODO FENN", "isufs00700701", "club", None), ("segment_result", "ZED MOOR", "isufs00700702", "club", None),
    }
    assert {r.representation_type for r in R.import_batch(docs, 5)["source_skater_appearances"].collect()} == {"nation"}
    assert out["segment_results"].join(out["source_skater_appearances"].select(F.col("id").alias("skater_appearance_id")), "skater_appearance_id").count() == 2
    assert out["schedule_items"].first().scheduled_date == "20.01.2033" and {r.document_type for r in out["source_documents"].collect()} == {"html", "judges_scores_pdf"}
    for df in out.values():
        df.collect()
    from tests.test_sheets import COMPACT, TABLE

    sheets = R.import_sheets(spark.createDataFrame([("c", COMPACT), ("t", TABLE)], "doc_id string, text string"), 5)
    assert sheets["pdf_score_summaries"].count() == 4 and sheets["pdf_element_judge_scores"].count() == 28 and sheets["pdf_component_judge_scores"].count() == 8
    assert {r.profile_key for r in R.attach_profiles(docs, profiles(spark)).collect()} == {"b"}
    checked = spark.createDataFrame([("html", 2, None), ("html", 2, True), ("html", 0, False), ("html_wrapper", None, False), ("pdf", None, False), ("unreachable", None, None), (None, 1, None)], "content_kind string, n_categories int, imported boolean")
    assert [(r.status, r.validation_status) for r in R.decide_status(checked).collect()] == [("ready_for_import", "passed"), ("analyzed", "passed"), ("skipped", "failed"), ("skipped", "failed"), ("analyzed", "warning"), ("skipped", "failed"), ("skipped", "failed")]


def test_sources_of_the_registry(spark):
    x = F.col("x")
    roles = values(spark, T.classify_role(x)["role_group"], [" Referee", "Judge  No.4", "Judges Panel", "Assistant Technical Specialist", "Replay Operator", "Referee of the day"])
    assert roles == ["referee", "judge", "other", "technical_panel", "event_operations", "other"]
    code, info = (lambda c, i: spark.createDataFrame([(c, i)], "c string, i string").select(T.element_markers(F.col("c"), F.col("i"))).first()[0]), None
    assert [code("2A<!", info), code("3Tq<", info), code("2Lo<<e+1Eu*", "REP|x"), code(None, "V F")] == [["!", "<"], ["<"], ["<<", "e", "*", "REP", "x"], ["F"]]
    assert values(spark, T.split_sheet_title(x)["category"], ["SOLO Pattern Dance 2 (Without Key Points)", "KIDS PATTERN DANCE", "A  B  C"]) == ["SOLO", "KIDS", "A"]
    urls = ["http://h.invalid/a/B/index.htm", "http://h.invalid/a/x.pdf", "http://h.invalid/q/", "http://h.invalid/index.htm", "http://h.invalid/n?a=1"]
    assert values(spark, T.path_prefix(x), urls) == ["a/B", "a", "q", "index.htm", "n"]
    digest = hashlib.sha1(b"a/B").hexdigest()[:8]
    assert values(spark, T.profile_key(x), urls[:1]) == [f"bsf_discovered_a_b_{digest}"]
    assert values(spark, T.document_type(x), ["http://h/A.PDF?x", "http://h/a.htm", "http://h/a.png", "http://h/a", "http://h.com", "http://h/a.css?b=c.png"]) == ["judges_scores_pdf", "html", "image/png", "html", "html", "text/css"]
    assert values(spark, T.archive_path(x), ["http://h:80/a/b.htm?k=v w&m=%41*~&e=", "no/host", "http://h", "http://h/a/b", "http://h/a/b.c/"]) == ["h:80/a/b.htm__query_k-v%20w_m-A%2A~_e-", "_no_host/no/host/index.html", "h/index/index.html", "h/a/b/index.html", "h/a/b.c/index.html"]
    assert values(spark, T.catalog_kind(x), ["Adult Competition International", "Challenger Series Z", "adult competition"]) == ["isu_adult_catalog", "isu_international_catalog", "isu_official_catalog"]
    assert values(spark, T.stream_of(x, F.lit("http://h/test-mf/1")), ["result_ISU", "result_DP", "other", None]) == ["ISU", "DP", "club_test", "club_test"]
    assert values(spark, T.representation_of(x), ["result_NonISU", "result_DP", None]) == ["nation", "club", "club"]
    assert values(spark, T.parser_of(F.lit("fs_manager"), F.lit("http://h/2013/"), x), ["made by ISUCalcFS", "JudgesDetailsPerSkater", "neither"]) == ["old_isucalcfs", "fs_manager", "old_isucalcfs"]
    assert values(spark, A.first_json_string(x, "n"), [r'{"n":"a \u0026 b&lt;c"}', r'{\"n\":\"x\/y\"}', '{"m":"n"}', '{"n":""}']) == ["a & b<c", "x/y", None, ""]


def test_aliases_by_confidence(spark):
    clubs = spark.createDataFrame([("1", "North"), ("2", "South")], "club_id string, canonical_name string")
    seed = spark.createDataFrame([("South", "N. Club", "medium"), ("North", "n.  club ", "high"), ("South", "Sud", "low"), ("Gone", "West", "high")], "canonical_name string, alias_name string, confidence string")
    assert {(r.alias_normalized, r.club_id, r.confidence) for r in M.seeded_aliases(seed, clubs).collect()} == {("n. club", "1", "high"), ("sud", "2", "low")}


def test_segments_with_one_name_stay_apart(spark):
    row = lambda n: f'<tr><td></td><td>Pattern Dance</td><td><a href="SEG00{n}OF.htm">Panel of Judges</a></td><td><a href="SEG00{n}.htm">Details</a></td></tr>'
    result = lambda name: f"<table><caption><h2>Cup</h2><h2>Dance - Pattern Dance</h2></caption><tr><th>Pl.</th><th>Name</th><th>TSS</th></tr><tr><td>1</td><td>{name}</td><td>9.00</td></tr></table>"
    official = lambda name: f"<table><caption><h2>Cup</h2><h2>Dance - Pattern Dance</h2></caption><tr><th>Function</th><th>Name</th></tr><tr><td>Referee</td><td>{name}</td></tr></table>"
    body = {"index.htm": "<title>Cup</title><table><tr><th>Category</th><th>Segment</th><th></th><th></th></tr><tr><td>Dance</td><td></td><td></td><td></td></tr>" + row(1) + row(2) + "</table>", "SEG001.htm": result("Ann"), "SEG002.htm": result("Bob"), "SEG001OF.htm": official("Ref A"), "SEG002OF.htm": official("Ref B"), "SEG003.htm": result("Eve")}
    out = R.import_batch(spark.createDataFrame([(U + "two/" + n, b.encode()) for n, b in body.items()], "url string, body binary"), 5)
    segments = {r.id: (r.name, r.source_order) for r in out["segments"].collect()}
    assert sorted(segments.values()) == [("Pattern Dance", 1), ("Pattern Dance", 2)]
    order = lambda x: segments[x][1] if x else None
    assert {(r.normalized_name, order(r.segment_id)) for r in out["source_skater_appearances"].collect()} == {("ANN", 1), ("BOB", 2), ("EVE", None)}
    assert {(r.name, order(r.segment_id)) for r in out["official_assignments"].collect()} == {("Ref A", 1), ("Ref B", 2)}
    assert {order(r.segment_id) for r in out["segment_results"].collect()} == {1, 2, None}
    assert [(r.code, r.context["url"][-10:]) for r in out["parse_issues"].collect()] == [("page_without_segment", "SEG003.htm")]


def test_a_run_reaches_views_and_facts(spark, tmp_path):
    """Pages and sheets through the load and the written layer to the views and the mart."""
    from resultmart.plans import analytics as V
    from resultmart.plans import mart
    from tests.test_sheets import TABLE

    docs = ridge(spark, ("d20.pdf", b"%PDF"))
    text = spark.createDataFrame([(U + "ridge/d20.pdf", TABLE)], "doc_id string, text string")
    runs = R.shaped(spark.createDataFrame([(5, 1, "u", "started"), (6, 1, "w", "started")], "id long, source_profile_id long, root_url string, status string"), "import_runs")
    closed = R.load_run(runs, 5, f"{tmp_path}/layer", docs, profiles(spark), text)
    record = {r.id: r for r in closed.collect()}
    assert (record[5].status, record[6].status, record[5].stats["pdf_elements"], record[5].stats["segments"]) == ("completed", "started", "8", "1")
    again = {r.id: r for r in R.load_run(runs, 5, f"{tmp_path}/layer", docs, profiles(spark), text).collect()}
    layer, other = record[5].stats["path"], again[5].stats["path"]
    assert again[5].status == "completed" and layer != other and {k: v for k, v in again[5].stats.items() if k != "path"} == {k: v for k, v in record[5].stats.items() if k != "path"}
    assert all(int(n) == spark.read.parquet(f"{layer}/{name}").count() for name, n in record[5].stats.items() if name in TABLES)
    failed = {r.id: r for r in R.load_run(runs, 6, f"{tmp_path}/layer", docs.drop("body")).collect()}
    assert failed[6].status == "failed" and "body" in failed[6].error and failed[5].status == "started"

    flat = lambda df: spark.createDataFrame(df.collect(), df.schema)
    names = os.listdir(layer)
    t = {n: spark.createDataFrame([], s) for n, s in TABLES.items()} | {n: flat(df) for n, df in load_layer(spark, layer, names, views=False).items()}
    t |= {"import_runs": flat(closed), "source_profiles": profiles(spark)}
    scores = {(r.skater_name, r.score_source[:3], r.category_name, r.segment_name) for r in V.v_skater_segment_scores(t).collect()}
    assert scores == {("UNA REED", "pdf", "Pairs", "Rhythm Dance"), ("ODO FENN", "pdf", "Pairs", "Rhythm Dance"), ("ZED MOOR", "htm", "Pairs", "Rhythm Dance")}
    assert sorted(r.skater_name for r in V.v_skater_elements(t).collect()) == ["ODO FENN"] * 2 + ["UNA REED"] * 6
    marks = mart.fact_element_judge_mark(t)
    assert marks.count() == 28 and marks.where("skater_key IS NULL").count() == 0 if "skater_key" in marks.columns else marks.count() == 28


def test_tests_and_titles_of_sheets(spark):
    from tests.test_sheets import TABLE

    docs = ridge(spark, ("d20.pdf", b"%PDF"))
    text = spark.createDataFrame([(U + "ridge/d20.pdf", TABLE), (U + "ridge/test.pdf", "x")], "doc_id string, text string")
    cells = spark.createDataFrame([(U + "ridge/test.pdf", 1, ["1", "Mia", "Elit", "Покрил"])], "doc_id string, row_no int, cells array<string>")
    out = R.import_sheets(text, 5, docs, cells)
    for name in ("pdf_score_summaries", "pdf_elements", "pdf_element_judge_scores", "pdf_program_components", "pdf_component_judge_scores", "source_skater_appearances"):
        assert out[name].dtypes == spark.createDataFrame([], TABLES[name]).dtypes
    assert [(r.rank, r.skater_name, r.passed) for r in out["pdf_test_results"].collect()] == [(1, "Mia", True)]
    assert {(r.category, r.segment) for r in out["sheet_metadata"].where("segment_id IS NOT NULL").collect()} == {("Pairs", "Rhythm Dance")}


def test_prefixes_of_one_host(spark):
    """Ten thousand prefixes on a host, most of them of few lengths, against a plain search."""
    import random

    rng = random.Random(6)
    prefixes = sorted({"".join(rng.choice("ab/%_") for _ in range(rng.choice([0, 1, 3, 7, 11]))) for _ in range(60_000)})[:10_000]
    profiles_ = spark.createDataFrame([("h", p, i) for i, p in enumerate(prefixes)] + [("h", prefixes[5], -1), ("g", "", 7), (None, "a", 8), ("h", None, 9)], "host string, prefix string, id int")
    paths = ["".join(rng.choice("ab/%_") for _ in range(rng.randrange(0, 14))) for _ in range(500)]
    rows = spark.createDataFrame([(i, rng.choice(["h", "h", "g", "other", None]), p) for i, p in enumerate(paths)] + [(500, "h", None)], "n int, site string, path string").cache()
    ids = {p: i for i, p in enumerate(prefixes)} | {prefixes[5]: -1}
    expected = {}
    for r in rows.collect():
        held = {"h": ids, "g": {"": 7}}.get(r.site, {}) if r.path is not None else {}
        best = max((p for p in held if r.path.startswith(p)), key=len, default=None)
        expected[r.n] = held.get(best)
    found = J.longest_prefix_join(rows, profiles_.withColumnRenamed("host", "site"), ["n"], "site", "path", "prefix").collect()
    assert {r.n: r.id for r in found} == expected


def test_media_types(spark):
    urls = ["http://a/x.PDF?y", "http://a/x.htm", "http://a/x.jpeg#z", "http://a/x.unheard", "http://a/x", "http://a/x.docx"]
    assert [r.t for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.document_type(F.col("u")).alias("t")).collect()] == ["judges_scores_pdf", "html", "image/jpeg", "html", "html", "html"]
