"""Cascades over tables without a key, documents of the stored mart, places of codes in a legend, listings with other disciplines."""

from resultmart.operators.maintenance import cascade_delete, removed_counts
from resultmart.plans import mart, pages, registry
from resultmart.sources.tables import empty_layer, shared_path


def test_cascade_reaches_tables_without_a_key(spark):
    row = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "import_runs": row([(1,), (2,)], "id long"),
        "source_documents": row([(10, 1), (20, 2), (21, None)], "id long, import_run_id long"),
        "parse_issues": row([(1, None, "a"), (2, 20, "b"), (2, 10, "c"), (None, 21, "d"), (None, None, "e")], "import_run_id long, source_document_id long, code string"),
        "events": row([(100, 1), (200, 2)], "id long, import_run_id long"),
        "categories": row([(1000, 100), (2000, 200), (2001, 200)], "id long, event_id long"),
        "segments": row([(5, 1000), (6, 2000), (7, None)], "id long, category_id long"),
        "segment_results": row([(1, 5), (1, 6), (2, 7)], "id long, segment_id long"),
    }
    after = cascade_delete(tables, row([(1,), (1,), (9,)], "id long"))
    assert {r.code for r in after["parse_issues"].collect()} == {"b", "d", "e"}
    assert sorted(r.segment_id for r in after["segment_results"].collect()) == [6, 7]
    assert {r.label: r.removed for r in removed_counts(tables, after).collect()} == {"import_runs": 1, "source_documents": 1, "parse_issues": 2, "events": 1, "categories": 1, "segments": 1, "segment_results": 1}
    nothing = cascade_delete(tables, row([], "id long"))
    assert all(nothing[n].count() == tables[n].count() for n in tables)


def test_documents_of_the_mart_can_be_stored(spark):
    t = empty_layer(spark)
    fill = lambda name, data, schema: registry.shaped(spark.createDataFrame(data, schema), name)
    t["import_runs"] = fill("import_runs", [(1, "http://a/", "completed")], "id long, root_url string, status string")
    t["source_documents"] = fill("source_documents", [(1, 1, "http://a/x", "html"), (2, 1, "http://a/y", "pdf"), (3, 7, "http://lost/", "html")], "id long, import_run_id long, url string, document_type string")
    t["source_archive_files"] = fill("source_archive_files", [(1, 1, "other", "written")], "source_document_id long, import_run_id long, url string, archive_status string")
    root = shared_path(spark, "mart")
    mart.write_mart(t, root, ["dim_source_document"])
    rows = {r.source_document_key: (r.url, r.root_url, r.archive_status) for r in spark.read.parquet(f"{root}/dim_source_document").collect()}
    assert rows == {1: ("http://a/x", "http://a/", "written"), 2: ("http://a/y", "http://a/", None)}


def test_legend_places(spark):
    entries = registry.shaped(spark.createDataFrame([("m", "x"), ("m", "<<"), ("m", "<"), ("n", "a"), ("z", "q")], "legend_group string, code string"), "validation_legend")
    out = mart.legend({"validation_legend": entries}, ["m", "n"], ["<<", "<"]).collect()
    assert [(r.legend_group, r.code, r.sort_order) for r in out] == [("m", "<<", 1), ("m", "<", 2), ("m", "x", 99), ("n", "a", 99)]


def test_listing_numbers_its_own_discipline(spark):
    event = "<p>{} Oct 2020</p><p>{}</p><p>Town / AAA</p><p>{}</p>"
    body = event.format(3, "A", "Speed") + event.format(1, "B", "Figure Skating") + '<a href="/eventdetail/1">x</a><a href="/eventdetail/1">again</a>' + event.format(2, "C", "figure skating") + '<a href="/eventdetail/2">x</a>' + event.format(4, "D", "Figure Skating")
    rows = pages.catalog_rows(spark.createDataFrame([("u", body), ("empty", None)], "url string, body string")).collect()
    assert {(r.event_name, r.city, r.country_code, r.detail_url) for r in rows} == {("B", "Town", "AAA", "/eventdetail/1"), ("C", "Town", "AAA", "/eventdetail/2"), ("D", "Town", "AAA", None)}
