"""Pages of invented events in both layouts, with faults that pages can have."""

import random

import pytest

from resultmart.plans import pages as P
from resultmart.plans import resolution
from resultmart.plans.quality import index_issues

U = "https://scores.invalid/open/"


def table(*rows, head=None, caption=""):
    cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in row) + "</tr>"
    return f"<table>{caption}" + (cells(head, "th") if head else "") + "".join(cells(r, "td") for r in rows) + "</table>"


def link(href, text):
    return f'<a href="{href}">{text}</a>'


def caption(*lines):
    return "<caption>" + " ".join(f"<h2>{x}</h2>" for x in lines) + "</caption>"


LAKE = "<title>Lake Open 2031</title><h2>Lake Open 2031 </h2><h3>Nordhaven</h3><h3>3.2.2031 \x97. - 5.2.2031 \x97. </h3><h3>Hall Three</h3>"
PAGES = {
    "lake/index.htm": LAKE
    + table(
        ("Cubs", "", link("CAT003EN.HTM", " Entries "), link("CAT003RS.HTM", "Result"), "", ""),
        ("", "Free Skating", link("SEG007OF.HTM", "Officials"), link("SEG007.HTM", "Starting Order / Result Details"), link("plan.pdf", "Time Schedule (pdf)"), link("marks7.pdf", "Judges Scores&nbsp;(pdf)")),
        ("", "Short Program", link("SEG008OF.HTM", "Officials"), link("SEG008.HTM", "Result Details"), "", ""),
        head=("Category", "Segment", "&nbsp;", "&nbsp;", "&nbsp;", "&nbsp;"),
    )
    + table(("4.2.2031 \x97.",), ("", "08:15:00", "Cubs", link("SEG007.HTM", "Free Skating")), ("", "17:40:00", "Cubs", "Short Program"), ("", "19:00:00", "Cubs", "Gala"), head=("Date", "Time", "Category", "Segment")),
    "bare/index.htm": "<title>Club Day 2030</title><h2>Club Day 2030</h2>" + table(("Beginners", link("day.pdf", "Result")), head=("Category", "&nbsp;")),
    "lake/CAT003EN.HTM": table(("4", "<a>Ilo   Varn</a>", "QQA"), ("9", "<a>Tam Orrel</a>", "QQB"), ("", "", ""), head=("No.", "Name", "Nat."), caption=caption("Lake Open 2031", "Cubs")),
    "lake/CAT003RS.HTM": table(("1", "<a>Tam Orrel</a>", "Floe", "QQB", "61.40", "1", "3"), ("3", "<a>Ilo Varn</a>", "&nbsp;", "QQA", "48.25", "2", "1"), head=("FPl.", "Name", "Club", "Nation", "Points", "SP", "FS"), caption=caption("Lake Open 2031", "Cubs")),
    "lake/SEG007.HTM": table(
        ("1", "<a>Tam Orrel</a><br />North Floe QB", "QB", "QQB", "31.05", "14.80", "", "16.75", "2.25", "2.50", "0.50", "11"), ("2", "<a>short row</a>"),
        head=("Pl.", "Name", "Club", "Nation", "TSS<br />=", "TES<br />+", "&nbsp;", "PCS<br />+", "TR", "IN", "Deduction<br />-", "StN."), caption=caption("Lake Open 2031", "Cubs - Free Skating"),
    ),
    "lake/SEG008.HTM": table(caption=caption("Lake Open 2031", "Cubs - Short Program")),
    "lake/SEG007OF.HTM": table(("Technical Controller", "Ms. U W", "QQC"), ("&nbsp;", "&nbsp;", "&nbsp;"), ("Judge No.3", "Mr. O P", "QQD"), ("Judge No.3", "Mr. O P", "QQD"), ("Announcer", "Ms. I J", "QQE"), head=("Function", "Name", "Nation"), caption=caption("Lake Open 2031", "Cubs - Free Skating")),
    "ridge/index.htm": '<title>Ridge Cup 2033</title><table><tr><td><table><tr><td class="caption3">Ostmark / QQF</td><td class="caption3">Dome</td></tr></table></td></tr><tr class="caption3"><td>19.01.2033 - 22.01.2033</td></tr>'
    '<tr class="caption3"><td><form action="all.pdf"><input type="submit" value="p" /></form></td></tr><tr><td>'
    + table(("Pairs", "", link("CAT010EN.htm", "Entries"), link("CAT010RS.htm", "Result"), ""), ("", "Rhythm Dance", link("SEG020OF.htm", "Panel of Judges"), link("SEG020.htm", "Starting Order / Detailed Classification"), link("d20.pdf", "Judges Scores")), head=("Category", "Segment", "&nbsp;", "&nbsp;", "Reports"))
    + "</td></tr><tr><td>" + table(("20.01.2033", "", "", ""), ("", "13:05:00", "Pairs", link("SEG020.htm", "Rhythm Dance")), head=("Date", "Time", "Category", "Segment")) + "</td></tr></table>",
    "ridge/CAT010EN.htm": '<tr class="caption2"><td>Pairs</td></tr>' + table(("2", link("/bios/isufs00700700.htm", "Una Reed"), "", "<table><tr><td><img /></td><td>QQG</td></tr></table>"), ("6", link("/bios/isufs00700701.htm", "Odo Fenn"), "Spur", ""), head=("No.", "Name", "Club", "Nation")),
    "ridge/SEG020.htm": '<tr class="caption2"><td>Pairs - Rhythm Dance</td></tr>'
    + table(("1", "Q", link("/bios/isufs00700701.htm", "Odo Fenn"), "QQG", "70.11", "40.01", "", "30.10", "5.05", "4.95", "5.10", "0.00", "3"), ("2", "", link("/bios/isufs00700702.htm", "Zed Moor"), "QQP", "60.00", "35.00", "", "25.00", "4.00", "4.10", "4.20", "0.00", "1"), head=("Pl.", "Qual.", "Name", "Nation", "TSS<br />=", "TES<br />+", "&nbsp;", "PCS<br />+", "CO", "PR", "SK", "Ded.<br />-", "StN.")),
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(U + name, body.encode("windows-1252", "replace")) for name, body in PAGES.items()]
    return P.cells(spark.createDataFrame(rows, "url string, body binary")).cache()


def some(df, doc, *order, **where):
    rows = [r for r in df.where(df.doc_id == U + doc).collect() if all(r[k] == v for k, v in where.items())]
    return sorted(rows, key=lambda r: [r[c] for c in order or ("row_no",)])


def one(df, doc, **where):
    rows = [r for r in df.where(df.doc_id == U + doc).collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1, rows
    return rows[0]


def test_events(cells):
    lake, ridge = (one(P.event_rows(cells), f"{x}/index.htm") for x in ("lake", "ridge"))
    assert (lake.name, lake.location, lake.venue, lake.date_range) == ("Lake Open 2031", "Nordhaven", "Hall Three", "3.2.2031 - 5.2.2031")
    assert (ridge.location, ridge.venue, ridge.date_range) == ("Ostmark / QQF", "Dome", "19.01.2033 - 22.01.2033")


def test_index(cells):
    index = P.index_rows(cells)
    category = one(index, "lake/index.htm", kind="category")
    assert (category.category, category.entries.url, category.result.href) == ("Cubs", U + "lake/CAT003EN.HTM", "CAT003RS.HTM")
    first, second = some(index, "lake/index.htm", kind="segment")
    assert (first.category, first.segment, first.details.href, first.officials.href) == ("Cubs", "Free Skating", "SEG007.HTM", "SEG007OF.HTM")
    assert (first.judges_scores.text, first.judges_scores.href) == ("Judges Scores (pdf)", "marks7.pdf")
    assert (second.category, second.segment, second.judges_scores) == ("Cubs", "Short Program", None)
    only = one(index, "bare/index.htm")
    assert (only.source_shape, only.entries, only.result.href) == ("category_result_pdf_only", None, "day.pdf")
    new = one(index, "ridge/index.htm", kind="segment")
    assert (new.category, new.segment, new.officials.href, new.details.href, new.judges_scores.href) == ("Pairs", "Rhythm Dance", "SEG020OF.htm", "SEG020.htm", "d20.pdf")


def test_schedule_and_index_rules(cells):
    schedule = P.schedule_rows(cells)
    assert [(r.date, r.time, r.segment, r.href) for r in some(schedule, "lake/index.htm")] == [("4.2.2031", "08:15:00", "Free Skating", "SEG007.HTM"), ("4.2.2031", "17:40:00", "Short Program", None), ("4.2.2031", "19:00:00", "Gala", None)]
    assert one(schedule, "ridge/index.htm").date == "20.01.2033"
    index = P.index_rows(cells)
    links = ["entries", "result", "officials", "details", "judges_scores"]
    issues = index_issues(index.select("doc_id", "kind", "category", "segment", *[index[c].href.alias(c) for c in links]), schedule).collect()
    assert {(r.doc_id[len(U) :], r.code) for r in issues} == {("bare/index.htm", "missing_category_entries"), ("lake/index.htm", "missing_segment_judges_scores"), ("lake/index.htm", "schedule_not_in_index")}


def test_entries_and_results(cells):
    entries = P.entry_rows(cells)
    assert [(r.entry_no, r.name, r.nation, r.category) for r in some(entries, "lake/CAT003EN.HTM")] == [(4, "Ilo Varn", "QQA", "Cubs"), (9, "Tam Orrel", "QQB", "Cubs")]
    first, second = some(entries, "ridge/CAT010EN.htm")
    assert (first.source_skater_id, first.nation, first.club, first.category) == ("isufs00700700", "QQG", "", "Pairs")
    assert (second.name, second.club, second.nation) == ("Odo Fenn", "Spur", "")
    results = some(P.category_result_rows(cells), "lake/CAT003RS.HTM", "final_place")
    assert [(r.final_place, r.name, r.club, r.nation, float(r.points), r.segment_places) for r in results] == [(1, "Tam Orrel", "Floe", "QQB", 61.4, {"SP": 1, "FS": 3}), (3, "Ilo Varn", "", "QQA", 48.25, {"SP": 2, "FS": 1})]


def test_segments_and_officials(cells):
    rows = P.segment_result_rows(cells)
    old = one(rows, "lake/SEG007.HTM")
    assert (old.name, old.club, old.club_display_name, old.starting_number, old.category, old.segment) == ("Tam Orrel", "QB", "North Floe QB", 11, "Cubs", "Free Skating")
    assert [float(old[c]) for c in ("tss", "tes", "pcs", "deduction")] == [31.05, 14.8, 16.75, 0.5] and {k: float(v) for k, v in old.components.items()} == {"tr": 2.25, "in": 2.5}
    new = one(rows, "ridge/SEG020.htm", place=1)
    assert (new.name, new.qualification, new.starting_number) == ("Odo Fenn", "Q", 3) and {k: float(v) for k, v in new.components.items()} == {"co": 5.05, "pr": 4.95, "sk": 5.1}
    assert not some(rows, "lake/SEG008.HTM")
    officials = P.official_rows(cells).orderBy("row_no").collect()
    assert [(r.role_group, r.judge_number, r.name) for r in officials] == [("technical_panel", None, "Ms. U W"), ("judge", 3, "Mr. O P"), ("other", None, "Ms. I J")]


def test_route_and_preflight(spark):
    docs = spark.createDataFrame([("u/CAT204EN.HTM", ""), ("u/SEG031OF.htm?x", ""), ("u/a.pdf", "%PDF-1"), ("u/b.pdf", "<html>"), ("u/w", '<meta HTTP-EQUIV="refresh" content="0; url=u/x">'), ("u/x", "<tr><th>Category</th>"), ("u/s", '<div id="root"></div>'), ("u/n", None)], "url string, body string")
    assert [r.page_type for r in P.route(docs).collect()][:4] == ["entries", "officials", "score_sheet", "score_sheet"]
    out = {r.url: r for r in resolution.preflight(docs).collect()}
    assert [out[u].source_class for u in ("u/a.pdf", "u/b.pdf", "u/w", "u/x", "u/s", "u/n")] == ["pdf", "html_fallback", "meta_refresh", "unknown_html", "unknown_html", "unknown_html"]


def test_a_broken_page_stops_no_other(spark):
    good = "<table><tr><th>No.</th><th>Name</th></tr><tr><td>1</td><td>Una</td></tr></table>"
    docs = spark.createDataFrame([("a/CAT1EN.HTM", good), ("b/CAT1EN.HTM", good + '<a href="http://[x">y</a>'), ("c/CAT1EN.HTM", good), ("d/CAT1EN.HTM", None)], "url string, body string").coalesce(1)
    read = P.read_pages(docs)
    assert sorted(r.doc_id for r in P.entry_rows(P.cells(docs)).collect()) == ["a/CAT1EN.HTM", "c/CAT1EN.HTM"]
    issue = P.page_issues(read).collect()
    assert [(r.code, r.url) for r in issue] == [("index_page_parse_failed", "b/CAT1EN.HTM")] and issue[0].message.startswith("ValueError")


def test_catalog(spark):
    line = lambda *parts: "".join(f"<div>{x}</div>" for x in parts)
    hill, bay = line("7 Sep - 9 Sep, 2032", "Hill Meet", "Aldeny / QQH", "FIGURE SKATING"), line("2 Oct - 6 Oct, 2032", "Bay Trophy", "O'Connel / QQJ", "FIGURE SKATING")
    listing = "".join(f'<a href="/x/eventdetail/{n}/">more</a>' for n in ("hill", "bay")) + hill + line("8 Sep - 8 Sep, 2032", "Sprint", "Y / Z", "SHORT TRACK") + bay + hill
    out = P.catalog_rows(spark.createDataFrame([("u", listing)], "url string, body string")).orderBy("detail_url").collect()
    assert [(r.event_name, r.city, r.country_code, r.detail_url) for r in out] == [("Bay Trophy", "O'Connel", "QQJ", "/x/eventdetail/bay/"), ("Hill Meet", "Aldeny", "QQH", "/x/eventdetail/hill/")]
    payload = r'<script>q([7,"{\"pageinfos\":{\"name\":\"Hill &amp; Dale Meet\",\"display_date\":\"7 Sep - 9 Sep, 2032\",\"city\":\"Aldeny\",\"country_code\":\"QQH\",\"detail_result_url\":\"https:\/\/r.invalid\/32\/?a=1&b=2\"}}"])</script>'
    row = P.detail_rows(spark.createDataFrame([("d", payload), ("e", "<p>")], "url string, body string")).orderBy("detail_url").collect()
    assert (row[0].event_name, row[0].date_range, row[0].city, row[0].country_code, row[0].result_url, row[0].discovery_status) == ("Hill & Dale Meet", "7 Sep - 9 Sep, 2032", "Aldeny", "QQH", "https://r.invalid/32/?a=1&b=2", "candidate_result_url")
    assert row[1].discovery_status == "catalog_only_needs_result_url"


def test_rows_read_as_cells_do(spark, cells):
    """A row for each table row gives every reading what a row for each cell gives it, without sending cells anywhere."""
    docs = spark.createDataFrame([(U + name, body.encode("windows-1252", "replace")) for name, body in PAGES.items()], "url string, body binary")
    rows = P.rows(docs).cache()
    for read in (P.entry_rows, P.category_result_rows, P.segment_result_rows, P.official_rows, P.index_rows, P.schedule_rows, P.header_map, resolution.index_yields):
        a, b = (sorted(map(str, read(x).select(sorted(read(x).columns)).collect())) for x in (cells, rows))
        assert a == b and (a or read is P.official_rows), read
    assert "Exchange" not in P.segment_result_rows(P.rows(docs))._jdf.queryExecution().executedPlan().toString()


def test_plain_pages_read_as_any_page():
    """Pages of plain tags, whole or in parts, against the parser of the standard library."""
    rng, plain = random.Random(5), 0
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td class="caption2">', '<a href="x.htm">', "<a>", "</a>", "<br />", "<br>", "<h2>", "</h2>", "&nbsp;", "&amp", "A & B", " text ", "x\xa0y", "<caption>", '<form action="q">', "<tr><td>a</td><td>b<br />c</td></tr>", "<tr><th>N<br/>=</th><td> </td></tr>", '<tr class="caption3">', "<P>", "<TD>", "<td/>", "<!-- c -->", "<td a='b'>", "<"]
    key = lambda c: (c["kind"], c["table_no"], c["row_no"], c["cell_no"], c["text"])
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        page = P._Page("u", "u")
        page.feed(text)
        page.close()
        want = sorted([c | {"links": list(c["links"])} for c in page.rows()], key=key)
        for part in (10**9, 1, 3):
            for read in (P._parts, P._parsed):
                try:
                    assert sorted([c | {"links": list(c["links"])} for rows in read("u", text, part) for c in rows], key=key) == want, text
                    plain += read is P._parts
                except P._Odd:
                    pass
    assert plain > 2000


def test_a_large_page_is_held_in_parts(spark):
    """A page of more cells than are gathered at once: all rows, with the headers and the title that end and begin it."""
    n = P._ROWS
    body = "<h2>Open</h2><h2>Cubs</h2><table>" + "".join(f"<tr><td>{i}</td><td>N{i}</td></tr>" for i in range(n)) + "<tr><th>No.</th><th>Name</th></tr></table>"
    packed = P._page_parts("u", body, P._Packed, P._ROWS)
    assert len(packed) > 1 and sum(len(p.places) for p in packed) == n + 1
    out = P.entry_rows(P.rows(spark.createDataFrame([("u", body)], "url string, body string"))).selectExpr("count(*)", "count(distinct entry_no)", "min(category)", "max(entry_no)").first()
    assert tuple(out) == (n, n, "Cubs", n - 1)


def test_plain_tables_are_cut_whole(monkeypatch):
    """A page that is one plain table is never parsed tag by tag, and gives the rows that parsing gives."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["", "Pl.", "TSS<br />=", "&nbsp;", "a  b", " a", "a ", "a\xa0b", "x\tz", "\x1f", "�", "&amp;lt;", "<br>", "a<br/> b", "&#13;1", "Line 7", "#4", "Name", "\u2003m", "1 &lt; 2"]
    plain = lambda: table(*[[rng.choice(texts) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(4))], head=rng.choice([None, ("Pl.", "Name", rng.choice(texts))]), caption=rng.choice(["", "<caption> </caption>", caption("Open"), caption("Open", rng.choice(texts[:1] + texts[4:]).replace("<", "")), caption("", "Open", "A - B"), caption("O", "p", "q")]))
    head = "<tr><th>Name</th><th>No.</th></tr>"
    pages = [plain() for _ in range(400)] + [f"<table><tr><td>1</td></tr>{head}<tr><td>2</td></tr>{head}</table>", f"<table>{head}</table>", "<table></table>"]
    odd = ["", None, "x", "<table>", f"<table>{head}", f"<table>{head}</table> ", f"<table>{head}<tr><td>a</th></tr></table>", "<table><tr><th>a</th><td>b</td></tr></table>", "<table><tr></tr></table>", f"<table>{head}<tr><td class=\"q\">a</td></tr></table>", f"<TABLE>{head}</TABLE>", f"<table>{head}<tr><td>a<b>c</b></td></tr></table>", table(("&#" + "9" * 5000 + ";",), head=("Name",)), table((link("a.htm", "b"),), head=("Name",)), plain() + plain(), "<title>t</title>" + table(("1",), head=("Name",))]

    def read(bodies):
        kind = pa.binary() if any(isinstance(x, bytes) for x in bodies) else pa.string()
        batch = pa.RecordBatch.from_arrays([pa.array([f"{U}{i}" if i % 50 else None for i in range(len(bodies))]), pa.array(bodies, kind)], names=["url", "body"])
        out = list(P._read_rows(iter([batch])))
        assert len({x.schema for x in out}) <= 1
        return sorted((r for x in out for r in x.to_pylist()), key=repr)

    encoded = [x and x.encode("windows-1252", "replace") for x in odd + pages]
    with monkeypatch.context() as m:
        m.setattr(P._Plain, "add", lambda *_: False)
        want, want_encoded = read(odd + pages), read(encoded)
    assert len(want) > 700 and read(odd + pages) == want and read(encoded) == want_encoded
    monkeypatch.setattr(P, "_ROWS", 5)
    assert read(odd + pages) == want
    monkeypatch.undo()
    monkeypatch.setattr(P, "_Page", None)
    assert len(read(pages)) > 600
