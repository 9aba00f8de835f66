"""Source checks against plain walks over small sets of pages."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from resultmart.functions.text import join_url
from resultmart.plans import pages, resolution

H = "http://a.invalid/x/"


def go(to):
    return f'<html><META http-equiv=refresh content="0; url={to}"></html>'


def test_addresses_are_joined_as_by_the_standard_library(spark):
    bases = ["http://a.invalid/x/y.htm", "http://a.invalid", "http://a.invalid/x/y/z/?q=1#f", "https://b.invalid:8080/p"]
    refs = ["main.htm", "/m.htm", "../m.htm", "../../../m", "./m/./n", "//c.invalid/d", "http://d.invalid/e", "?q=2", "#top", "", "m.htm?a=../b", "..", "a/b/..", ".hidden/x"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", join_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    to = {x: rng.choice([*nodes, "out1", "out2", x]) for x in nodes[:50]} | {f"c{i}": f"c{i + 1}" for i in range(37)} | {"p": "q", "q": "p"}
    df = spark.createDataFrame(list(to.items()), "source string, target string")

    def walk(x, most):
        n, seen = 0, {x}
        while x in to and n < most:
            x, n = to[x], n + 1
            if x in seen and most > 1000:
                return None, None, True
            seen.add(x)
        return x, n, False

    found = {r.source: (r.target, r.hops, r.loops) for r in resolution.follow_links(df).collect()}
    assert found == {x: walk(x, 10_000) for x in to}
    for hops in (1, 2, 3, 6):
        found = {r.source: (r.target, r.hops, r.loops) for r in resolution.follow_links(df, hops).collect()}
        assert found == {x: (*walk(x, hops)[:2], walk(x, 10_000)[2]) for x in to}
    assert resolution.follow_links(df.limit(0), 3).count() == 0


def test_kinds_and_chains(spark):
    index = "<html>made by FS Manager</html>"
    docs = {
        "a.htm": index, "b.htm": "<th>Category</th>", "c/": '<html><script src="scripts/results.js"></script><body> </body></html>', "c/pages/main.htm": "ISUCalcFS",
        "d.htm": "<iframe></iframe> ISUCalcFS", "e.pdf": "%PDF-1.4", "f.pdf": "<html>moved</html>", "g.htm": '<!DOCTYPE html><div id="root"></div><script src="/assets/index-1.js">', "h/": '<a href="scripts/results"></a><body></body>',
        "1.htm": go("a.htm"), "2.htm": go("/x/1.htm"), "3.htm": go("2.htm"), "4.htm": go("3.htm"), "l.htm": go("m.htm"), "m.htm": go("l.htm"), "n.htm": go("gone.htm"), "w.htm": go("c/"), "z.htm": None,
    }
    df = spark.createDataFrame([(H + k, v) for k, v in docs.items()], "url string, body string")
    out = {r.url[len(H) :]: r for r in resolution.check_sources(df).collect()}
    kinds = {k: r.content_kind for k, r in out.items()}
    assert kinds == {
        "a.htm": "html", "b.htm": "unknown_html", "c/": "html", "c/pages/main.htm": "html", "d.htm": "html", "e.pdf": "pdf", "f.pdf": "html_fallback", "g.htm": "site_fallback", "h/": "html_wrapper",
        "1.htm": "html", "2.htm": "html", "3.htm": "html", "4.htm": "unknown_html", "l.htm": "unknown_html", "m.htm": "unknown_html", "n.htm": "unreachable", "w.htm": "html", "z.htm": "unknown_html",
    }
    assert [(out[k].resolved_url, out[k].resolution, out[k].hops, out[k].loops) for k in ("3.htm", "w.htm", "c/", "a.htm", "m.htm")] == [
        (H + "a.htm", "meta_refresh", 3, False), (H + "c/pages/main.htm", "scripts_results_wrapper", 1, False), (H + "c/pages/main.htm", "scripts_results_wrapper", 0, False), (None, None, 0, False), (H + "l.htm", "meta_refresh", 3, True),
    ]
    assert out["3.htm"].body == index and out["w.htm"].body == "ISUCalcFS" and out["z.htm"].body is None
    assert {r.status for k, r in out.items() if kinds[k] in ("html", "pdf")} == {"passed"} and out["h/"].reason.startswith("old")
    far = {r.url[len(H) :]: (r.content_kind, r.hops) for r in resolution.check_sources(df, hops=None).collect()}
    assert far["4.htm"] == ("html", 4) and far["l.htm"] == ("unreachable", None)


def test_reading_with_more_categories(spark):
    cell = lambda *x: "<tr>" + "".join(f"<td>{y}</td>" for y in x) + "</tr>"
    new = "<table><tr><th>x</th></tr></table><table><tr><th>Category</th><th>Segment</th><th>Reports</th></tr>" + cell("", "lost", "", "", "") + cell("Men", "", "e", "r", "") + cell("", "Short", "o", "d", "j") + cell("", "Free", "o", "d", "j") + "</table>"
    old = "<table><tr><td>Category</td></tr>" + cell("Men", "result") + cell("Women", "", "e", "r", "") + cell("", "Short", "o", "d", "j") + cell("", "", "o", "d", "j") + "</table>"
    both = old + new
    docs = {"new": new, "old": old, "both": both, "old marked": old + "FS Manager ISUCalcFS", "wrongly marked": old + "FS Manager", "none": "<p>text</p>", "null": None}
    df = spark.createDataFrame(list(docs.items()), "url string, body string")
    found = {r.url: (r.parser_profile, r.platform, r.n_categories, r.n_segments, r.validation_status) for r in resolution.choose_parser(df).collect()}
    assert found == {
        "new": ("fs_manager", None, 1, 2, "passed"), "old": ("old_isucalcfs", None, 2, 1, "passed"), "both": ("old_isucalcfs", None, 2, 1, "passed"), "old marked": ("old_isucalcfs", "ISUCalcFS", 2, 1, "passed"),
        "wrongly marked": ("fs_manager", "FS Manager", 0, 0, "failed"), "none": ("fs_manager", None, 0, 0, "failed"), "null": ("fs_manager", None, 0, 0, "failed"),
    }
    assert pages.cells(df).count() > 0


def test_a_walk_of_some_steps_asks_for_no_ends(spark, monkeypatch):
    """A walk of three steps is three joins; following to the ends takes one join a round."""
    calls = []
    compose = resolution._compose
    monkeypatch.setattr(resolution, "_compose", lambda a, b: calls.append(1) or compose(a, b))
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)] + [("a", "b"), ("b", "a")], "source string, target string")
    three = {r.source: (r.target, r.hops) for r in resolution.walk_links(links, 3).collect()}
    assert three == {"0": ("3", 3), "1": ("4", 3), "2": ("5", 3), "3": ("6", 3), "4": ("6", 2), "5": ("6", 1), "a": ("b", 3), "b": ("a", 3)} and len(calls) == 2
    ends = {r.source: (r.target, r.hops, r.loops) for r in resolution.follow_links(links).collect()}
    assert ends == {str(i): ("6", 6 - i, False) for i in range(6)} | {x: (None, None, True) for x in "ab"}
