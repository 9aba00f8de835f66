"""Score-sheet texts in every layout."""

import random
import re

import pytest

from resultmart.plans import sheets as S
from resultmart.plans.quality import score_mismatches

VERTICAL = "Lake Open 2031\nCUBS FREE SKATING      JUDGES DETAILS PER SKATER\nStarting\nNumber\nNation\nName\nIlo Varn\nQQA\n30.40\n2.50\n18.20\n14.70\n3\n8\nprinted: 9"
HEAD = "RankName NationStartingNumberTotalSegmentScoreTotalElementScoreTotal ProgramComponent Score(factored)TotalDeductions"
END = "#Executed Elements"
COMPACT = f"RIDGE CUP 2033JUDGES DETAILS PER SKATERPAIRS FREE DANCE\nprinted: y\n{HEAD}2Una Reed QQG 6 91.1050.60 40.50 0.00{END}\nInfo\n{HEAD}5Odo FennQQG 1 64.0533.05 32.00-1.00{END}"
GLUED = f"{HEAD}3Pia LomQQK 14 25.5011.25 14.25 0.00{END}"
NO_ELEMENTS = f"{HEAD.replace('TotalDeductions', 'Total Deductions')}\n4Wim AstQQL 2 21.60 21.60 0.00{END}"
AVERAGED = f"{HEAD}\n2Ada Birk / Jon EskQQM 5 18.3018.00 18.60 0.00{END}"
WRONG = f"{HEAD}\n1Nobody XQQN 2 77.7018.00 18.60 0.00{END}"
TABLE = """Rank Name Nation
2 Una Reed QQG 6 21.94 14.44 8.00 -0.50
# Executed Elements ofnI Base GOE
1 2S 1.30 0.26 2 2 2 2 1.56
2 1Lo* * 0.00 0.00 - - - - 0.00
3 CCoSp3 3.00 0.60 2 2 - 2 3.60
4 3Lz!<<+2T+COMBO F REP 5.10 -1.55 -5 -5 -4 -5 3.55
5 2Lzb b 2.10 0.63 3 3 3 3 1.00 3.73
6 StSq2 2.00 0.00 0 0 1 0 2.00
13.50 14.44
Program Components Factor
Presentation 1.00 4.00 4.25 3.75 4.00 4.00
Composition 1.00 4.00 4.00 4.00 4.25 4.00
Judges Total Program Component Score (factored) 8.00
Deductions: Falls -0.50 (1) -0.50
7 Odo Fenn QQG 1 9.10 4.10 5.00 0.00
# Executed Elements
1 2F 1.80 0.30 1 2 2.10
2 2T< < 1.04 0.96 1 1 2.00
2.84 4.10
Deductions: 0.00"""


@pytest.fixture(scope="module")
def sheets(spark):
    return spark.createDataFrame([("v", VERTICAL), ("c", COMPACT), ("g", GLUED), ("e", NO_ELEMENTS), ("m", AVERAGED), ("w", WRONG), ("t", TABLE), ("n", None)], "doc_id string, text string")


def numbers(r):
    return [float(r[c]) for c in ("total_segment_score", "total_element_score", "total_program_component_score", "total_deductions")]


def test_line_layouts(sheets):
    out = {(r.doc_id, r["name"]): r for r in S.sheet_summaries(sheets).collect()}
    assert set(out) == {("v", "Ilo Varn"), ("t", "Una Reed"), ("t", "Odo Fenn")}
    v = out["v", "Ilo Varn"]
    assert (v["rank"], v.starting_number, v.nation) == (3, 8, "QQA") and numbers(v) == [30.4, 14.7, 18.2, 2.5]
    assert numbers(out["t", "Una Reed"]) == [21.94, 14.44, 8.0, 0.5]


def test_compact_layouts(sheets):
    out = {(r.doc_id, r["rank"]): r for r in S.sheet_blocks(sheets).collect()}
    assert set(out) == {("c", 2), ("c", 5), ("g", 3), ("e", 4), ("m", 2)}
    assert numbers(out["c", 2]) == [91.1, 50.6, 40.5, 0.0] and (out["c", 5]["name"], out["c", 5].nation, out["c", 5].starting_number) == ("Odo Fenn", "QQG", 1) and numbers(out["c", 5])[3] == 1.0
    assert (out["g", 3]["name"], out["g", 3].nation) == ("Pia Lom", "QQK") and numbers(out["g", 3]) == [25.5, 11.25, 14.25, 0.0]
    assert numbers(out["e", 4]) == [21.6, 0.0, 21.6, 0.0] and out["m", 2]["name"] == "Ada Birk / Jon Esk" and numbers(out["m", 2])[:3] == [18.3, 18.0, 18.6]
    assert score_mismatches(S.sheet_blocks(sheets)).count() == 0


def test_elements_and_components(sheets):
    sections = S.sheet_sections(S.lines(sheets.where("doc_id = 't'")))
    e = S.element_rows(sections).orderBy("skater_no", "element_no").collect()
    assert [r.element_code for r in e] == ["2S", "1Lo*", "CCoSp3", "3Lz!<<+2T+COMBO", "2Lzb", "StSq2", "2F", "2T<"]
    assert e[1].judge_scores == [None] * 4 and e[2].judge_scores == [2, 2, None, 2] and e[6].judge_scores == [1, 2]
    assert [r.base_element_code for r in e[1:5]] == ["1Lo", "CCoSp3", "3Lz+2T+COMBO", "2Lz"] and [r.info for r in e[3:5]] == ["F REP", "b"]
    assert [r.markers for r in e] == [[], ["*"], [], ["!", "<<", "F", "REP"], ["b"], [], [], ["<"]] and float(e[4].bonus) == 1.0
    c = {r.component_name: r for r in S.component_rows(sections).collect()}
    assert set(c) == {"Presentation", "Composition"} and [float(x) for x in c["Presentation"].judge_scores] == [4.0, 4.25, 3.75, 4.0] and float(c["Composition"].score) == 4.0
    d = {r.skater_no: r for r in S.sheet_details(sections).collect()}
    assert (float(d[1].base_value_total), float(d[1].element_score_total), d[1].judge_count, float(d[1].deductions)) == (13.5, 14.44, 4, 0.5)
    assert (d[2].judge_count, float(d[2].deductions)) == (2, 0.0)


def test_gate_and_preference(spark, sheets):
    docs = spark.createDataFrame([("a", "Judges Scores (pdf)", "%PDF-"), ("b", "Time Schedule", "%PDF-"), ("c", "judges scores", "<html>"), ("d", None, None)], "url string, link_text string, body string")
    good, issues = S.gate_sheets(docs)
    assert [r.url for r in good.collect()] == ["a"] and {(r.url, r.level) for r in issues.collect()} == {("b", "info"), ("c", "warning"), ("d", "info")}
    out = S.prefer_sheet_source(text=S.sheet_summaries(sheets), blocks=S.sheet_blocks(sheets))
    assert {(r.doc_id, r.sheet_source) for r in out.collect()} == {("v", "text"), ("t", "text"), ("c", "blocks"), ("g", "blocks"), ("e", "blocks"), ("m", "blocks")}
    cells = spark.createDataFrame([("d", 0, ["No", "Name", "Club", "Result"]), ("d", 1, ["1.", " A ", "X", "Покрил норматива"]), ("d", 2, ["2", "B", "Y", "failed"])], "doc_id string, row_no int, cells array<string>")
    assert [(r.number, r["name"], r.passed) for r in S.test_rows(cells).collect()] == [(1, "A", True), (2, "B", False)]
    title = {r.doc_id: (r.before, r.after) for r in S.sheet_titles(sheets).collect()}
    assert title["c"] == ("RIDGE CUP 2033", "PAIRS FREE DANCE")


def test_sections_equal_a_plain_walk_and_need_no_shuffle(spark):
    rng = random.Random(4)
    pool = [*TABLE.split("\n"), *VERTICAL.split("\n"), "# Executed", "program components x", "", "  "]
    docs = [(f"d{i}", "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 50)))) for i in range(150)] + [("none", None), ("empty", "")]
    expected = []
    for doc, text in docs:
        skater, section = 0, None
        for i, line in enumerate(x for x in (" ".join(y.split()) for y in (text or "").split("\n")) if x):
            low = line.lower()
            if re.match(S.SUMMARY.replace(r"\z", r"\Z"), line):
                skater, section = skater + 1, "summary"
            elif re.match("#? ?executed elements|# executed", low):
                section = "elements"
            elif low.startswith("program component"):
                section = "components"
            expected.append((doc, i, line, skater, section))
    found = S.sheet_sections(S.lines(spark.createDataFrame(docs, "doc_id string, text string")))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_sections_begin_where_told(spark):
    docs = spark.createDataFrame([("a", "x\n# Executed\ny\nz", [2]), ("b", "x\ny", None)], "doc_id string, text string, starts array<int>")
    rows = S.sheet_sections(S.lines(docs).join(docs.select("doc_id", "starts"), "doc_id"), "starts").orderBy("doc_id", "line_no").collect()
    assert [(r.skater_no, r.section) for r in rows] == [(0, None), (0, "elements"), (1, "summary"), (1, "summary"), (0, None), (0, None)]


def test_sheets_are_read_once(spark, tmp_path):
    """Details take one pass over the sheets; texts written by order stay where the order's lines were numbered."""
    from resultmart.plans import judged

    rows = [(1, 1, 7, 8, 12.0, 100.0, "R"), (1, 2, 7, 8, 3.0, 90.0, "N"), (2, 1, 9, 8, 5.0, 80.0, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    written = judged._sheets(spark, str(tmp_path))
    assert written._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    details = judged.sheet_details(spark, str(tmp_path))
    assert plan(details).count("parquet") == plan(written).count("parquet") and "Join" not in plan(details)
    assert sorted((r.l_orderkey, r.skater_no, r.judge_count, r.deductions) for r in details.collect()) == [(1, 1, 4, 0.5), (1, 2, 3, 0.0), (2, 1, 3, 0.0)]
