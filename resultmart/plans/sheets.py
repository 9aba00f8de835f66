"""Extraction of score sheets from their text: summaries in several layouts, elements, components, deductions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.functions.text import base_element, blank_to_null, element_markers

NUMBER = "decimal(10,3)"
#: The layout of lines.
SUMMARY = r"^(\d+) (.+?) ?([A-Z]{3}) (\d+) (\d+\.\d\d) (?:(\d+\.\d\d) )?(\d+\.\d\d) (-?\d+\.\d\d)\z"
ELEMENT = r"^(\d+) (\S+) (?:(.*?) )??(\d+\.\d+) (?:(.*?) )??(-?\d+\.\d+)((?: (?:-?\d+|-))+)(?: (\d+\.\d+))? (-?\d+\.\d+)\z"
COMPONENT = r"^([A-Z][A-Za-z /&]+?) (\d+\.\d\d)((?: \d+\.\d\d)+) (\d+\.\d\d)\z"
BLOCK = r"(?s)Total\s*Deductions\s*(.{3,200}?)#\s*Executed"
COMPACT = r"(?s)^(\d+)\s*(.+?)\s*([A-Z]{3})\s+(\d+)\s+([\d.\s-]+)\z"
TITLE = r"(?s)^(.*?)JUDGES DETAILS PER SKATER(.*)\z"


def _num(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast(NUMBER)


def lines(sheets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each sheet: doc_id and its lines that aren't blank, in order; null for a sheet without a text."""
    parts = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return sheets.select(F.col(doc_id).alias("doc_id"), parts.alias("lines"))


def split_scores(c: Column) -> Column:
    """(tss, tes, pcs, deduction) of numbers that may stand without a gap.

    Every number ends two digits after its point, so there is one way to cut them. Four numbers, or three without
    elements, count only if the total is the sum or the average of its parts within 0.02. The deduction is absolute.
    """
    packed = F.regexp_replace(c, r"\s+", "")
    return _once(F.struct(packed.alias("text"), F.regexp_extract_all(packed, F.lit(r"-?\d+\.\d{2}"), F.lit(0)).alias("tokens")), lambda x: _once(_cut(x), _weighed))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _cut(x: Column) -> Column:
    """Three or four numbers as values of a summary; null for other texts."""
    n = F.size(x.tokens)
    at = lambda i: F.get(x.tokens, F.lit(i)).try_cast(NUMBER)
    zero = F.lit(0).cast(NUMBER)
    tes, pcs, d = F.when(n == 4, at(1)).otherwise(zero), F.when(n == 4, at(2)).otherwise(at(1)), F.abs(F.when(n == 4, at(3)).otherwise(at(2)))
    return F.when((F.array_join(x.tokens, "") == x.text) & n.isin(3, 4), F.struct(at(0).alias("tss"), tes.alias("tes"), pcs.alias("pcs"), d.alias("deduction")))


def _weighed(s: Column) -> Column:
    """The values if the total is the sum or the average of its parts."""
    near = lambda x: F.abs(s.tss - x) <= F.lit("0.02").cast(NUMBER)
    parts, half = s.tes + s.pcs, (s.tes + s.pcs) / 2
    return F.when(near(parts - s.deduction) | near(parts + s.deduction) | near(half - s.deduction) | near(half + s.deduction), s)


def groups_of(c: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that matches a whole line, by one match; null for other lines."""
    mark = "\x01"
    found = F.split(F.regexp_replace(c, pattern, mark + mark.join(f"${i}" for i in range(1, n + 1))), mark, -1)
    return _once(found, lambda x: F.when(F.size(x) == n + 1, x))


def _summary(line_no, rank, name, nation, start, tss, tes, pcs, d) -> Column:
    who = [line_no.alias("line_no"), rank.try_cast("int").alias("rank"), F.btrim(name).alias("name"), nation.alias("nation"), start.try_cast("int").alias("starting_number")]
    return F.struct(*who, tss.alias("total_segment_score"), tes.alias("total_element_score"), pcs.alias("total_program_component_score"), F.abs(d).alias("total_deductions"))


def _line_summaries(every: Column) -> Column:
    """Skaters whose summary is one line, as structs with the number of that line."""
    def read(line: Column, i: Column) -> Column:
        return _once(groups_of(line, SUMMARY, 8), lambda x: F.when(x.isNotNull(), _summary(i, *[F.get(x, F.lit(k)) for k in range(1, 5)], _num(F.get(x, F.lit(5))), F.coalesce(_num(F.get(x, F.lit(6))), F.lit(0).cast(NUMBER)), _num(F.get(x, F.lit(7))), _num(F.get(x, F.lit(8))))))

    return F.filter(F.transform(every, read), lambda x: x.isNotNull())


def _vertical_summaries(every: Column) -> Column:
    """Skaters whose eight values stand on lines of their own: name, nation, total, deductions, components, elements, rank, start."""
    def read(line: Column, i: Column) -> Column:
        v = lambda k: F.get(every, i + k)
        ok = v(1).rlike(r"^[A-Z]{3}\z")
        for k in (2, 3, 4, 5):
            ok = ok & v(k).rlike(r"^-?\d+\.\d\d\z")
        for k in (6, 7):
            ok = ok & v(k).rlike(r"^\d+\z")
        return F.when(ok, _summary(i, v(6), line, v(1), v(7), _num(v(2)), _num(v(5)), _num(v(4)), _num(v(3))))

    return F.filter(F.transform(every, read), lambda x: x.isNotNull())


def sheet_summaries(sheets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Summaries in either line layout; one-line summaries count where a sheet has both. One pass over the sheets."""
    found = lambda every: _once(_line_summaries(every), lambda one: F.when(F.size(one) > 0, one).otherwise(_vertical_summaries(every)))
    rows = lines(sheets, doc_id, text).select("doc_id", F.explode_outer(_once(F.col("lines"), found)).alias("s"))
    return rows.where("s IS NOT NULL").select("doc_id", "s.*")


def sheet_blocks(sheets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Summaries of compact sheets, whose columns run into one another between two known headings."""
    blocks = sheets.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))).alias("line_no", "block"))
    b = F.btrim("block")
    g = lambda i: F.regexp_extract(b, COMPACT, i)
    rows = blocks.where(b.rlike(COMPACT)).withColumn("s", split_scores(g(5))).where("s IS NOT NULL")
    return rows.select("doc_id", _summary(F.col("line_no"), g(1), g(2), g(3), g(4), F.col("s.tss"), F.col("s.tes"), F.col("s.pcs"), F.col("s.deduction")).alias("s")).select("doc_id", "s.*")


def sheet_titles(sheets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts before and after the heading of a sheet: event, and category with segment."""
    head = F.split(text, "(?i)(printed:|\nStarting\n|RankName)")[0]
    before, after = (F.btrim(F.regexp_replace(F.regexp_extract(head, TITLE, i), r"\n", " ")) for i in (1, 2))
    return sheets.select(F.col(doc_id).alias("doc_id"), before.alias("before"), after.alias("after"))


def sheet_sections(lines_: DataFrame, starts: str | None = None) -> DataFrame:
    """Lines with skater_no (0 before the first) and section: summary, elements or components.

    A skater begins at the lines whose numbers the array column ``starts`` holds (null: none); without it, at one-line
    summaries. A sheet's lines that begin a section are folded in order, with the skater and the section as state; each
    section is then a slice of the sheet, so that no line is sorted or sent anywhere. A sheet without a text has no lines.
    """
    def section(line: Column, i: Column) -> Column:
        begins = line.rlike(SUMMARY) if starts is None else F.coalesce(F.array_contains(starts, i), F.lit(False))
        low = F.lower(line)
        return F.when(begins, "summary").when(low.rlike(r"^#? ?executed elements|^# executed"), "elements").when(low.startswith("program component"), "components")

    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), section(x, i).alias("section"))), lambda m: m.section.isNotNull())
    none = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("skater_no"), F.lit(None).cast("string").alias("section"))

    def step(state: Column, m: Column) -> Column:
        skater = state.skater_no + F.when(m.section == "summary", 1).otherwise(0)
        return F.struct(skater.alias("skater_no"), F.array_append(state.runs, F.struct(m.at.alias("at"), skater.alias("skater_no"), m.section.alias("section"))).alias("runs"))

    runs = F.aggregate(marks, F.struct(none.skater_no.alias("skater_no"), F.array(none).alias("runs")), step, lambda state: state.runs)
    until = lambda held, k: F.coalesce(F.get(held, k + 1)["at"], F.size("lines"))
    cut = _once(runs, lambda held: F.transform(held, lambda r, k: F.struct(r.at.alias("at"), r.skater_no.alias("skater_no"), r.section.alias("section"), F.slice("lines", r.at + 1, until(held, k) - r.at).alias("lines"))))
    parts = lines_.select("doc_id", F.explode_outer(cut).alias("r"))
    rows = parts.select("doc_id", "r.at", "r.skater_no", "r.section", F.posexplode_outer("r.lines").alias("n", "line")).where("line IS NOT NULL")
    return rows.select("doc_id", (F.col("at") + F.col("n")).alias("line_no"), "line", "skater_no", "section")


def _marks(text: Column, kind: str) -> Column:
    return F.transform(F.split(F.btrim(text), " "), lambda x: x.try_cast(kind))


def _matched(rows: DataFrame, pattern: str, n: int) -> DataFrame:
    """Rows whose line matches, with its groups. A filter on the groups would match every line once more."""
    return rows.withColumn("groups", F.explode(F.array_compact(F.array(groups_of(F.col("line"), pattern, n)))))


def element_rows(sections: DataFrame) -> DataFrame:
    """Executed elements with markers, values and judges' marks; a dash is no mark."""
    g = lambda i: F.get("groups", F.lit(i))
    info = blank_to_null(F.btrim(F.concat_ws(" ", F.nullif(g(3), F.lit("")), F.nullif(g(5), F.lit("")))))
    rows = _matched(sections.where("section = 'elements'"), ELEMENT, 9)
    return rows.select(
        "doc_id", "skater_no", g(1).try_cast("int").alias("element_no"), g(2).alias("element_code"), base_element(g(2)).alias("base_element_code"), F.col("line").alias("raw_element"), info.alias("info"), element_markers(g(2), info).alias("markers"),
        _num(g(4)).alias("base_value"), _num(g(6)).alias("goe"), _marks(g(7), "int").alias("judge_scores"), _num(g(8)).alias("bonus"), _num(g(9)).alias("panel_score"),
    )


def component_rows(sections: DataFrame) -> DataFrame:
    g = lambda i: F.get("groups", F.lit(i))
    rows = _matched(sections.where((F.col("section") == "components") & ~F.col("line").startswith("Judges Total")), COMPONENT, 4)
    return rows.select("doc_id", "skater_no", g(1).alias("component_name"), _num(g(2)).alias("factor"), _marks(g(3), NUMBER).alias("judge_scores"), _num(g(4)).alias("score"))


def sheet_details(sections: DataFrame) -> DataFrame:
    """Per skater the sums of base values and element scores, the number of judges and the deductions, in one pass."""
    two = r"^(\d+\.\d\d) (\d+\.\d\d)\z"
    amount = F.element_at(F.concat(F.array(F.lit("0.00")), F.regexp_extract_all("line", F.lit(r"-\d+\.\d\d"), F.lit(0))), -1).try_cast(NUMBER)
    marks = lambda pattern, n, k: _once(groups_of(F.col("line"), pattern, n), lambda x: F.when(x.isNotNull(), F.size(F.split(F.btrim(F.get(x, F.lit(k))), " "))))
    judges = F.when(F.col("section") == "elements", marks(ELEMENT, 9, 7)).when((F.col("section") == "components") & ~F.col("line").startswith("Judges Total"), marks(COMPONENT, 4, 3))
    return sections.where("skater_no > 0").groupBy("doc_id", "skater_no").agg(
        F.max(F.when((F.col("section") == "elements") & F.col("line").rlike(two), _num(F.regexp_extract("line", two, 1)))).alias("base_value_total"),
        F.max(F.when((F.col("section") == "elements") & F.col("line").rlike(two), _num(F.regexp_extract("line", two, 2)))).alias("element_score_total"),
        F.max(F.when(F.col("line").startswith("Deductions"), F.abs(amount))).alias("deductions"),
        F.max(judges).alias("judge_count"),
    )


#: Fixed value: how a passed result begins.
PASSED = "Покрил"


def test_rows(rows: DataFrame, passed: str = PASSED) -> DataFrame:
    """Rows of a beginners' test from table cells (doc_id, row_no, cells): number, name, club, result and whether it is passed."""
    c = lambda i: F.btrim(F.get("cells", F.lit(i)))
    out = rows.where(c(0).rlike(r"^\d+\.?\z")).select("doc_id", "row_no", F.regexp_extract(c(0), r"\d+", 0).cast("int").alias("number"), c(1).alias("name"), c(2).alias("club"), c(3).alias("result"))
    return out.withColumn("passed", F.col("result").startswith(passed))


def prefer_sheet_source(**branches: DataFrame) -> DataFrame:
    """Of several readings of a sheet, in the order given, the first that has rows; all have the same columns."""
    tagged = [df.withColumns({"_rank": F.lit(i), "sheet_source": F.lit(name)}) for i, (name, df) in enumerate(branches.items())]
    every = reduce(DataFrame.unionByName, tagged)
    return every.withColumn("_best", F.min("_rank").over(Window.partitionBy("doc_id"))).where("_rank = _best").drop("_rank", "_best")


def gate_sheets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, issues) of linked sheets (url, link_text, body): the link has to name judges' scores, the body to be a PDF."""
    named = F.lower(F.coalesce("link_text", F.lit(""))).contains("judges scores")
    pdf = F.coalesce(F.col("body").cast("string"), F.lit("")).startswith("%PDF")
    # fixed values: codes, levels and the beginnings of messages
    code = F.when(~named, "skipped_non_judges_pdf_report").when(~pdf, "invalid_pdf_response")
    checked = documents.withColumn("code", code)
    skipped = F.col("code") == "skipped_non_judges_pdf_report"
    message = F.when(skipped, F.concat(F.lit("Skipped non-judges report link: "), F.coalesce(blank_to_null(F.col("link_text")), "url"))).otherwise(F.concat(F.lit("Expected PDF bytes but source returned "), F.substring(F.coalesce(F.col("body").cast("string"), F.lit("")), 1, 40)))
    issues = checked.where("code IS NOT NULL").select("url", "link_text", "code", F.when(skipped, "info").otherwise("warning").alias("level"), message.alias("message"))
    return checked.where("code IS NULL").drop("code"), issues
