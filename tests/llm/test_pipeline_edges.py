"""Every stage of the pipeline on nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STEP = dict(corpus_pipeline.STAGES)
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour twentyfive twentysix twentyseven twentyeight twentynine thirty"
OTHER = "nothing of this text stands anywhere else in these rows at all"
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE + " more", "en", "a", 1),
    (2, OTHER, "en", "a", 1),
    (3, None, None, None, None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n ", "en", "a", 0),
    (6, "few words", "en", "a", 0),
    (6, "few words", "en", "b", 0),
    (7, " ".join(f"w{i}" for i in range(20_000)), "en", "a", 0),
    (None, BASE, "en", "a", 1),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, node string, cid int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies_go_row_by_row(spark, docs, nothing):
    out = STEP["n-gram Jaccard join"](spark, docs, SF)
    gone = [(2, BASE + " more"), (6, "few words")]
    want = [(r[0], r[1]) for r in ROWS]
    for r in gone:
        want.remove(r)
    assert rows(out) == sorted(want, key=str) and out.columns == COLUMNS
    assert [r.source for r in out.where("doc_id = 6").collect()] == ["a"]
    assert STEP["n-gram Jaccard join"](spark, nothing, SF).count() == 0


def test_one_id_with_two_near_copies(spark):
    df = spark.createDataFrame([(5, BASE, None, None, 1), (5, BASE + " x", None, None, 1), (9, BASE + " y", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = rows(STEP["n-gram Jaccard join"](spark, df, SF))
    assert len(out) == 1 and out[0][0] == 5


def test_lines(spark, docs, nothing):
    out = STEP["line deduplication"](spark, docs, SF)
    assert out.columns == COLUMNS and STEP["line deduplication"](spark, nothing, SF).count() == 0
    found = rows(out)
    assert found.count((3, "")) == 2 and (None, BASE) in found and (1, BASE) in found and (5, " \n ") in found and len(found) == len(ROWS)
    more = docs.union(spark.createDataFrame([(8, BASE + "\nshort", "en", "a", 1, "x", 1), (9, BASE, "en", "a", 1, "x", 1)], docs.schema))
    found = rows(STEP["line deduplication"](spark, more, SF))
    assert (8, "short") in found and not [r for r in found if r[0] == 9]


def test_quality(spark, docs, nothing):
    out = STEP["quality classifier"](spark, docs, SF)
    assert out.columns == COLUMNS and set(rows(out)) <= {(r[0], r[1]) for r in ROWS}
    assert STEP["quality classifier"](spark, nothing, SF).count() == 0


def test_packing(spark, docs, nothing):
    out = STEP["curve packing"](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in out}, key=str) == sorted({r[0] for r in ROWS}, key=str)
    assert sum(r.start == 0 for r in out) == len(ROWS)
    assert STEP["curve packing"](spark, nothing, SF).count() == 0
