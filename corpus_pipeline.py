"""The corpus pipeline over ``documents``: quality classifier, line deduplication, near-duplicate join and packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resultmart.llm.common import read, stage
from resultmart.llm.line_dedup import dedup_lines
from resultmart.llm.near_dup import near_duplicates
from resultmart.llm.packing import pack
from resultmart.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = COLUMNS[2:]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject.

    A null text is scored as an empty one and, if it stays, stays null. Rows without an id are scored and never learned
    from; rows of one id are scored one by one, and equal rows share their fate. An empty table gives an empty one, and
    without labels every score is 0.5, so that all rows stay. Columns other than those of ``documents`` are dropped.
    """
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=REST).where("predicted = 1").select(COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; one that loses all it has goes.

    A null text is one empty line and becomes an empty text; texts that were empty stay. Rows without an id lose
    nothing. Rows of one id count as one document and keep lines that only they hold. n_chars is that of the text that
    stays. An empty table gives an empty one; columns other than those of ``documents`` are dropped.
    """
    found = dedup_lines(docs, keep=["lang", "source"]).where("n_dropped = 0 OR text <> ''")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Rows are told apart by id and text: where one id has several texts, one of those in a group stays, and each text
    like no other stays. Of equal rows (one id, one text) one stays, whatever their other columns. Null texts, texts
    without words and rows without an id stay, each of them. An empty table gives an empty one; columns other than those
    of ``documents`` are dropped.
    """
    rows = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    gone = near_duplicates(rows, keep=["text_hash"]).where("NOT kept").select("doc_id", "text_hash").distinct()
    # rows that can't link take no part in the window: those without an id may share one text with a third of all rows
    linked = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = rows.where(linked).join(gone, ["doc_id", "text_hash"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("lang", "source", "n_chars"))
    first = left.withColumn("place", place).where("place = 1").select(COLUMNS)
    return first.unionByName(rows.where(~linked).select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids.

    Null and empty texts are the end id alone; rows are packed one by one, also those without an id or with the same
    one. An empty table gives no pieces.
    """
    return pack(docs, TOKENIZER, end_id=1, length=2048)


STAGES = [
    ("quality classifier", classify_quality),
    ("line deduplication", deduplicate_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("curve packing", pack_sequences),
]

#: SQL can't express the classifier; tests/llm/test_queries.py holds every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
