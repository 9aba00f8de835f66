"""Line deduplication: explode normalised lines with their positions, hash them, count documents per hash, drop lines
over a threshold and reassemble the rest by position.

Keys are 16-byte digests. Every line is hashed once and written as a narrow row (key, document, position). The count is
a grouped minimum, maximum or distinct count with partial aggregation on the map side, so one line that all documents
hold costs one row per task. Keys over the threshold find their rows through a join: those that hold more than one in
``HOT_SHARE`` of all rows, at most that many keys, are broadcast, so that no task gets all rows of a frequent line; the
others meet by key. Texts are shuffled once, as lists of lines, to meet the positions that they lose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import SPACES, documents, stage

_UPPER, _LOWER = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
#: Keys with more than one in so many rows are hot; there can't be more of them than this.
HOT_SHARE = 10_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def _shared(held: DataFrame, min_docs: int) -> DataFrame:
    """(key, first_id, rows) of keys that ``min_docs`` documents hold."""
    if min_docs == 2:
        return held.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("rows")).where("first_id < last_id").drop("last_id")
    each = held.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("rows"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Drop lines whose key is held by ``min_docs`` documents or more, except in the smallest doc_id that holds it.

    A line's key is the line without white space (space, U+0009 to U+000D) at its ends and with A-Z in lower case; keys
    of fewer than ``min_chars`` code points stay. Returns one row per input row: doc_id, n_lines (before dropping),
    n_dropped, text (the lines that stay, joined by line feeds), kept_sha256 and the columns in ``keep``.
    A null or empty text is one empty line. Rows with a null doc_id lose nothing and don't count. Rows that share a
    doc_id are one document: a key found only in them isn't shared. An empty table gives an empty result; other
    columns are dropped, and those to keep may not be called like results.
    """
    own = ("n_lines", "n_dropped", "kept_sha256", "text_hash", "lines", "lost", "key", "position")
    rows = documents(docs, id_col, text_col, keep, own)
    # the id and the text's hash tell rows apart; rows with both in common lose the same positions
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), *keep)
    exploded = rows.where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.posexplode("lines").alias("position", "line"))
    keyed = exploded.select("doc_id", "text_hash", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    held = stage(keyed.withColumn("key", F.unhex(F.md5("key"))), "lines", waves=3)

    shared = stage(_shared(held, min_docs), "shared", waves=1)
    hot = shared.where(F.col("rows") * HOT_SHARE > held.count()).select("key", F.col("first_id").alias("hot_id"))
    marked = held.join(F.broadcast(hot), "key", "left")
    rest = marked.where("hot_id IS NULL").drop("hot_id").join(shared.select("key", "first_id"), "key")
    lost = marked.where("hot_id <> doc_id").drop("hot_id").unionByName(rest.where("first_id <> doc_id").drop("first_id"))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("lost"))

    met = rows.join(lost, ["doc_id", "text_hash"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    lines = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    out = met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), F.array_join(lines, "\n").alias("text"), *keep)
    return out.select("doc_id", "n_lines", "n_dropped", "text", F.sha2("text", 256).alias("kept_sha256"), *keep)
