"""Extendible hashing: shards of bounded size from a directory indexed by hash-prefix bits.

Documents start in one bucket; only buckets over the byte limit split on the next bit of the hash, until every shard
fits. The directory is indexed by the 2**depth prefixes of the largest depth in use, of which those that occur are
kept; entries of a shallower bucket share it.

Sizes are summed once for the finest prefixes and from those for all shorter ones, so all splits are decided over
narrow grouped rows, and documents are joined to the directory once. Where prefixes of ``step`` more bits still hold
too much, those buckets alone go on. Rows that no bit of the hash can part (equal keys, or one document over the
limit) are cut by running size into numbered shards of at most the limit, or of one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resultmart.llm.common import look_up, pick, stage

#: Bits of the hash: the first 12 hexadecimal digits of the MD5 of the key as text.
HASH_BITS = 48


def _hash(key):
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _level(sizes: DataFrame, depth: int, start: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, docs) of all depths from ``start`` on, from sizes by prefix of ``depth`` bits."""
    each = sizes.select("prefix", "bytes", "docs", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
    return each.groupBy("depth", F.expr(f"shiftright(prefix, {depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))


def directory(hashed: DataFrame, max_bytes: int, step: int = 8) -> DataFrame:
    """(depth, prefix, bytes, docs, fits) of all shards, from rows with hash and n_bytes; each is a bucket that fits or, at the last bit, one that can't be split further."""
    total = hashed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    start, depth = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes))) + step // 2))
    out = None
    rows = hashed.select("hash", "n_bytes")
    while True:
        sizes = rows.groupBy(F.shiftright("hash", HASH_BITS - depth).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = stage(_level(sizes, depth, start), "levels")
        small, parents = levels.where(F.col("bytes") <= max_bytes), levels.where(F.col("bytes") > max_bytes)
        above = parents.select((F.col("depth") + 1).alias("depth"), "prefix")
        # a bucket that fits is a shard if its parent doesn't; the first level's parents are known not to, or the root
        shards = small.join(above.select("depth", F.col("prefix").alias("parent")), (small.depth == above.depth) & (F.shiftright(small.prefix, 1) == F.col("parent")), "left_semi")
        shards = shards.unionByName(small.where(F.col("depth") == start))
        out = shards if out is None else out.unionByName(shards)
        large = parents.where(F.col("depth") == depth)
        if depth == HASH_BITS or large.isEmpty():
            return out.withColumn("fits", F.lit(True)).unionByName(large.withColumn("fits", F.lit(False)))
        open_ = large.select(F.col("prefix").alias("open"))
        rows = rows.join(open_, F.shiftright("hash", HASH_BITS - depth) == F.col("open"), "left_semi")
        start, depth = depth + 1, min(HASH_BITS, depth + step)


def shard(docs: DataFrame, max_bytes: int, key_col: str = "doc_id", text_col: str = "text", step: int = 8) -> DataFrame:
    """Give every document its shard; one row per input row.

    Returns doc_id (the key), n_bytes (of the text in UTF-8; null counts as empty), depth and prefix (the bits of the
    shard, as text), part (0, or a number from 1 on, not without gaps, where the hash can't part the rows), shard_bytes and
    shard_docs. No shard exceeds ``max_bytes`` unless it is one document that does. Null keys hash as an empty text;
    rows with equal keys share their shard as long as it fits. An empty table gives an empty result; extra columns are
    dropped.
    """
    rows = pick(docs, doc_id=key_col, text=(text_col, "string")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    hashed = stage(rows.withColumn("hash", _hash(F.col("doc_id"))).withColumn("node", F.spark_partition_id()), "hashed")
    found = stage(directory(hashed, max_bytes, step), "directory")
    depths = [r[0] for r in found.select("depth").distinct().collect()]  # at most one for each bit
    if not depths:
        return hashed.select("doc_id", "n_bytes", F.lit(0).alias("depth"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("part"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"))

    # The directory: an entry for each prefix of the largest depth in use, by which documents find their bucket.
    top = max(depths)
    finest = hashed.select(F.shiftright("hash", HASH_BITS - top).alias("entry")).distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("entry", top - d).alias("prefix")) for d in sorted(depths)])).alias("b")
    table = finest.select("entry", steps).select("entry", "b.depth", "b.prefix").join(found, ["depth", "prefix"])
    placed = look_up(hashed.withColumn("entry", F.shiftright("hash", HASH_BITS - top)), table, ["entry"])  # one key may hold a third of all rows
    bits = F.lpad(F.bin("prefix"), F.col("depth"), "0")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
    good = placed.where("fits").select("doc_id", "n_bytes", "depth", bits.alias("prefix"), F.lit(0).cast("long").alias("part"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    return good.unionByName(_cut(placed.where("NOT fits").withColumn("bits", bits), max_bytes))


def _cut(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows whose whole hash is shared, cut by running size: first into slices of rows, then inside each slice."""
    slices = F.ceil(F.col("bytes") / (8 * max_bytes))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_bytes", F.monotonically_increasing_id()), slices))
    rows = stage(rows.select("doc_id", "n_bytes", "depth", "bits", "slice", slices.cast("long").alias("slices")), "cut")
    inside = Window.partitionBy("bits", "slice").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    # half-limit bins: every bin but an oversized document holds at most half a limit before its last row of at most half
    small = rows.where(F.col("n_bytes") * 2 <= max_bytes).withColumn("piece", F.floor(F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)) * 2 / max_bytes))
    large = rows.where(F.col("n_bytes") * 2 > max_bytes).withColumn("piece", -1 - F.row_number().over(Window.partitionBy("bits", "slice").orderBy("n_bytes")))
    pieces = small.unionByName(large)
    key = ["bits", "slice", "piece"]
    sums = pieces.groupBy(*key, "slices").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    # numbers of the pieces of a slice are apart by the number of slices, so no task numbers all pieces of a key
    place = F.row_number().over(Window.partitionBy("bits", "slice").orderBy("piece")) - 1
    numbered = sums.withColumn("part", (1 + F.col("slice") + place * F.col("slices")).cast("long"))
    return pieces.drop("slices").join(numbered, key).select("doc_id", "n_bytes", "depth", F.col("bits").alias("prefix"), "part", "shard_bytes", "shard_docs")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add place: the number of each row in the order of these columns, which leave no ties."""
    ranged = stage(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    before, offsets = 0, []
    for k, n in sorted(ranged.groupBy("range").count().collect()):  # one row for each range partition
        offsets.append((k, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "range").withColumn("place", F.col("inside") + F.col("before")).drop("range", "inside", "before")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write documents as one folder for each shard (``prefix=.../part=...``), every row of ``docs`` once.

    ``assigned`` is what ``shard`` gives for the same rows. Rows with equal keys and sizes can take each other's shards,
    so both tables are numbered in the order of key and size and meet by number: null keys are keys like others, and a
    repeated key costs no more than others. Tables that don't belong together are an error. Columns of documents that
    are called like the folders are written with an underscore behind their name.
    """
    taken = {"prefix", "part"} | {c.lower() for c in docs.columns}
    names = []
    for c in docs.columns:
        name = c
        while name.lower() in ("prefix", "part") or name != c and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    row = F.struct(*[F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, names, strict=True)]).alias("row")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    held = stage(docs.select(row, F.col(key_col).alias("doc_id"), size, F.monotonically_increasing_id().alias("uid")), "documents")
    marks = stage(assigned.select("doc_id", "n_bytes", F.concat(F.lit("b"), "prefix").alias("prefix"), "part", F.monotonically_increasing_id().alias("uid")), "marks")
    left = _numbered(held.select("doc_id", "n_bytes", "uid"), "doc_id", "n_bytes", "uid")
    right = _numbered(marks, "doc_id", "n_bytes", "uid").select("place", F.struct("doc_id", "n_bytes").alias("of"), "prefix", "part")
    met = left.join(right, "place", "full")
    same = F.col("uid").isNotNull() & F.struct("doc_id", "n_bytes").eqNullSafe(F.col("of"))
    met = met.select("uid", F.when(same, F.col("prefix")).otherwise(F.raise_error(F.lit("documents and their shards differ"))).alias("prefix"), "part")
    held.select("uid", "row").join(met, "uid", "right").select("row.*", "prefix", "part").repartition("prefix", "part").write.partitionBy("prefix", "part").parquet(path)
