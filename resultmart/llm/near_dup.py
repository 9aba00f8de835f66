"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with the same set of shingles are one class; only classes are joined. A class lists its shingles from rare to
frequent, and two classes with Jaccard similarity t share one of the first |x| - ceil(t |x|) + 1; those prefix rows
meet by shingle. Frequencies come from a count of all shingles of the corpus in 2**``SKETCH_BITS`` buckets, whose size
doesn't grow: any fixed order gives right results, and frequent shingles stand out. Two classes that first meet at places
p and q of their lists can share no more than what follows there: the positional filter bounds that by its length, the
suffix filter by how many of it lie in each of equal ranges of hashes.

A group of thousands of near copies has millions of similar pairs that say nothing new about who reaches whom. So each
class is first tried with one hub: of the lists that it stands in, the class in whose list it stands most often at the
first place, which is the one with fewest rare shingles of its own, nearest to the text that the copies come from. Then
all classes of *different* components that pass the filters are tried, without those pairs. No link between different
components goes untested, pairs within one component need no test, and no pair is verified twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, few, look_up, rows_of, stage
from resultmart.llm.components import components
from resultmart.llm.shingles import mix, shingle_sets

#: Buckets of the shingle count: 4 MB at any size of the corpus.
SKETCH_BITS = 20
PIECE_BITS = 10
SUFFIX_RANGES = 32
#: Bits of the filter of documents whose sets are needed.
MARK_BITS = 25
#: Text whose shingles are computed at once.
TEXT_BYTES = 500_000
#: Pairs of sets that are compared at once.
PAIR_ROWS = 200
#: Digests that a task remembers, to list the shingles of copies once.
SEEN = 100_000
#: Rows of one shingle's list that meet in one task.
LIST_ROWS = 2000


def _sketch(words: int):
    """Counts of the shingles of a task, in pieces of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in rows_of(batches, TEXT_BYTES):
            found = shingle_sets([x.encode() for x in texts], words)
            counts += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        if counts.any():
            parts = counts.astype("<u4").reshape(-1, 1 << PIECE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), TaskContext.get().partitionId(), np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["piece", "task", "counts"])

    return run


def _add(kind: str):
    def run(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"piece": group.column("piece")[:1], "task": group.column("task")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    return run


def sketch(rows: DataFrame, words: int) -> Broadcast:
    """The corpus-wide counts by bucket, added up in two levels."""
    kind = "piece int, task int, counts binary"
    parts = rows.mapInArrow(_sketch(words), kind).withColumn("task", F.shiftright("task", 8))
    added = parts.groupBy("piece", "task").applyInArrow(_add("<u4"), kind).withColumn("task", F.lit(0)).groupBy("piece", "task").applyInArrow(_add("<i8"), kind)
    counts = np.zeros((1 << (SKETCH_BITS - PIECE_BITS), 1 << PIECE_BITS), np.int64)
    for piece, _, raw in added.collect():
        counts[piece] = np.frombuffer(raw, "<i8")
    return rows.sparkSession.sparkContext.broadcast(np.minimum(counts.ravel(), (1 << 32) - 1).astype(np.uint32))


def _marks(bits: int):
    """Which buckets of hashed doc_ids a task has, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            held[bucket(b.column(0).to_numpy(), bits)] = True
        parts = np.packbits(held).reshape(-1, 1 << PIECE_BITS)
        some = np.flatnonzero(parts.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), TaskContext.get().partitionId(), np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["piece", "task", "counts"])

    return run


def _either(group: pa.Table) -> pa.Table:
    held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()])
    return pa.table({"piece": group.column("piece")[:1], "task": group.column("task")[:1], "counts": pa.array([held.tobytes()], pa.binary())})


def bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def marked(ids: DataFrame, bits: int = MARK_BITS) -> Broadcast:
    """A filter of doc_ids in 2**bits bits, 4 MB at any size: it passes all given ones, and others the more the fuller it is."""
    kind = "piece int, task int, counts binary"
    parts = ids.mapInArrow(_marks(bits), kind).withColumn("task", F.shiftright("task", 8))
    joined = parts.groupBy("piece", "task").applyInArrow(_either, kind).withColumn("task", F.lit(0)).groupBy("piece", "task").applyInArrow(_either, kind)
    held = np.zeros((1 << (bits - 3 - PIECE_BITS), 1 << PIECE_BITS), np.uint8)
    for piece, _, raw in joined.collect():
        held[piece] = np.frombuffer(raw, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(held.ravel())


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _digest(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _signatures(words: int, percent: int, counts: Broadcast):
    """Number, size and digest of each row's set; its prefix and marks too where the set is new to the task."""
    names = ["doc_id", "node", "uid", "n", "digest", "prefix", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen, node, uid = counts.value, set(), TaskContext.get().partitionId(), 0
        for rows, texts in rows_of(batches, TEXT_BYTES):
            sizes, digests, prefixes, marks = [], [], [], []
            for doc_id, x in zip(rows.column(0).to_pylist(), shingle_sets([x.encode() for x in texts], words), strict=True):
                sizes.append(len(x))
                digest = _digest(x)
                digests.append(digest)
                if digest is None or doc_id is None or digest in seen:
                    prefixes.append(None)
                    marks.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                order = np.argsort(frequency[x >> np.uint64(64 - SKETCH_BITS)], kind="stable")
                prefix = x[order[: _prefix_length(len(x), percent)]]
                prefixes.append(prefix.tobytes())
                marks.append(np.bincount(_ranges(x), minlength=SUFFIX_RANGES).astype("<u4").tobytes() + _ranges(prefix).astype(np.uint8).tobytes())
            uids = (node << 33) + uid + np.arange(len(sizes))
            uid += len(sizes)
            columns = [rows.column(0), pa.array(np.full(len(sizes), node, np.int32)), pa.array(uids), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *rows.columns[2:]], names=[*names, *rows.schema.names[2:]])

    return run


def _ranges(x: np.ndarray) -> np.ndarray:
    """In which of equal ranges of hashes each shingle lies."""
    return (x >> np.uint64(64 - SUFFIX_RANGES.bit_length() + 1)).astype(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix; place and size in one number."""
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            found = [np.frombuffer(x, "<i8") for x in part.column(2).to_pylist()]
            lengths = np.array([len(x) for x in found])
            ids = np.repeat(part.column(0).to_numpy(), lengths)
            spots = np.repeat(part.column(1).to_numpy(), lengths) | (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) << 32
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(spots), pa.array(ids)], names=["token", "spot", "cid"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several classes hold, each with the first one of its list, the hub.

    Rows come sorted. The first and the last list of a task may go on in another one, so their rows count as shared.
    """
    names, part = ["token", "spot", "cid", "hub_spot", "hub", "part"], TaskContext.get().partitionId()
    held, hub, begun = [np.zeros(0, np.int64)] * 3, None, False  # the last row waits for its successor; hub: of its list, if it isn't that itself

    def rows(at: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in columns], pa.array(np.full(len(at), part, np.int32))], names=names)

    for b in batches:
        token, spot, cid = (np.append(h, b.column(i).to_numpy()) for i, h in enumerate(held))
        if not len(token):
            continue
        new = np.append(True, token[1:] != token[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
        hub_spot, hubs = spot[first], cid[first]
        if hub:
            hub_spot[first == 0], hubs[first == 0] = hub
        alone = new[:-1] & new[1:]
        alone[:1] &= begun and not hub
        columns = [token, spot, cid, hub_spot, hubs]
        yield rows(np.flatnonzero(~alone), columns)
        hub = None if new[-1] and not (hub and len(token) == 1) else (hub_spot[-1], hubs[-1])
        begun = begun or len(token) > 1
        held, last = [token[-1:], spot[-1:], cid[-1:]], [c[-1:] for c in columns]
    if len(held[0]):
        yield rows(np.zeros(1, np.int64), last)


def _with_hubs(shared: DataFrame) -> DataFrame:
    """Where a list goes on in the next task, its rows there get the hub of the whole list; at most one list for each task."""
    ends = sorted(shared.groupBy("part").agg(F.min("token"), F.max("token")).collect())
    cut = sorted({a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not cut:
        return shared
    hubs = shared.where(F.col("token").isin(cut)).groupBy("token").agg(F.min(F.struct("spot", "cid")).alias("top")).collect()
    table = shared.sparkSession.createDataFrame([(r.token, r.top.spot, r.top.cid) for r in hubs], "token long, top_spot long, top long")
    joined = shared.join(F.broadcast(table), "token", "left")
    return joined.select("token", "spot", "cid", F.coalesce("top_spot", "hub_spot").alias("hub_spot"), F.coalesce("top", "hub").alias("hub"))


def _may_link(left: Column, right: Column, percent: int) -> Column:
    """Length and positional filter of two rows of a list."""
    p, q = F.shiftright(left, 32), F.shiftright(right, 32)
    n, m = left.bitwiseAND(0xFFFFFFFF), right.bitwiseAND(0xFFFFFFFF)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))


def _hub_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each class with the hub that it meets most often, and the places where they meet first in the lists of that hub; of two that are each other's hub one pair.

    They may share rarer shingles, in whose lists another class is the hub.
    """
    met = shared.where((F.col("cid") != F.col("hub")) & _may_link(F.col("spot"), F.col("hub_spot"), percent))
    met = met.groupBy("cid", "hub").agg(F.count("*").alias("n"), F.min(F.struct("spot", "hub_spot")).alias("at"))
    best = met.groupBy("cid").agg(F.max_by(F.struct("hub", "at"), F.struct("n", -F.col("hub"))).alias("best"))
    pair = F.struct(F.col("cid").alias("a"), F.col("best.hub").alias("b"), F.col("best.at.spot").alias("p"), F.col("best.at.hub_spot").alias("q"))
    once = best.groupBy(F.least("cid", "best.hub").alias("low"), F.greatest("cid", "best.hub").alias("high")).agg(F.min(pair).alias("pair"))
    return once.select("pair.*")


def _candidates(shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a prefix shingle and pass the filters, and the places where they meet first.

    In a list, the members of its largest component meet the others, and the others meet everyone: members of the
    largest one don't meet each other. A long list is cut into blocks of ``LIST_ROWS``, and each block meets the list.
    """
    rows = shared.select("token", "spot", "cid").join(found.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lists = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    lists = lists.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components"), F.ceil(F.sum("n") / LIST_ROWS).cast("int").alias("blocks"))
    rows = rows.join(lists.where("components > 1").drop("components"), "token")
    left = rows.where("component <> largest").select("token", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), *[F.col(c).alias(f"l_{c}") for c in ("spot", "cid", "component")])
    right = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "largest", *[F.col(c).alias(f"r_{c}") for c in ("spot", "cid", "component")])
    met = left.join(right, ["token", "block"]).where(
        (F.col("l_component") != F.col("r_component"))
        & ((F.col("r_component") == F.col("largest")) | (F.col("l_cid") < F.col("r_cid")))
        & _may_link(F.col("l_spot"), F.col("r_spot"), percent)
    )
    turned = F.col("l_cid") > F.col("r_cid")
    spots = F.when(turned, F.struct(F.col("r_spot").alias("p"), F.col("l_spot").alias("q"))).otherwise(F.struct(F.col("l_spot").alias("p"), F.col("r_spot").alias("q")))
    return met.groupBy(F.least("l_cid", "r_cid").alias("a"), F.greatest("l_cid", "r_cid").alias("b")).agg(F.min(spots).alias("at")).select("a", "b", "at.p", "at.q")


def _suffix_filter(percent: int, first: bool = True):
    """Pairs whose sets can share enough around the places where they meet, range of hashes by range.

    Unless they meet there ``first``, what stands before these places may be shared as well.
    """

    def around(marks: bytes, spot: int) -> tuple[int, np.ndarray, np.ndarray]:
        place, head = spot >> 32, 4 * SUFFIX_RANGES
        ranges = np.frombuffer(marks, np.uint8, place + 1, head)
        upto = np.bincount(ranges, minlength=SUFFIX_RANGES)
        return spot & 0xFFFFFFFF, np.bincount(ranges[:-1], minlength=SUFFIX_RANGES), np.frombuffer(marks, "<u4", SUFFIX_RANGES).astype(np.int64) - upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for p, q, x, y in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                (n, before_x, x), (m, before_y, y) = around(x, p), around(y, q)
                most = 1 + int(np.minimum(x, y).sum()) + (0 if first else int(np.minimum(before_x, before_y).sum()))
                good.append((100 + percent) * most >= percent * (n + m))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(i).to_numpy()[good]) for i in (0, 1)], names=["a", "b"])

    return run


def _sets(words: int, held: Broadcast, bits: int = MARK_BITS):
    """doc_id, digest and set of the rows that pass the filter of documents whose sets are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = bucket(b.column(0).to_numpy(), bits)
                yield b.filter(pa.array((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

        for rows, texts in rows_of(passing(), TEXT_BYTES):
            found = shingle_sets([x.encode() for x in texts], words)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "digest", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(i).to_numpy()[good]) for i in (0, 1)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, percent: int, first: bool = True) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, given with the places where they meet (``first``, or somewhere). Only sets of classes in pairs that pass the suffix filter move."""
    marks = classes.select("cid", "marks")
    likely = pairs.join(marks.toDF("a", "x"), "a").join(marks.toDF("b", "y"), "b").select("a", "b", "p", "q", "x", "y").mapInArrow(_suffix_filter(percent, first), "a long, b long")
    likely = stage(likely, "likely", waves=1)
    cids = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    wanted = stage(classes.select("cid", "rep", "digest").join(cids, "cid", "left_semi"), "wanted", waves=1)
    near = rows.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_sets(words, marked(wanted.select("rep"))), "doc_id long, digest binary, shingles binary")
    held = near.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"])
    sets = held.groupBy("cid").agg(F.first("shingles").alias("shingles"))  # of repeated rows one
    # thousands of classes may be tried with one hub: its set goes once to each of 64 nodes that have some of them
    met = likely.withColumn("node", F.pmod(F.xxhash64("a"), F.lit(64))).join(sets.toDF("a", "x"), "a")
    met = look_up(met, sets.toDF("b", "y"), ["b"]).select("a", "b", "x", "y")
    return stage(met.mapInArrow(_verify(percent), "a long, b long"), "pairs", PAIR_ROWS, 3)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, keep: Sequence[str] = ()) -> DataFrame:
    """Link documents whose sets of ``words``-word shingles have Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per input row: doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by
    links, itself included), kept (whether the row's set and id stand for its group; of equal rows all do) and the
    columns in ``keep``. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer words is one
    shingle. Null texts and texts without words have no shingles, link with nothing and are kept. Shingles are compared
    as 64-bit hashes. Rows with a null doc_id are kept and link with nothing, but take the component_id of rows with the
    same set; rows with the same doc_id are compared one by one. Of a group, the smallest doc_id is kept and, where
    that id has several texts, one of them. An empty table gives an empty result; other columns are dropped, and those to
    keep may not be called like results.
    """
    own = ("node", "uid", "n", "digest", "prefix", "marks", "n_shingles", "component_id", "kept", "rep", "cid", "top")
    rows = documents(docs, id_col, text_col, keep, own)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    counts = sketch(rows.select("doc_id", "text"), words)
    signs = stage(few(rows, 6).mapInArrow(_signatures(words, percent, counts), "doc_id long, node int, uid long, n long, digest binary, prefix binary, marks binary" + fields), "signatures")
    known = signs.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
    first = F.min(F.struct("doc_id", "uid")).alias("first")

    classes = known.agg(first, F.first("marks", ignorenulls=True).alias("marks"))
    classes = stage(classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.uid").alias("cid"), "marks"), "classes", waves=3)
    prefixes = known.agg(first, F.min("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix"))
    tokens = prefixes.select("first.uid", "n", "prefix").mapInArrow(_tokens, "token long, spot long, cid long")
    ordered = tokens.repartitionByRange("token", "spot", "cid").sortWithinPartitions("token", "spot", "cid")
    shared = _with_hubs(stage(ordered.mapInArrow(_shared, "token long, spot long, cid long, hub_spot long, hub long, part int"), "shared"))

    tried = stage(_hub_pairs(shared, percent), "tried", waves=1)
    links = _linked(tried, rows, classes, words, percent, first=False)
    found = stage(components(links), "found", waves=1)
    pairs = _candidates(shared, found, percent).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = links.unionByName(_linked(stage(pairs, "candidates", waves=1), rows, classes, words, percent))

    # Classes of a component take its smallest doc_id, and rows those of their class.
    found = components(links).toDF("cid", "component").withColumn("node", F.pmod(F.xxhash64("cid"), F.lit(64)))
    found = stage(found.join(classes.select("cid", "rep"), "cid"), "found", waves=1)
    tops = found.groupBy("component").agg(F.min(F.struct("rep", "cid")).alias("top"))
    reached = look_up(found, tops, ["component"]).select("cid", F.col("top.rep").alias("component_id"), F.col("top.cid").alias("top"))
    of = classes.select("digest", "rep", "cid").join(reached, "cid", "left")
    of = of.select("digest", "cid", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("top", "cid").alias("top"))
    joined = look_up(signs.select("doc_id", "node", "n", "digest", *keep), of, ["digest"])
    kept = F.col("doc_id").isNull() | F.col("digest").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("cid") == F.col("top")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"), *keep)
