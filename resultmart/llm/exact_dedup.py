"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one run for each digest range: its distinct digests in ascending order, each with the
smallest identifier and the number of rows behind it. Runs then meet in binomial rounds: in round r, the node whose
number has bit r set sends its run to the node without that bit (``fan_bits`` rounds are taken at once, which makes
the merge a multiway one). A merge joins two entries only if digest, length and an independent 64-bit hash of the text
all agree, and keeps the smaller identifier. Ranges divide the digest space so finely that the last run of a range
stays bounded; no task ever sees all digests. The result flows back down to the rows over (node, digest), so that a
group of copies that holds a third of all rows is spread over all nodes that met it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, look_up, stage

RUN = "range int, node int, keys binary, ids binary, counts binary"
RUN_SCHEMA = pa.schema([("range", pa.int32()), ("node", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
#: A key's bytes: the digest, then length and check, big-endian, so that keys are in the order of their bytes.
DIGEST, KEY = 32, 48
Run = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, smallest ids, counts


def normalised(text):
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _once(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Run:
    """A sorted run without repeats: of equal keys the smallest identifier and all rows."""
    if not len(keys):
        return keys, ids, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.minimum.reduceat(ids, first), np.add.reduceat(counts, first)


def _merged(x: Run, y: Run) -> Run:
    """Two sorted runs as one: the entries of the second find their places among those of the first."""
    at = np.searchsorted(x[0], y[0], "right") + np.arange(len(y[0]))
    second = np.zeros(len(x[0]) + len(y[0]), bool)
    second[at] = True
    out = []
    for a, b in zip(x, y, strict=True):
        c = np.empty(len(second), a.dtype)
        c[~second], c[second] = a, b
        out.append(c)
    return _once(*out)


def multiway(runs: list[Run]) -> Run:
    """Sorted runs as one, pair by pair."""
    while len(runs) > 1:
        runs = [_merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _packed(kind: int, node: int, run: Run) -> dict:
    return {"range": kind, "node": node, "keys": run[0].tobytes(), "ids": run[1].astype("<i8").tobytes(), "counts": run[2].astype("<i8").tobytes()}


def _unpacked(keys: bytes, ids: bytes, counts: bytes) -> Run:
    return np.frombuffer(keys, f"S{KEY}"), np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8")


def _leaf_runs(range_bits: int):
    """Sorted runs of the rows of one node, range by range. Rows arrive by node; a node's rows may come in several runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.empty((b.num_rows, KEY), np.uint8)
            raw[:, :DIGEST] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, DIGEST)
            for k, i in ((DIGEST, 2), (DIGEST + 8, 3)):
                raw[:, k : k + 8] = b.column(i).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            keys = raw.view(f"S{KEY}").ravel()
            ranges = (raw[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
            groups = b.column(0).to_numpy().astype(np.int64) << 32 | ranges
            order = np.lexsort((keys, groups))
            keys, ids, groups = keys[order], b.column(4).to_numpy()[order], groups[order]
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            out = [_packed(int(groups[a] & 0xFFFFFFFF), int(groups[a] >> 32), _once(keys[a:z], ids[a:z], np.ones(z - a, np.int64))) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=RUN_SCHEMA)

    return run


def _merge_round(group: pa.Table) -> pa.Table:
    """One multiway merge: the runs of one range that meet in one node."""
    runs = [_unpacked(*r) for r in zip(*[group.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
    return pa.Table.from_pylist([_packed(group.column(0)[0].as_py(), group.column(1)[0].as_py(), multiway(runs))], schema=RUN_SCHEMA)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.binary()), ("length", pa.int64()), ("check", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
            raw, ids, counts = np.frombuffer(row[0], np.uint8).reshape(-1, KEY), *_unpacked(*row)[1:]
            digests = [x.tobytes() for x in raw[:, :DIGEST]]
            number = lambda k: pa.array(np.ascontiguousarray(raw[:, k : k + 8]).view(">i8").ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), number(DIGEST), number(DIGEST + 8), pa.array(ids), pa.array(counts)], schema=schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 16_384, fan_bits: int = 3) -> DataFrame:
    """Group documents whose normalised texts are equal; one row per input row.

    Returns doc_id, keep_id (smallest doc_id of the group), group_size (rows in the group), kept (doc_id = keep_id) and
    text_sha256. ``rows_per_range`` bounds the entries of the last run of a range on average, ``2**fan_bits`` is the
    fan-in of a merge. Null texts are empty texts. Rows with a null doc_id take part under an id above all others: they
    are never kept unless the whole group has no id, and then keep_id is null and kept false. Repeated rows count
    separately and share their fate. An empty table gives an empty result; extra columns are dropped.
    """
    top = (1 << 63) - 1
    text = normalised(F.col("text"))
    rows = documents(docs, id_col, text_col).select(
        "doc_id", F.spark_partition_id().alias("node"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("length"), F.xxhash64(text).alias("check")
    )
    rows = stage(rows, "digests", waves=3)
    total, nodes = rows.agg(F.count("*"), F.coalesce(F.max("node") + 1, F.lit(1))).first()
    range_bits = max(0, min(30, math.ceil(math.log2(max(1, total / rows_per_range)))))

    keyed = rows.select("node", "digest", "length", "check", F.coalesce("doc_id", F.lit(top)).alias("id"))
    runs = keyed.mapInArrow(_leaf_runs(range_bits), RUN)
    for _ in range(max(1, math.ceil(math.log2(max(2, nodes)) / fan_bits))):
        runs = runs.withColumn("node", F.shiftright("node", fan_bits)).groupBy("range", "node").applyInArrow(_merge_round, RUN)
    merged = stage(runs.mapInArrow(_entries, "digest binary, length long, check long, keep_id long, group_size long"), "merged", waves=3)

    # Down again: an entry reaches each node that met its digest once, and there its rows.
    found = look_up(rows, merged, ["digest", "length", "check"])
    return found.select(
        "doc_id", F.when(F.col("keep_id") != top, F.col("keep_id")).alias("keep_id"), "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
