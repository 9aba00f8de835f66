"""Packing along a space-filling curve.

A document's vector of hashed tokens is projected to few dimensions, the point's place on a Hilbert curve is its key,
and documents are range-sorted by key: neighbours on the curve use similar tokens. Sequences are cut from the ids in
that order, end to end, so that only the very last one can fall short. Ids stay where they were written; only
(key, length) rows are sorted to find each document's place, and the ids meet their place in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, few, parts_of, release, stage
from resultmart.llm.tokens import encoder, lists_of

#: Buckets of the hashed token vector.
BUCKETS = 1024
#: Documents that are cut into pieces at once.
PIECE_ROWS = 500
#: Text that is encoded at once.
TEXT_BYTES = 4_000_000


def projection(vocabulary: int, dims: int, seed: int) -> np.ndarray:
    """For each id its share of the projected vector: a sign and a bucket by hash, the bucket's random direction."""
    mixed = (np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    directions = np.random.default_rng(seed).standard_normal((BUCKETS, dims)).astype(np.float32)
    return directions[(mixed >> np.uint64(40)) % np.uint64(BUCKETS)] * np.where(mixed >> np.uint64(63), 1, -1).astype(np.float32)[:, None]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), each coordinate of so many bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo what the sub-cubes turn and mirror
        low = (1 << b) - 1
        for i in range(dims):
            mirrored = (x[i] >> b & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokens(tokenizer: str, end_id: int, dims: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        table = projection(max(pieces.library.get_vocab_size(), end_id + 1), dims, seed)
        base, seen = TaskContext.get().partitionId() << 33, 0
        for rows in parts_of(batches, TEXT_BYTES):
            flat, ends = pieces.flat(rows.column(1))
            n = np.diff(ends, prepend=0) + 1
            flat = np.insert(flat, ends, end_id)
            ends = np.cumsum(n)
            mean = np.stack([np.add.reduceat(table[:, k][flat], ends - n) for k in range(dims)], axis=1) / n[:, None]
            key = hilbert_key(np.clip((mean + 1) * (1 << bits - 1), 0, (1 << bits) - 1).astype(np.int64), bits)
            uid = base + seen + np.arange(len(n))
            seen += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(uid), rows.column(0), pa.array(key), pa.array(n.astype(np.int64)), lists_of(flat, ends)], names=["uid", "doc_id", "hilbert_key", "doc_tokens", "ids"])
        pieces.forget()
        release()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each document in its partition of the sorted order."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(ends - n), b.column(1)], names=["part", "uid", "local", "n"])
        before = int(ends[-1]) if len(n) else before


def _pieces(length: int, kind: str):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, PIECE_ROWS) for x in batches for i in range(0, x.num_rows, PIECE_ROWS)):
            doc_ids, places, raw = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[list] = [[] for _ in names]
            for doc, place, x in zip(doc_ids, places, raw, strict=True):
                ids = np.frombuffer(x, kind)
                cuts = [0, *range(length - place % length, len(ids), length), len(ids)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    for column, value in zip(out, (doc, a, z - a, ids[a:z].astype("<i4"), len(ids), (place + a) // length, (place + a) % length), strict=True):
                        column.append(value)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out[3])]).astype(np.int32)), pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, "<i4")))
            yield pa.RecordBatch.from_arrays([lists if i == 3 else pa.array(c, pa.int64()) for i, c in enumerate(out)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", dims: int = 3, bits: int = 16, seed: int = 7) -> DataFrame:
    """Pack all documents into sequences of ``length`` ids; one row for each piece of a document.

    Returns doc_id, start (the document's ids before the piece), length, ids (array of int), doc_tokens (with the end
    id), sequence_id and offset (the piece's place there). Every sequence but the last is full, so the last is the only
    one that needs padding. Null and empty texts are the end id alone. Rows are packed one by one, also rows with the
    same or a null doc_id. An empty table gives no pieces; extra columns are dropped.
    """
    width = encoder(tokenizer).dtype.str
    held = stage(few(documents(docs, id_col, text_col), 6).mapInArrow(_tokens(tokenizer, end_id, dims, bits, seed), "uid long, doc_id long, hilbert_key long, doc_tokens long, ids binary"), "packing")
    order = held.select("uid", "doc_tokens", "hilbert_key").repartitionByRange("hilbert_key", "uid").sortWithinPartitions("hilbert_key", "uid").select("uid", "doc_tokens")
    places = stage(order.mapInArrow(_places, "part int, uid long, local long, n long"), "places")
    before, offsets = 0, []
    for part, n in sorted(places.groupBy("part").agg(F.sum("n")).collect()):  # one row for each range partition
        offsets.append((part, before))
        before += n
    starts = docs.sparkSession.createDataFrame(offsets, "part int, before long")
    placed = places.join(F.broadcast(starts), "part").select("uid", (F.col("local") + F.col("before")).alias("place"))
    return held.select("uid", "doc_id", "ids").join(placed, "uid").select("doc_id", "place", "ids").mapInArrow(_pieces(length, width), "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")
