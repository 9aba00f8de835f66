"""Token files: the ids of all documents end to end, with Elias-Fano coded document boundaries.

A file is a Parquet folder, so that Spark's writers commit it and any store can hold it. A row is a segment of some
million ids: its range partition ``part`` and number ``segment`` in it, ``local_start`` (ids before it in the
partition), the ids as one array of little-endian integers of ``width`` bytes, and two rising sequences in Elias-Fano
form, each as ``low_bits``, ``low``, ``high``, ``sample``: ``ends``, the ends of its documents, and ``ids_of``, their
doc_ids less the smallest one ``first_id``; ``n_null`` documents without an id stand before those. Partitions are ranges
of doc_id in ascending order, so ids stand in ascending order of doc_id throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from resultmart.llm.common import documents, parts_of, release
from resultmart.llm.elias_fano import EliasFano
from resultmart.llm.tokens import encoder

_CODED = "struct<low_bits:int,low:binary,high:binary,sample:binary>"
SEGMENT = f"part int, segment int, local_start long, n_docs int, n_ids long, n_null int, first_id long, last_id long, width int, ids binary, ends {_CODED}, ids_of {_CODED}"
_PA_CODED = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("sample", pa.binary())])
SEGMENT_SCHEMA = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", _PA_CODED), ("ids_of", _PA_CODED)]
)
#: Text that is encoded at once.
TEXT_BYTES = 4_000_000


def _coded(x: EliasFano) -> dict:
    return {"low_bits": x.low_bits, "low": x.low, "high": x.high, "sample": x.sample}


def _segments(tokenizer: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, number, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, docs, ids, sizes, held
            known = np.array([x for x in docs if x is not None], np.int64)
            first = int(known[0]) if len(known) else None
            row = {"part": part, "segment": number, "local_start": start, "n_docs": len(docs), "n_ids": held, "n_null": len(docs) - len(known), "first_id": first, "last_id": int(known[-1]) if len(known) else None, "width": pieces.dtype.itemsize}
            row |= {"ids": np.concatenate(ids).tobytes(), "ends": _coded(EliasFano.of(np.cumsum(np.concatenate(sizes)))), "ids_of": _coded(EliasFano.of(known.astype(np.uint64) - np.uint64((first or 0) % (1 << 64))))}
            number, start, docs, ids, sizes, held = number + 1, start + held, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_SCHEMA)

        for rows in parts_of(batches, TEXT_BYTES):
            flat, ends = pieces.flat(rows.column(1))
            n = np.diff(ends, prepend=0) + 1
            flat = np.insert(flat, ends, end_id)
            ends = np.cumsum(n)
            of, a = rows.column(0).to_pylist(), 0
            while a < len(n):  # the documents that fill the segment, or all
                z = min(len(n), int(np.searchsorted(ends, (ends[a - 1] if a else 0) + segment_ids - held)) + 1)
                docs += of[a:z]
                sizes.append(n[a:z])
                ids.append(flat[(ends[a - 1] if a else 0) : ends[z - 1]])
                held += len(ids[-1])
                a = z
                if held >= segment_ids:
                    yield flush()
        if docs:
            yield flush()
        pieces.forget()
        release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 2_000_000) -> None:
    """Encode every whole text, append ``end_id`` and write a token file, in ascending order of doc_id.

    Null and empty texts have the end id only; null doc_ids come first; rows with the same doc_id stand together in the
    order of a hash of the text. An empty table gives an empty file.
    """
    rows = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(_segments(tokenizer, end_id, segment_ids), SEGMENT).write.option("compression", "zstd").parquet(path)


def _sequence(n: int, x: dict | Row) -> EliasFano:
    return EliasFano(n, x["low_bits"], bytes(x["low"]), bytes(x["high"]), bytes(x["sample"]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "local_start", "n_tokens", "ids"]
    for b in batches:
        for row in b.to_pylist():
            ends = _sequence(row["n_docs"], row["ends"]).select_all()
            known = _sequence(row["n_docs"] - row["n_null"], row["ids_of"]).select_all()
            docs = np.concatenate([np.zeros(row["n_null"], np.int64), known + (row["first_id"] or 0)])
            ids = pa.array(np.frombuffer(row["ids"], f"<u{row['width']}").astype(np.int32))
            starts = np.concatenate([[0], ends]).astype(np.int64)
            missing = np.arange(len(docs)) < row["n_null"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(docs, mask=missing), pa.array(row["local_start"] + starts[:-1]), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), ids)], names=names)


def offsets(segments: DataFrame) -> DataFrame:
    """(part, before): ids in all partitions before each; one row for each range partition."""
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    return segments.sparkSession.createDataFrame(rows, "part int, before long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start (ids before it in the whole file), n_tokens, ids."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    found = segments.mapInArrow(_documents, "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    return found.join(F.broadcast(offsets(segments)), "part").select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_slice(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document (the first row of its id): its segment is found by the ranges of ids, its place and boundaries by select."""
    held = spark.read.schema(SEGMENT).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for row in held.orderBy("part", "segment").toLocalIterator():  # one segment, or those that a repeated id fills
        known = _sequence(row.n_docs - row.n_null, row.ids_of)
        a, z = 0, known.n
        while a < z:
            mid = (a + z) // 2
            a, z = (mid + 1, z) if known.select(mid) + row.first_id < doc_id else (a, mid)
        if a < known.n and known.select(a) + row.first_id == doc_id:
            ends, i = _sequence(row.n_docs, row.ends), a + row.n_null
            start = ends.select(i - 1) if i else 0
            return np.frombuffer(bytes(row.ids), f"<u{row.width}", ends.select(i) - start, start * row.width).tolist()
    raise KeyError(doc_id)


def crc32_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ids_crc32 (little-endian unsigned 32-bit) in place of the last column, ``ids``."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        at = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])
