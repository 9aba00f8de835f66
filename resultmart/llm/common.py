"""Small helpers that the operators share: safe column choice, shared scratch tables and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Scratch tables that this process wrote.
PATHS: list[str] = []
#: Text of a batch that Python code holds as words at once.
CHUNK_BYTES = 2_000_000


def pick(df: DataFrame, **columns: str | tuple[str, str]) -> DataFrame:
    """Select ``output=source`` or ``output=(source, type)`` by exact name and position.

    Other columns are dropped, so neither extra columns nor names that differ only in case can clash.
    """
    names = df.columns
    held = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out: list[Column] = []
    for name, source in columns.items():
        source, kind = source if isinstance(source, tuple) else (source, None)
        if source not in names:
            raise ValueError(f"column {source!r} is missing; there are {names}")
        c = F.col(f"_c{names.index(source)}")
        out.append((c.cast(kind) if kind else c).alias(name))
    return held.select(*out)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), own: Sequence[str] = ()) -> DataFrame:
    """doc_id long and text string, null text kept, then the columns in ``keep``, which may not be called as those in ``own``."""
    if clash := {x.lower() for x in keep} & {"doc_id", "text", *own}:
        raise ValueError(f"columns to keep are called like results: {sorted(clash)}")
    return pick(df, doc_id=(id_col, "long"), text=(text_col, "string"), **{x: x for x in keep})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a local master takes a temporary folder; on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    PATHS.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return PATHS[-1]


def clear(spark: SparkSession) -> None:
    """Delete the scratch tables of this process; results that aren't written yet need theirs."""
    while PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that start meanwhile hand so many rows at a time to Python, so that batches of wide rows stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, label: str, batch_rows: int = 2000, waves: int = 0, file_rows: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing of it.

    With ``waves``, as many tasks as that many waves over all cores write at most, each going through its partitions one
    by one: fewer files where partitions are small, for tables much smaller than the texts they come from. Not for rows
    that carry the number of their task: partitions of one task have it in common. With ``file_rows``, a file has so many
    rows at most, for rows of some MB.
    """
    path, spark = scratch(df.sparkSession, label), df.sparkSession
    with batches_of(spark, batch_rows):
        (few(df, waves) if waves else df).write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, waves: int) -> DataFrame:
    """In as many tasks as that many waves over all cores at most."""
    return df.coalesce(waves * df.sparkSession.sparkContext.defaultParallelism)


def look_up(rows: DataFrame, table: DataFrame, key: Sequence[str], node: str = "node") -> DataFrame:
    """A left join of rows to a table with one row for each key, where one key may hold a third of all rows.

    An entry of the table goes once to each node (a number that rows carry, such as their partition) that has rows of
    its key, and meets them there, so that no task gets all rows of a key.
    """
    there = rows.select(node, *key).distinct().join(table, list(key))
    return rows.join(there, [node, *key], "left")


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a list of strings with about so many characters each; one long text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their ``text`` as str (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = column.nbytes
        step = max(1, min(batch.num_rows or 1, int(batch.num_rows * limit / max(sizes, 1)) or 1))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            for a, b in chunks(texts, 2 * limit):
                yield part.slice(a, b - a), [x or "" for x in texts[a:b]]
    release()


def parts_of(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so many bytes of ``text``; one long text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, z - a)
            a = z
    release()


def release() -> None:
    """At the end of a task: memory that it no longer needs goes back to the machine, as workers wait for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is such a call in glibc only
        ctypes.CDLL(None).malloc_trim(0)
