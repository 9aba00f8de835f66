"""Connected components of a graph given as links, by contraction inside tasks and star rounds between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import pick, stage

#: Links that one task contracts at a time.
TASK_LINKS = 1_000_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(task_links: int):
    """Links of one task, in blocks, as stars around their smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def stars() -> pa.RecordBatch:
            node, root = smallest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            far = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= task_links:
                b = stars()
                held, n = [(b.column(0).to_numpy(), b.column(1).to_numpy())], b.num_rows
                if 2 * n > task_links:
                    yield b
                    held, n = [], 0
        if held:
            yield stars()

    return run


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component): each node of the links with the smallest node that it reaches.

    Links with a null end and links of a node to itself are left out; repeated links change nothing; no links give an
    empty table. Up to ``task_links`` links are contracted by one task. Beyond, every round contracts the links of each
    task, then links larger neighbours to the smallest one they share (large star) and smaller ones to the smallest
    (small star), with grouped minima and joins, until nothing changes; the rounds grow with the logarithm of the size.
    """
    edges = stage(pick(links, a=(a, "long"), b=(b, "long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contract(task_links), "a long, b long"), "links", waves=1)
    n = edges.count()
    while n > task_links:
        tasks = math.ceil(n / task_links)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        rounds = stage(small.repartition(tasks, "b").mapInArrow(_contract(task_links), "a long, b long").distinct(), "links", waves=3)
        m, same = rounds.count(), rounds.exceptAll(edges).isEmpty()
        edges = rounds
        if same and m == n:
            break
        n = m
    else:
        edges = edges.coalesce(1).mapInArrow(_contract(task_links), "a long, b long") if n else edges
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
