"""Exact range join of vectors by cosine: pivots cut the unit sphere into cells, cells into blocks, and blocks meet where
their cells may hold partners.

For unit vectors, cosine >= c means distance <= r = sqrt(2 - 2c). A vector's home is the cell of its nearest pivot.
Another cell may hold a partner of it only where, by the triangle inequality, its distance to that pivot is at most r plus
the cell's radius and exceeds the distance to its own pivot by at most 2r, and its distance to the bisecting plane of the
two pivots is at most r. Each vector lies in one block of its home cell, of bounded size, and a block is one row of the
shared folder. Two blocks are compared once, if each has vectors for which the bounds leave the other's cell open, and then
by those vectors only; tasks read the blocks from the folder, so nothing is replicated on disk. How much the bounds exclude
depends on the data: where distances concentrate, as for random directions in many dimensions, it is little and the join
costs what comparing all blocks costs. Blocks are compared in single precision, first by a bound from half of the parts where
that leaves few pairs open, and pairs whose cosine is still open in double precision.

Equal vectors are one class, so a vector that a third of all rows hold is compared once. A group of vectors that are
all linked yields counts and a star, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import look_up, pick, stage
from resultmart.llm.components import components, smallest

#: Bounds allow for rounding by this much.
SLACK = 1e-9
#: Most cells; their pivots, radii and sizes are what the driver holds.
MAX_CELLS = 2048
#: Most bytes of the vectors of a block.
BLOCK_BYTES = 2 << 20
#: Blocks of a file: a task holds those of some files at a time.
FILE_BLOCKS = 8
#: Pairs of vectors that are compared at once, whose cosines stay in a core's cache.
TILE = 1 << 18


def _vectors(kind: str):
    """Adds digest, raw bytes and length; null for a vector that links with nothing."""
    names = ["vec_id", "digest", "raw", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, raws, sizes = [], [], []
            for x in b.column(1):
                raw = None
                if x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy().astype(kind)
                    if len(v) and np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                raws.append(raw)
                sizes.append(len(v) if raw else None)
                digests.append(hashlib.sha256(raw).digest() if raw else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary()), pa.array(sizes, pa.int32())], names=names)

    return run


def unit(raw: list[bytes], kind: str, size: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that neither very small nor very large parts get lost."""
    v = np.frombuffer(b"".join(raw), kind).reshape(-1, size).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * v @ w.T))


class Cells:
    """Pivots of each vector length; numbers of cells run through all lengths, and numbers of blocks through all cells."""

    def __init__(self, pivots: dict[int, np.ndarray], kind: str, radius: float, block_rows: int) -> None:
        self.pivots, self.kind, self.radius, self.block_rows = pivots, kind, radius, block_rows
        self.first = dict(zip(pivots, np.cumsum([0, *[len(p) for p in pivots.values()]]).tolist()))
        self.total = sum(len(p) for p in pivots.values())
        self.reach: np.ndarray | None = None  # of each cell, the largest distance of a home row to its pivot
        self.blocks: np.ndarray | None = None  # of each cell, how many there are
        self.rest_rows = 1  # most rows of a length without pivots, which has one cell of its own

    def rows_of(self, size: int) -> int:
        """Rows of a block of vectors of this length."""
        return max(1, min(self.block_rows, BLOCK_BYTES // (size * np.dtype(self.kind).itemsize)))

    def settle(self, reach: np.ndarray, homes: np.ndarray) -> None:
        """Cut cells into blocks, where the largest distances and the numbers of their home rows are known."""
        rows = np.concatenate([np.full(len(p), self.rows_of(size)) for size, p in self.pivots.items()] or [np.ones(0)])
        self.reach, self.blocks = reach, np.maximum(1, np.ceil(homes / rows)).astype(np.int64)

    def homes(self, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Home cells of unit vectors and the distances to their pivots."""
        d = _distances(v, self.pivots[size])
        home = d.argmin(axis=1)
        return home + self.first[size], d[np.arange(len(d)), home]

    def place(self, v: np.ndarray, size: int, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of unit vectors and their blocks."""
        if size not in self.pivots:
            n = math.ceil(self.rest_rows / self.rows_of(size))
            return np.full(len(v), -size), -1 - (size * n + (spread % np.uint64(n)).astype(np.int64))
        cells = self.homes(v, size)[0]
        return cells, (np.cumsum(self.blocks) - self.blocks)[cells] + (spread % self.blocks[cells].astype(np.uint64)).astype(np.int64)

    def enters(self, v: np.ndarray, size: int, cell: int, others: np.ndarray) -> np.ndarray:
        """Whether other cells may hold partners of unit vectors of a cell (rows, cells)."""
        if cell < 0:
            return np.tile(others == cell, (len(v), 1))
        p, first = self.pivots[size], self.first[size]
        own, far = p[[cell - first]], p[others - first]
        near, d = _distances(v, own), _distances(v, far)
        into = (d <= self.reach[others] + self.radius + SLACK) & (d - near <= 2 * self.radius + SLACK)
        into &= d * d - near * near <= 2 * self.radius * _distances(own, far) + SLACK
        into[:, others == cell] = True
        return into


def _by_size(b: pa.RecordBatch, raw: int, size: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    sizes = b.column(size).to_numpy()
    raws = b.column(raw).to_pylist()
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            yield int(s), part, [raws[k] for k in part]


def _homes(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, count = np.zeros(cells.total), np.zeros(cells.total, np.int64)
        for b in batches:
            for size, _, raw in _by_size(b, 1, 2):
                if size in cells.pivots:
                    home, d = cells.homes(unit(raw, cells.kind, size), size)
                    np.maximum.at(far, home, d)
                    count += np.bincount(home, minlength=cells.total)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(far[some]), pa.array(count[some])], names=["cell", "far", "n"])

    return run


def _placed(cells: Cells):
    """Every class with the number of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = b.column(0).to_numpy()
            for size, at, raw in _by_size(b, 1, 2):
                spread = (reps[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cell, block = cells.place(unit(raw, cells.kind, size), size, spread)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(cell, pa.int32()), pa.array(np.full(len(at), size), pa.int32()), pa.array(reps[at]), b.column(3).take(pa.array(at)), pa.array(raw, pa.binary())], names=["block", "cell", "size", "rep", "copies", "raw"])

    return run


def _packed(cells: Cells):
    """A block as one row, with the cells that may hold partners of its vectors."""
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("size", pa.int32()), ("into", pa.list_(pa.int32())), ("reps", pa.binary()), ("copies", pa.binary()), ("raw", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        block, cell, size = (group.column(c)[0].as_py() for c in ("block", "cell", "size"))
        raw = group.column("raw").to_pylist()
        others = np.array([cell]) if cell < 0 else cells.first[size] + np.arange(len(cells.pivots[size]))
        into = np.zeros(len(others), bool)
        step = max(1, (1 << 20) // len(others))
        for i in range(0, len(raw), step):
            into |= cells.enters(unit(raw[i : i + step], cells.kind, size), size, cell, others).any(axis=0)
        held = [block, cell, size, others[into].tolist(), group.column("rep").to_numpy().tobytes(), group.column("copies").to_numpy().tobytes(), b"".join(raw)]
        return pa.table([pa.array([x], f.type) for x, f in zip(held, schema, strict=True)], schema=schema)

    return run


def _pairs(blocks: DataFrame) -> DataFrame:
    """Each two blocks that have to be compared, a block with itself too; the folder's files meet pairwise, without an exchange."""
    a, b = (blocks.toDF(*[f"{x}_{c}" for c in blocks.columns]) for x in "ab")
    once = (F.col("a_block") == F.col("b_block")) | ((F.col("a_block") < F.col("b_block")) == (F.pmod(F.col("a_block") + F.col("b_block"), F.lit(2)) == 0))  # spread evenly over the pairs of files
    return a.hint("shuffle_replicate_nl").join(b, once & F.array_contains("a_into", F.col("b_cell")) & F.array_contains("b_into", F.col("a_cell"))).drop("a_into", "b_into", "b_size")


class _Side:
    """One block of a pair."""

    def __init__(self, row: dict, x: str, kind: str) -> None:
        self.block, self.cell = row[f"{x}_block"], row[f"{x}_cell"]
        self.reps, self.copies = (np.frombuffer(row[f"{x}_{c}"], np.int64) for c in ("reps", "copies"))
        self.v = unit([row[f"{x}_raw"]], kind, row["a_size"])
        self.single = self.v.astype(np.float32)
        half = self.v.shape[1] // 2
        self.bound = np.column_stack([self.single[:, :half], np.linalg.norm(self.v[:, half:], axis=1)]).astype(np.float32)  # products of these are at least the cosines, by Cauchy and Schwarz


def _at_least(x: np.ndarray, limit: float) -> np.ndarray:
    """Places, row by row, of the numbers of a matrix that reach a limit; looked for eight at a time, as there are few."""
    over = (x >= limit).ravel()
    whole = len(over) // 8 * 8
    words = over[:whole].view(np.uint64).nonzero()[0]
    if not len(words) and not over[whole:].any():
        return words
    near = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[over[near]], whole + np.flatnonzero(over[whole:])])


class _Found:
    """Links of a task: their number for each class, and stars that connect what they connect."""

    def __init__(self) -> None:
        self.links: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.stars: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def count(self, side: _Side, rows: np.ndarray, copies: np.ndarray) -> None:
        if side.block not in self.links:
            self.links[side.block] = (side.reps, np.zeros(len(side.reps), np.int64))
            self.held += len(side.reps)
        self.links[side.block][1][:] += np.bincount(rows, copies, len(side.reps)).astype(np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.stars.append(smallest(a, b))
        self.held += len(self.stars[-1][0])

    def out(self) -> Iterator[pa.RecordBatch]:
        columns: list[tuple[np.ndarray, ...]] = [(reps[n > 0], n[n > 0], reps[n > 0]) for reps, n in self.links.values()]
        if self.stars:
            node, root = smallest(*(np.concatenate(x) for x in zip(*self.stars, strict=True)))
            columns.append((node, np.zeros(len(node), np.int64), root))
        for c in columns:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["rep", "links", "root"])


def _join(cells: Cells, cosine: float, held_rows: int = 1 << 20):
    """Links of pairs of blocks, together for the pairs of a task."""

    def compare(a: _Side, b: _Side, size: int, found: _Found) -> None:
        doubt = (size + 4) * 2.0**-23  # single precision errs by less; pairs this near to the threshold are computed again in double
        same = a.block == b.block
        rows, cols = (np.flatnonzero(cells.enters(x.v, size, x.cell, np.array([y.cell]))[:, 0]) for x, y in ((a, b), (b, a)))
        if not len(rows) or not len(cols):
            return
        bounded = size >= 32  # as long as bounds from half of the parts leave few pairs open
        half, whole = b.bound[cols].T, b.single[cols].T
        step = max(1, TILE // len(cols))
        space = np.empty((min(step, len(rows)), len(cols)), np.float32)
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            out = space[: len(r)]
            if bounded:
                at = _at_least(np.matmul(a.bound[r], half, out=out), cosine - doubt)
                if not len(at):
                    continue
                near = np.zeros(len(at), bool)
                bounded = len(at) <= out.size >> 8
            if not bounded:
                at = _at_least(np.matmul(a.single[r], whole, out=out), cosine - doubt)
                near = out.ravel()[at] >= cosine + doubt
            if not len(at):
                continue
            x, y = r[at // len(cols)], cols[at % len(cols)]
            open_ = np.flatnonzero(~near)
            for i in range(0, len(open_), 8192):
                o = open_[i : i + 8192]
                near[o] = np.einsum("ij,ij->i", a.v[x[o]], b.v[y[o]]) >= cosine
            if same:
                near &= x != y
            x, y = x[near], y[near]
            if len(x):
                found.count(a, x, b.copies[y])
                if not same:
                    found.count(b, y, a.copies[x])
                found.link(a.reps[x], b.reps[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, a = _Found(), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if a is None or a.block != row["a_block"]:
                    a = _Side(row, "a", cells.kind)
                compare(a, a if a.block == row["b_block"] else _Side(row, "b", cells.kind), row["a_size"], found)
                if found.held >= held_rows:
                    yield from found.out()
                    found = _Found()
        yield from found.out()

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_rows: int = 4096, min_cells: int = 8, sample_rows: int = 8192, max_lengths: int = MAX_CELLS) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``cosine``; one row per input row.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included) and
    kept (vec_id = component_id). Vectors that are null, empty, zero or hold a null or a number that isn't finite link
    with nothing, nor do vectors of different lengths or rows with a null vec_id (component_id null, not kept).
    Repeated rows are rows of their own that link with each other, and so are rows of one vec_id with different vectors,
    which link only if their vectors do. An empty table gives an empty result; extra columns
    are dropped. ``vectors`` is read twice. A block has ``block_rows`` vectors on average, fewer where they are long; there are at
    least ``min_cells`` cells for each length, where it has so many different vectors; pivots are chosen from ``sample_rows``
    classes for the ``max_lengths`` most frequent lengths of vectors; vectors of any other length have one cell of their own.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    parsed = pick(vectors, vec_id=(id_col, "long"), embedding=(vector_col, "array<float>" if kind == "<f4" else "array<double>")).mapInArrow(_vectors(kind), "vec_id long, digest binary, raw binary, size int")
    rows = stage(parsed.select("vec_id", "digest").withColumn("node", F.spark_partition_id()), "vectors")
    usable = parsed.where("vec_id IS NOT NULL AND digest IS NOT NULL")
    classes = stage(usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.first("raw").alias("raw"), F.first("size").alias("size"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    k = min(MAX_CELLS, max(min_cells, math.ceil(n / block_rows)))

    held = classes.select(F.col("class").alias("rep"), "raw", "size", "copies")
    sample = classes.select("size", "raw").orderBy(F.xxhash64("digest"), "digest").limit(sample_rows).collect()
    lengths = [r["size"] for r in classes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(max_lengths).collect()]
    pivots = {}
    for size in lengths:
        own = [bytes(r.raw) for r in sample if r["size"] == size]
        pivots[size] = _spread(unit(own, kind, size), k) if own else np.eye(1, size)
    cells = Cells(pivots, kind, math.sqrt(2 - 2 * cosine), block_rows)
    cells.rest_rows = max(1, math.ceil(n / max_lengths))  # a length that isn't among the most frequent has no more rows than one in so many
    reach, homes = np.zeros(cells.total), np.zeros(cells.total)
    for cell, far, count in held.mapInArrow(_homes(cells), "cell int, far double, n long").groupBy("cell").agg(F.max("far"), F.sum("n")).collect():
        reach[cell], homes[cell] = far, count
    cells.settle(reach, homes)
    placed = held.mapInArrow(_placed(cells), "block long, cell int, size int, rep long, copies long, raw binary")
    blocks = stage(placed.groupBy("block").applyInArrow(_packed(cells), "block long, cell int, size int, into array<int>, reps binary, copies binary, raw binary"), "blocks", file_rows=FILE_BLOCKS)
    found = stage(_pairs(blocks).mapInArrow(_join(cells, cosine), "rep long, links long, root long"), "links", batch_rows=2)

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found, "rep", "root")
    of = classes.select("digest", "rep", "class", "copies").join(counts.toDF("class", "links"), "class", "left").join(reached.toDF("class", "component"), "class", "left")
    least = of.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    # copies of one vector, and a component, may be a third of all rows
    of = look_up(of.withColumn("node", F.shiftright("class", 33)), least, ["component"]).select("digest", "rep", "copies", "links", F.col("least").alias("component"))
    usable = F.col("vec_id").isNotNull() & F.col("rep").isNotNull()
    joined = look_up(rows.select("vec_id", "digest", "node"), of, ["digest"])
    out = joined.select("vec_id", F.when(usable, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(usable, F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _spread(v: np.ndarray, k: int) -> np.ndarray:
    """Pivots from a sample, each next one far from those before it, but half of the sample at most is nearer to none."""
    chosen = [0]
    d = 1 - v @ v[0]
    while len(chosen) < min(k, len(v)):
        at = int(np.argsort(d, kind="stable")[len(d) * 3 // 4]) if len(d) > 4 else int(d.argmax())
        if d[at] <= 0:
            at = int(d.argmax())
            if d[at] <= 1e-12:
                break
        chosen.append(at)
        d = np.minimum(d, 1 - v @ v[at])
    return v[chosen]
