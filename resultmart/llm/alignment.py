"""Alignment of two tokenizers' tokens by merge-path partitioning, and how often aligned tokens go together.

The ends of A's and of B's tokens in the bytes of the same texts are two rising sequences. Merging them is divided by
diagonals of the merge path: a binary search on each gives the place where as many ends lie before it as its number
says, so that every piece merges the same number of ends, however they are spread over documents and tokens. A piece
finds for each of its A ends the B token that holds it, which gives the overlaps of the two; where both end, a group
ends. The last A end of a piece may meet the first B end of the next one: there pieces are stitched.

Every A and B token of one group are linked. How many documents hold a linked pair of ids is counted over blocks of
documents: a task writes its documents' pairs as numbers of a dictionary of the block. Only the dictionaries (pair,
documents) are exploded, summed by pair and brought back to their blocks, so no pair, however frequent, has more than a
row a block. A group's pairs are made from its distinct ids on either side with their numbers.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, parts_of, release, stage
from resultmart.llm.sentence import sentence_piece
from resultmart.llm.tokens import SPELT, PieceEncoder, encoder

#: Text that is aligned at once.
TEXT_BYTES = 4_000_000
#: Ends that a piece of the merge path holds.
PIECE_ENDS = 65_536
#: Pairs of documents of a block, each counted once a document.
BLOCK_PAIRS = 1_500_000
#: Groups with more links than this make them from distinct ids, and such links are made so many at a time.
PLAIN_LINKS, LINKS_AT_ONCE = 64, 2_000_000

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary"
_ALIGNED_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d ends of the merge are A's, for each diagonal d; of equal ends, A's comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        other = diagonals - mid - 1
        take = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)])
        low, high = np.where(take, mid + 1, low), np.where(open_ & ~take, mid, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, piece_ends: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """For each A end the number of the B token that holds it, and whether that token ends there too.

    A token i overlaps the B tokens from ``holder[i - 1] + meets[i - 1]`` to ``holder[i]``.
    """
    holder = np.zeros(len(a), np.int64)
    if not len(a) or not len(b):
        return holder, np.zeros(len(a), bool)
    diagonals = np.append(np.arange(0, len(a) + len(b), piece_ends), len(a) + len(b))
    at = merge_path(a, b, diagonals)
    of = diagonals - at
    for i, j, k, m in zip(at[:-1].tolist(), at[1:].tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
        holder[i:j] = k + np.searchsorted(b[k:m], a[i:j])
    return holder, b[np.minimum(holder, len(b) - 1)] == a  # beyond a piece's B ends stands the next one's first


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return np.diff(total[ends], prepend=0)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of binary values end to end, and where each value ends."""
    size = np.dtype(kind).itemsize
    places = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    flat = np.frombuffer(data, kind, (places[-1] - places[0]) // size, places[0]) if data and places[-1] > places[0] else np.zeros(0, kind)
    return flat, ((places[1:] - places[0]) // size).astype(np.int64)


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    places = np.zeros(len(ends) + 1, np.int32)
    places[1:] = ends * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(flat.tobytes())])


class Aligner:
    """Tokens of A (byte-level BPE, a space before the text) and of B (SentencePiece, which puts that space itself)."""

    def __init__(self, a: str, b: str) -> None:
        self.a: PieceEncoder = encoder(a, True)
        self.b = sentence_piece(b)
        byte_of = {c: i for i, c in SPELT.items()}
        names = self.a.library.get_vocab(with_added_tokens=False)
        spelt = [b""] * self.a.library.get_vocab_size()
        for x, i in names.items():
            spelt[i] = bytes(map(byte_of.__getitem__, x)) if all(c in byte_of for c in x) else b""
        self.tables = pa.array(spelt, pa.binary()), pa.array(self.b.token_bytes, pa.binary())
        self.sizes = tuple(np.array([len(x) for x in t.to_pylist()], np.int64) for t in self.tables)

    def forget(self) -> None:
        self.a.forget()
        self.b.forget()

    def _spells(self, side: int, ids: np.ndarray, ends: np.ndarray, text: pa.Array) -> np.ndarray:
        """Whether the tokens of each text spell it."""
        spelt = self.tables[side].take(pa.array(ids))
        raw, places = memoryview(spelt.buffers()[2] or b""), np.concatenate([[0], np.cumsum(self.sizes[side][ids])])
        raw = raw[: places[-1]]
        want_at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)
        want = memoryview(text.buffers()[2] or b"")[: want_at[-1]]
        at = np.concatenate([[0], places[ends]])
        if np.array_equal(at, want_at) and raw == want:
            return np.ones(len(text), bool)
        return np.array([raw[i:j] == want[k:m] for i, j, k, m in zip(at[:-1].tolist(), at[1:].tolist(), want_at[:-1].tolist(), want_at[1:].tolist(), strict=True)], bool)

    def align(self, docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        texts = pc.fill_null(texts, "")
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" "))
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(False)
        sides = []
        for side, (ids, ends) in enumerate((self.a.flat(spaced), self.b.flat(texts))):
            some = some & self._spells(side, ids, ends, spaced)
            sides.append((ids.astype("<u4"), ends.astype(np.int64)))
        if not some.all():
            sides = [self._only(ids, ends, some) for ids, ends in sides]
        (a, a_ends), (b, b_ends) = sides
        _, meets = held = overlaps(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        cuts_a = np.flatnonzero(meets) + 1
        cuts_b = held[0][cuts_a - 1] + 1
        ends = np.searchsorted(cuts_a, a_ends, "right")  # groups up to the end of each text
        of_a, of_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        numbers = [np.diff(x, prepend=0) for x in (a_ends, b_ends, ends)] + [_sums(of_a * of_b, ends)]
        lists = [_binary(a, a_ends), _binary(b, b_ends), _binary(of_a.astype("<u4"), ends), _binary(of_b.astype("<u4"), ends)]
        return pa.RecordBatch.from_arrays([docs, *map(pa.array, numbers), *lists], names=_ALIGNED_NAMES)

    @staticmethod
    def _only(ids: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(ends, prepend=0)
        return ids[np.repeat(some, n)], np.cumsum(np.where(some, n, 0))


@functools.lru_cache(2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = aligner(a, b)
        for rows in parts_of(batches, TEXT_BYTES):
            yield models.align(rows.column(0), rows.column(1))
        models.forget()
        release()

    return run


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links; a_ids and b_ids, the tokens' ids, and a_sizes and
    b_sizes, how many tokens of either side each group has, as little-endian unsigned 32-bit numbers.

    Texts that are null or empty, or that the tokens of a side don't spell with one space before it (the other model's
    space mark stands in them, say), have no tokens. A null doc_id stays null, repeated rows repeat, an empty table
    stays empty, and other columns are dropped. Strings of special tokens are ordinary text.
    """
    return documents(docs, id_col, text_col).mapInArrow(_aligned(a, b), ALIGNED)


def _spans(sizes: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (a, _), (b, _), (of_a, _), (of_b, _) = (_flat(row.column(k), "<u4") for k in range(5, 9))
                cut_a, cut_b = np.cumsum(of_a), np.cumsum(of_b)
                ends = np.cumsum(sizes[0][a])[cut_a - 1] if len(cut_a) else cut_a
                at = [pa.array(np.concatenate([[0], x]), pa.int32()) for x in (cut_a, cut_b)]
                ids = [pa.ListArray.from_arrays(x, pa.array(y.astype(np.int32))) for x, y in zip(at, (a, b), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(row.column(0).to_pylist() * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.concatenate([[0], ends])[:n]), pa.array(ends, pa.int64()), *ids], names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    return run


def groups(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """One row per group: doc_id, group (from 0), start and end in the bytes of the text with a space before it, a_ids, b_ids."""
    return aligned.select(*_ALIGNED_NAMES).mapInArrow(_spans(aligner(a, b).sizes), "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges with these starts and sizes, one range behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of the distinct ids of each group."""
    keys, n = np.unique(group << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def _weighed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, n, len(out)).astype(np.int64)


def links(batch: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document in the batch, pair (a * wide + b) and number of its links, ascending by document and pair."""
    (a, _), (b, _), (of_a, ends), (of_b, _) = (_flat(batch.column(k), "<u4") for k in range(5, 9))
    of_a, of_b = of_a.astype(np.int64), of_b.astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
    at_a, at_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    a, b, span = a.astype(np.int64), b.astype(np.int64), wide * wide
    n = of_a * of_b
    few = np.flatnonzero(n <= PLAIN_LINKS)
    left = _ranges(at_a[few], of_a[few])
    times = np.repeat(of_b[few], of_a[few])
    right = _ranges(np.repeat(at_b[few], of_a[few]), times)
    keys, times = np.unique(np.repeat(np.repeat(doc[few], of_a[few]) * span + a[left] * wide, times) + b[right], return_counts=True)
    many = np.flatnonzero(n > PLAIN_LINKS)
    if len(many):
        ga, ia, na = _distinct(np.repeat(many, of_a[many]), a[_ranges(at_a[many], of_a[many])])
        gb, ib, nb = _distinct(np.repeat(many, of_b[many]), b[_ranges(at_b[many], of_b[many])])
        first, size = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right") - np.searchsorted(gb, ga)
        made, i = np.cumsum(size), 0
        while i < len(ga):
            z = max(i + 1, int(np.searchsorted(made, (made[i - 1] if i else 0) + LINKS_AT_ONCE, "right")))
            r = _ranges(first[i:z], size[i:z])
            more = np.repeat(doc[ga[i:z]] * span + ia[i:z] * wide, size[i:z]) + ib[r]
            keys, times = _weighed(np.concatenate([keys, more]), np.concatenate([times, np.repeat(na[i:z], size[i:z]) * nb[r]]))
            i = z
    return keys // span, keys % span, times


#: A row is a block of documents: their rows, how many pairs each has, the pairs as numbers of the dictionary with their links, and the dictionary with the documents that hold each pair.
_BLOCK = "block long, doc_rows array<struct<{rows}>>, n_pairs binary, pairs binary, times binary, code array<long>, docs array<int>"


def _blocks(a: str, b: str, derive: Callable | None, kept: pa.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        wide = max(map(len, aligner(a, b).sizes))

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            codes, at, docs = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True, return_counts=True)
            rows = pa.concat_arrays([x[0] for x in held])
            columns = [pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)]
            columns += [pa.array([np.concatenate(x).astype("<u4").tobytes()], pa.binary()) for x in ([x[1] for x in held], [at], [x[3] for x in held])]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), x) for x in (pa.array(codes), pa.array(docs.astype(np.int32)))]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_rows", "n_pairs", "pairs", "times", "code", "docs"])

        for batch in _aligned(a, b)(batches):
            doc, code, times = links(batch, wide)
            columns = {x: batch.column(i) for i, x in enumerate(["doc_id", *_COUNTS])} | (derive(batch) if derive else {})
            rows = pa.StructArray.from_arrays([columns[x.name] for x in kept], fields=list(kept))
            held.append((rows, np.bincount(doc, minlength=batch.num_rows), code, times))
            size += len(code)
            if size >= BLOCK_PAIRS:
                yield flush()
        if held:
            yield flush()

    return run


def _scored(kept: pa.StructType):
    def run(blocks: pa.Table, dictionary: pa.Table) -> pa.Table:
        order = np.argsort(dictionary["place"].to_numpy())
        count, best = (dictionary[x].to_numpy()[order] for x in ("count", "best"))
        block = blocks.combine_chunks().to_batches()[0]
        names = block.schema.names
        rows = block.column(names.index("doc_rows")).flatten()
        (n, _), (at, _), (times, _) = (_flat(block.column(names.index(x)), "<u4") for x in ("n_pairs", "pairs", "times"))
        ends, times = np.cumsum(n), times.astype(np.int64)
        columns = [*rows.flatten(), pa.array(_sums(times * best[at], ends)), pa.array(_sums(times * count[at], ends))]
        return pa.Table.from_arrays(columns, names=[*[x.name for x in kept], "n_best", "count_sum"])

    return run


def score_links(docs: DataFrame, a: str, b: str, derive: Callable | None = None, derived: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best and count_sum.

    All A and B tokens of a group are linked. The count of a pair of ids is the number of rows of all documents that
    hold it linked; n_best counts the links whose pair has the highest count of its A id, ties included, and count_sum
    adds the counts of all links. ``derive`` takes a batch of ``align``'s rows and gives columns that are to be carried
    along, of the types in ``derived``. Edges are as in ``align``: a row without tokens has zeros, and every row counts
    as a document of its own, also repeated ones and those without an id.
    """
    plain = ", ".join([f"{x} long" for x in ["doc_id", *_COUNTS]] + ([derived] if derived else []))
    fields = [x.strip().split() for x in plain.split(",")]
    kept = pa.struct([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in fields])
    schema = _BLOCK.format(rows=", ".join(f"{name}: {kind}" for name, kind in fields))
    blocks = stage(documents(docs, id_col, text_col).mapInArrow(_blocks(a, b, derive, kept), schema), "links")
    wide = max(map(len, aligner(a, b).sizes))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("code", "docs")).alias("place", "e")).select("block", "place", "e.code", "e.docs")
    counts = entries.groupBy("code").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"code div {wide}"))
    counts = stage(counts, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "a").select("code", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    known = entries.join(counts, "code").select(F.col("block").alias("of_block"), "place", "count", "best")
    out = f"{plain}, n_best long, count_sum long"
    return blocks.drop("code", "docs").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_scored(kept), out)


def digest_of_groups(a: str, b: str):
    """Column groups_sha256 of ``align``'s rows: the hash of the groups as text, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    strings: list[pa.Array] = []

    def table(n_a: int, n_b: int) -> pa.Array:
        return pa.array([f"{i}{x}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for x in marks], pa.binary())

    def derive(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes = aligner(a, b).sizes
        if not strings:
            strings.append(table(*map(len, sizes)))
        (a_ids, a_ends), (b_ids, b_ends), (of_a, _), (of_b, _) = (_flat(batch.column(k), "<u4") for k in range(5, 9))
        cut_a, cut_b = np.cumsum(of_a, dtype=np.int64), np.cumsum(of_b, dtype=np.int64)
        codes = np.empty(len(a_ids) + len(b_ids), np.int32)
        for ids, cut, before, first in ((a_ids, cut_a, cut_b - of_b, 0), (b_ids, cut_b, cut_a, 2 * len(sizes[0]))):
            values = first + 2 * ids.astype(np.int32)
            values[cut - 1] += 1
            codes[np.arange(len(ids)) + np.repeat(before, np.diff(cut, prepend=0))] = values
        text = strings[0].take(pa.array(codes))
        places = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)[np.concatenate([[0], a_ends + b_ends])] if len(text) else np.zeros(batch.num_rows + 1, np.int32)
        raw = memoryview(text.buffers()[2] or b"")
        return {"groups_sha256": pa.array([hashlib.sha256(raw[i : z - 1]).hexdigest() if z > i else "" for i, z in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)])}

    return derive
