"""Source divergence audit: how the terms of each source differ from those of its language and of other sources.

A term is a run of ASCII letters and characters beyond ASCII, its A-Z lower-cased. A language keeps the terms that
enough of its documents hold. The kept terms, sorted, become minimal acyclic transducers: states that accept the same
endings are one, and the arcs' outputs add up to the term's ordinal, its place among the language's terms by their
bytes. The texts are then streamed through them byte by byte, all terms of a batch at a time, and ordinals are counted.
Ordinals stand for terms from there on, also where values tie.

A transducer holds at most ``SHARD_TERMS`` terms; a language has as many as it needs, one behind the other. All of them
go to every task while they have at most ``BROADCAST_BYTES``; beyond, tasks count their terms and these meet the ordinals
by a join. Both ways give the same counts.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.llm.common import parts_of, pick, release, stage

#: Documents that have to hold a term.
MIN_DOCS = 10
#: Ranks of terms.
TOP = 10
#: Terms of a transducer, and what all of them may have for every task to get them.
SHARD_TERMS = 1 << 16
BROADCAST_BYTES = 64 << 20
#: Different terms that a task counts before it passes them on, and text that it streams at once.
COUNTED, TEXT_BYTES = 200_000, 2_000_000
#: Counts of ordinals that a task holds as numbers.
HELD = 2_000_000
#: Ordinals and sources of a tile of counts.
TILE_TERMS, TILE_SOURCES = 4096, 64
SCALE = 1_000_000_000

_LETTER = [b for b in range(256) if b >= 0x80 or chr(b).isalpha()]
#: Bytes as they stand in terms: A-Z as a-z, and a space for what is in none.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTER else 32 for b in range(256))


class Transducer:
    """A minimal acyclic transducer of sorted terms with their ordinals as outputs.

    A state's arcs stand together, by their bytes; ``bits`` has a bit for each of a state's bytes in four words, and
    ``base`` says where the arcs of each word start. ``out`` is how many terms come before those of an arc.
    """

    def __init__(self, n: int, start: int, bits: np.ndarray, base: np.ndarray, target: np.ndarray, out: np.ndarray, final: np.ndarray) -> None:
        self.n, self.start, self.bits, self.base, self.target, self.out, self.final = n, start, bits, base, target, out, final

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        """From different terms in ascending order: the path that a term shares with the one before stays open, the rest is closed from its end, each state found again or registered."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []
        open_: list[tuple[list[tuple[int, int]], list[bool]]] = [([], [False])]  # arcs (byte, state) and whether it accepts, along the last term
        last = b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                arcs, final = open_.pop()
                key = (final[0], *arcs)
                state = register.get(key)
                if state is None:
                    state = register[key] = len(states)
                    states.append(key)
                open_[-1][0].append((last[len(open_) - 1], state))

        n = 0
        for term in terms:
            if n and term <= last:
                raise ValueError("terms have to be different and ascending")
            shared = next((i for i, (x, y) in enumerate(zip(term, last, strict=False)) if x != y), min(len(term), len(last)))
            close(shared)
            for _ in term[shared:]:
                open_.append(([], [False]))
            open_[-1][1][0] = True
            last, n = term, n + 1
        close(0)
        states.append((open_[0][1][0], *open_[0][0]))
        return cls._laid_out(n, states)

    @classmethod
    def _laid_out(cls, n: int, states: list[tuple]) -> Transducer:
        accepted = [0] * len(states)  # a state's targets have smaller numbers
        bits, base = np.zeros((len(states), 4), np.uint64), np.zeros((len(states), 4), np.int32)
        target, out = [], []
        for i, (final, *arcs) in enumerate(states):
            before = int(final)
            words = [0, 0, 0, 0]
            starts = [len(target) + sum(b >> 6 < w for b, _ in arcs) for w in range(4)]
            for b, state in arcs:
                words[b >> 6] |= 1 << (b & 63)
                target.append(state)
                out.append(before)
                before += accepted[state]
            accepted[i], bits[i], base[i] = before, words, starts
        return cls(n, len(states) - 1, bits, base, np.array(target, np.int32), np.array(out, np.int32), np.array([x[0] for x in states], bool))

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of states for bytes: whether there is one, and its number."""
        word, bit = byte >> 6, (byte & 63).astype(np.uint64)
        bits = self.bits[state, word]
        there = (bits >> bit & np.uint64(1)).astype(bool)
        return there, self.base[state, word] + np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))

    def ordinals(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinals of the terms at these places of a text; -1 for others. All terms go forward a byte at a time."""
        out = np.full(len(starts), -1, np.int64)
        live, at = np.arange(len(starts)), starts.copy()
        state, total = np.full(len(starts), self.start, np.int32), np.zeros(len(starts), np.int64)
        while len(live):
            done = at == ends[live]
            if done.any():
                accepted = done & self.final[state]
                out[live[accepted]] = total[accepted]
                live, at, state, total = live[~done], at[~done], state[~done], total[~done]
            there, arc = self.step(state, text[at])
            arc = arc[there]
            live, at, state, total = live[there], at[there] + 1, self.target[arc], total[there] + self.out[arc]
        return out

    def terms(self) -> Iterator[bytes]:
        """All terms in order."""
        states, arc_bytes = np.nonzero(np.unpackbits(np.ascontiguousarray(self.bits).view(np.uint8), axis=1, bitorder="little"))
        first = np.searchsorted(states, np.arange(len(self.final) + 1)).tolist()
        arcs = [(bytes([b]), t) for b, t in zip(arc_bytes.tolist(), self.target.tolist(), strict=True)]
        final, open_ = self.final.tolist(), [(b"", self.start)]
        while open_:
            path, state = open_.pop()
            if final[state]:
                yield path
            open_.extend((path + b, t) for b, t in arcs[first[state] : first[state + 1]][::-1])

    def parts(self) -> dict:
        return {"n": self.n, "start": self.start, **{x: getattr(self, x).tobytes() for x in ("bits", "base", "target", "out", "final")}}

    @classmethod
    def from_parts(cls, p: dict) -> Transducer:
        kinds = {"bits": "<u8", "base": "<i4", "target": "<i4", "out": "<i4", "final": "?"}
        held = {x: np.frombuffer(p[x], kind) for x, kind in kinds.items()}
        return cls(p["n"], p["start"], held["bits"].reshape(-1, 4), held["base"].reshape(-1, 4), held["target"], held["out"], held["final"])


def _runs(batch: pa.RecordBatch, name: str) -> Iterator[tuple[str, pa.Table]]:
    """Rows of equal values in a column: the value and the rows."""
    held = pa.Table.from_batches([batch])
    for value in held[name].unique().to_pylist():
        yield value, held.filter(pc.equal(held[name], pa.scalar(value)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, docs) of a task's documents, terms as bytes."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "term", "docs"])
        counts.clear()

    for batch in parts_of(batches, TEXT_BYTES):
        for lang, rows in _runs(batch, "lang"):
            held = counts.setdefault(lang, Counter())
            for text in rows["text"].cast(pa.binary()).to_pylist():
                held.update(set(text.translate(BYTES).split(b" ")))
            del held[b""]
        if sum(map(len, counts.values())) > COUNTED:
            yield from flush()
    yield from flush()
    release()


_SHARD = "lang string, part int, number int, n int, start int, bits binary, base binary, target binary, out binary, final binary"
_SHARD_SCHEMA = pa.schema([("lang", pa.string())] + [(x, pa.int32()) for x in ("part", "number", "n", "start")] + [(x, pa.binary()) for x in ("bits", "base", "target", "out", "final")])


def _build(shard_terms: int):
    """Transducers of sorted (lang, term) rows, and before each of them the terms themselves with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = ((lang, term) for b in batches for lang, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for lang, group in itertools.groupby(rows, key=lambda x: x[0]):
            while terms := [term for _, term in itertools.islice(group, shard_terms)]:
                parts = Transducer.of(terms).parts()
                yield pa.RecordBatch.from_pylist([{"lang": lang, "part": part, "number": number} | parts], schema=_SHARD_SCHEMA)
                number += 1
        release()

    return run


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term as bytes, docs) and their transducers; a shard's terms are those behind the shard before it.

    ``docs`` has lang and text, neither null.
    """
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, docs long")
    kept = stage(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "kept-terms")
    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return kept, stage(ordered.mapInArrow(_build(shard_terms), _SHARD), "transducers")


def _before(shards: DataFrame) -> DataFrame:
    """(lang, part, number, before, size): terms of the language in the shards before each; a row a shard."""
    order = Window.partitionBy("lang").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    size = sum((F.octet_length(x) for x in ("bits", "base", "target", "out", "final")), F.lit(0).cast("long"))
    return shards.select("lang", "part", "number", "n", size.alias("size")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def _streamed(shards: list[tuple[int, Transducer]], texts: list[bytes], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of one language, the ordinals of their kept terms and the number in ``of`` of the text that holds each."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    raw = np.frombuffer(b" ".join([b"", *texts, b""]).translate(BYTES), np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    found, held_by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for before, held in shards:
        ordinals = held.ordinals(raw, starts, ends)
        hit = ordinals >= 0
        found.append(ordinals[hit] + before)
        held_by.append(of[np.searchsorted(np.cumsum(sizes), starts[hit] - 1, "right")])
        starts, ends = starts[~hit], ends[~hit]
    return np.concatenate(found), np.concatenate(held_by)


class _Counts:
    """How often each ordinal occurs in each source of a language; ``size`` different ones at the last look."""

    def __init__(self) -> None:
        self.sources: dict[str, int] = {}
        self.keys, self.n, self.size, self.new = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0

    def add(self, ordinals: np.ndarray, sources: np.ndarray) -> None:
        keys, n = np.unique(sources << 40 | ordinals, return_counts=True)
        self.keys.append(keys)
        self.n.append(n)
        self.new += len(keys)
        if self.new > max(COUNTED, self.size):
            self.gather()

    def gather(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.n = [keys], [np.bincount(at, np.concatenate(self.n), len(keys)).astype(np.int64)]
        self.size, self.new = len(keys), 0

    def rows(self, lang: str) -> pa.RecordBatch:
        self.gather()
        keys = self.keys[0]
        sources = pa.array(list(self.sources), pa.string()).take(pa.array(keys >> 40))
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), sources, pa.array(keys & (1 << 40) - 1), pa.array(self.n[0])], names=["lang", "source", "ordinal", "n"])


def _recount(held):
    """Rows (lang, source, ordinal, n) of a task's documents; ``held`` is the broadcast of all transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, list] = {}
        for lang, before, parts in held.value:
            shards.setdefault(lang, []).append((before, Transducer.from_parts(parts)))
        counts: dict[str, _Counts] = {}
        for batch in parts_of(batches, TEXT_BYTES):
            for lang, rows in _runs(batch, "lang"):
                mine = counts.setdefault(lang, _Counts())
                of = np.array([mine.sources.setdefault(x, len(mine.sources)) for x in rows["source"].to_pylist()], np.int64)
                mine.add(*_streamed(shards.get(lang, []), rows["text"].cast(pa.binary()).to_pylist(), of))
            if sum(x.size for x in counts.values()) > HELD:
                yield from (x.rows(lang) for lang, x in counts.items())
                counts = {}
        yield from (x.rows(lang) for lang, x in counts.items())
        release()

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n) of a task's documents."""
    counts: dict[tuple[str, str], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["lang", "source", "term", "n"])
        counts.clear()

    for batch in parts_of(batches, TEXT_BYTES):
        for lang, rows in _runs(batch, "lang"):
            for source, texts in _runs(rows.combine_chunks().to_batches()[0], "source"):
                held = counts.setdefault((lang, source), Counter())
                held.update(b" ".join(texts["text"].cast(pa.binary()).to_pylist()).translate(BYTES).split())
        if sum(map(len, counts.values())) > COUNTED:
            yield from flush()
    yield from flush()
    release()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of transducers (lang, part, number, ordinal in the shard, term)."""
    for b in batches:
        for row in b.to_pylist():
            terms = pa.array(Transducer.from_parts(row).terms(), pa.binary())
            same = [pa.array([row[x]], kind).take(pa.array(np.zeros(len(terms), np.int32))) for x, kind in (("lang", pa.string()), ("part", pa.int32()), ("number", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(terms))), terms], names=["lang", "part", "number", "place", "term"])


def ordinals_of(shards: DataFrame) -> DataFrame:
    """(lang, ordinal, term as bytes) of all kept terms."""
    listed = shards.mapInArrow(_listed, "lang string, part int, number int, place long, term binary")
    return listed.join(_before(shards).select("lang", "part", "number", "before"), ["lang", "part", "number"]).select("lang", (F.col("place") + F.col("before")).alias("ordinal"), "term")


def recount(docs: DataFrame, shards: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): how often kept terms occur in each source of a language."""
    spark, before = docs.sparkSession, _before(shards)
    texts = docs.select("lang", "source", "text")
    if (before.agg(F.sum("size")).first()[0] or 0) <= broadcast_bytes:
        rows = shards.join(before.select("lang", "part", "number", "before"), ["lang", "part", "number"]).collect()
        held = spark.sparkContext.broadcast([(r.lang, r.before, {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()}) for r in sorted(rows, key=lambda r: (r.lang, r.before))])
        found = texts.mapInArrow(_recount(held), "lang string, source string, ordinal long, n long")
    else:
        terms = texts.mapInArrow(_term_counts, "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        found = terms.join(ordinals_of(shards), ["lang", "term"]).drop("term")
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", over, (total + 2 * terms).cast("decimal(20,0)")) + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As ``_share``: long division digit by digit, as SCALE * n need not fit 64 bits."""
    below = total + 2 * terms
    whole, rest = np.divmod(n + 2, below)
    for _ in range(9):
        more, rest = np.divmod(rest * 10, below)
        whole = whole * 10 + more
    return whole + 1


def _tile(tile_terms: int, tile_sources: int):
    """Sums over a tile's terms for each pair of a source of the lower and one of the higher group of sources."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, block, low, high = (x.as_py() for x in key)
        source, ordinal, n = (rows[x].to_numpy() for x in ("number", "ordinal", "n"))
        head = ordinal < 0
        total, terms = rows["total"].to_numpy()[head], int(rows["terms"][0].as_py())
        names = source[head]
        order = np.argsort(names)
        names, total = names[order], total[order]
        width = max(0, min(tile_terms, terms - block * tile_terms))
        used, column = np.unique(ordinal[~head] - block * tile_terms, return_inverse=True)
        none = [int(_shares(np.zeros(1, np.int64), int(t), terms)[0]) if terms else 0 for t in total]
        p = np.repeat(np.array(none, np.int64)[:, None], len(used), axis=1)
        of = np.searchsorted(names, source[~head])
        for k in range(len(names)):
            mine = of == k
            if mine.any():
                p[k, column[mine]] = _shares(n[~head][mine], int(total[k]), terms)
        none = np.array(none, np.int64)
        a, b, value = [], [], []
        for k in np.flatnonzero(names // tile_sources == low):
            others = np.flatnonzero((names // tile_sources == high) & (names > names[k]))
            if len(others):
                sums = _distance(p[k], p[others]).sum(axis=1)
                if width > len(used):
                    sums += (width - len(used)) * _distance(none[k], none[others])
                a.append(np.full(len(others), names[k]))
                b.append(names[others])
                value.append(sums)
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, value)]
        return pa.table([pa.array([lang] * len(flat[0]), pa.string()), *map(pa.array, flat)], names=["lang", "a", "b", "value"])

    return run


def _pairs(counts: DataFrame, groups: DataFrame, tile_terms: int, tile_sources: int) -> DataFrame:
    """(lang, a, b, value) for all pairs a < b of numbers of sources of a language."""
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(terms - 1) div {tile_terms}")))))
    heads = heads.select("lang", "number", F.lit(-1).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n"), "block", "total", "terms", "sources")
    known = groups.select("lang", "source", "number", "terms", "sources")
    rows = counts.join(known, ["lang", "source"]).select("lang", "number", "ordinal", "n", F.expr(f"ordinal div {tile_terms}").alias("block"), F.lit(0).cast("long").alias("total"), "terms", "sources")
    mine = F.expr(f"number div {tile_sources}")
    dealt = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {tile_sources}"))))
    dealt = dealt.withColumn("low", F.least(mine, "other")).withColumn("high", F.greatest(mine, "other")).select("lang", "block", "low", "high", "number", "ordinal", "n", "total", "terms")
    tiles = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_tile(tile_terms, tile_sources), "lang string, a long, b long, value long")
    return tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_bytes: int = BROADCAST_BYTES, shard_terms: int = SHARD_TERMS, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """How far each source of a language is from the others, and by which terms it differs most from the language.

    With p = 1 + floor(10^9 (count + 2) / (N + 2 V)) of each of a language's V kept terms (those in at least
    ``min_docs`` of its documents), N all their occurrences in the source, and f = floor((p - q)^2 / (p + q)):
    part ``pair`` has one row for each other source of the language, value the sum of f over all kept terms (0 without
    any); part ``term`` has the ``top`` terms by f that occur in the source with p above the language's own q. Returns
    lang, source, part, item, value and rank, from 1 by descending value and then by the item's bytes.

    Null texts, languages and sources are empty strings, which are a language and a source like others. Rows repeat as
    documents of their own, whatever their ids; a source without terms has its pairs; a language with one source has no
    pairs. An empty table gives an empty one; other columns are dropped.
    """
    rows = pick(docs, lang=(lang_col, "string"), source=(source_col, "string"), text=(text_col, "string")).fillna("")
    _, shards = vocabulary(rows, min_docs, shard_terms)
    counts = stage(recount(rows, shards, broadcast_bytes), "term-counts")
    terms = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0)
    groups = groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = stage(groups, "sources")

    pairs = _pairs(counts, groups, tile_terms, tile_sources)
    names = groups.select("lang", F.col("number").alias("a"), "source")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    both = both.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n_all"))
    size = groups.groupBy("lang").agg(F.sum("total").alias("total_all"))
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("n_all"), F.col("total_all"), F.col("terms"))
    seen = counts.join(whole, ["lang", "ordinal"]).join(groups.join(size, "lang"), ["lang", "source"]).select("lang", "source", "ordinal", p.alias("p"), q.alias("q")).where("p > q")
    best = seen.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))).where(F.col("rank") <= top)
    term = best.join(ordinals_of(shards), ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pair.unionByName(term)
