"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and some pairs of features a table over coarser bins; a score is the
logistic function of an intercept and one entry of each table. Tables are learned by cyclic boosting: rounds visit the
features in turn, fit a shallow tree over the feature's bins to the gradient of the log loss and add a small part of it
to the table. Pairs are ranked by how much a tree over them lowers what the single features leave, and the best are
boosted the same way.

The model is fitted on a sample of labelled rows of at most ``max_rows`` (those with the smallest hashes of doc_id);
features of the sample are all that reaches the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, pick, rows_of
from resultmart.llm.shingles import word_hashes

#: Text whose features are computed at once.
TEXT_BYTES = 1_000_000
#: Byte classes whose share of a text is a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*!|<>=~^_{}[]\\/@+`",
    "stop": b".,;:?",
    "bar": b"|",
    "mark": b"!",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
}
FEATURES = ("chars", "words", *CLASSES, "beyond_ascii", "repeated_next", "distinct_words", "word_chars", "distinct_lines")


def features(texts: list[str]) -> np.ndarray:
    """(n, len(FEATURES)); all from the text, zeros for an empty one."""
    raw = [x.encode() for x in texts]
    out = np.zeros((len(raw), len(FEATURES)))
    counts = np.zeros((len(raw), 256))
    hashes, at = word_hashes(raw)
    for i, x in enumerate(raw):
        counts[i] = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        words = hashes[at[i] : at[i + 1]]
        n = len(words)
        lines = x.split(b"\n")
        out[i, -1] = len(set(lines)) / len(lines)
        if n:
            out[i, 1] = np.log1p(n)
            out[i, -4] = (words[1:] == words[:-1]).mean() if n > 1 else 0
            out[i, -3] = len(np.unique(words)) / n
            out[i, -2] = len(texts[i]) / n
    total = counts.sum(axis=1)
    out[:, 0] = np.log1p(total)
    share = np.maximum(total, 1)
    for k, held in enumerate(CLASSES.values()):
        out[:, 2 + k] = counts[:, list(held)].sum(axis=1) / share
    out[:, 2 + len(CLASSES)] = counts[:, 128:].sum(axis=1) / share
    return out


@dataclass
class AdditiveModel:
    """Tables over bins; bins of a feature are cut at ``edges``, those of a pair at ``coarse``."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k])]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return g.sum() / (h.sum() + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to cut a row of bins in two, by gain; 0 for none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over the bins of one feature, as a table."""
    _, k = _cut(g, h) if depth else (0, 0)
    if not k:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, depth: int = 3) -> np.ndarray:
    """A shallow tree over the bins of two features, as a table."""
    (rows, i), (columns, j) = (_cut(g.sum(axis=k), h.sum(axis=k)) for k in (1, 0)) if depth else ((0, 0), (0, 0))
    if not i and not j:
        return np.full(g.shape, _leaf(g, h))
    if rows >= columns:
        return np.concatenate([_pair_tree(g[:i], h[:i], depth - 1), _pair_tree(g[i:], h[i:], depth - 1)])
    return np.concatenate([_pair_tree(g[:, :j], h[:, :j], depth - 1), _pair_tree(g[:, j:], h[:, j:], depth - 1)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, coarse: int = 8, n_pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Learn from features and labels 0 or 1. Without rows, or with one label only, the score is constant."""
    model = AdditiveModel()
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, coarse + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate_of_one / (1 - rate_of_one)))
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, c) for e, c in zip(model.edges, x.T, strict=True)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)))
            table += step
            total += step[at[k]]
    near = [np.searchsorted(e, c) for e, c in zip(model.coarse, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grids(a: int, b: int) -> list[np.ndarray]:
        return [np.bincount(near[a] * sizes[b] + near[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in slopes()]

    gains = {}
    for a, b in itertools.combinations(range(x.shape[1]), 2):
        g, h = grids(a, b)
        gains[a, b] = float((_pair_tree(g, h) * g).sum())
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _pair_tree(*grids(a, b))
            table += step
            total += step[near[a], near[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in rows_of(batches):
        x = features(texts)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows that aren't held out; null labels and ids are left out."""
    marked = pick(labels, doc_id=(id_col, "long"), quality=(label_col, "int")).dropna().where(~held_out(F.col("doc_id")))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = documents(docs, id_col, text_col).join(F.broadcast(marked), "doc_id").select("doc_id", "text", "quality")  # at most max_rows pairs of numbers
    found = sorted((r.doc_id, r.quality, bytes(r.features)) for r in rows.mapInArrow(_sampled, "doc_id long, quality int, features binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in found)).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float))


def _scores(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_of(batches, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(features(texts)))], names=[*rows.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, columns in ``keep``, held_out, score (0 to 1) and predicted (1 if score >= ``threshold``); one row per input row.

    Null texts count as empty and get a score too; rows with a null doc_id are held out; repeated rows get equal scores;
    an empty table gives an empty result; other columns are dropped, and those to keep may not be called like results.
    """
    rows = documents(docs, id_col, text_col, keep, ("held_out", "score", "predicted"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(_scores(model), f"{fields}, score double")
    return scored.select("doc_id", "text", *keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
