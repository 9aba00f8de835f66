"""Registered queries against their SQL, and the pipeline against its stages written plainly."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from resultmart.llm.common import clear
from resultmart.llm.exact_dedup import exact_duplicates
from resultmart.llm.queries import ORACLES, QUERIES
from resultmart.llm.quality import CLASSES, FEATURES, fit_quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def library(name):
    held = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: held.encode(x, add_special_tokens=False).ids, held


def crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = con.execute(ORACLES[name])
    at = [[x[0] for x in found.description].index(c) for c in names]
    want = [tuple(r[k] for k in at) for r in found.fetchall()]
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    step = dict(corpus_pipeline.STAGES)
    good = step["quality classifier"](spark, docs, SF)
    marks = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    ids = {r.doc_id for r in good.collect()}
    assert all(r.text == kept[r.doc_id] for r in good.collect())
    assert sum((i in ids) == bool(marks[i]) for i in marks) >= 0.97 * len(marks)

    lines = step["line deduplication"](spark, good, SF)
    first: dict = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i in sorted(ids):
        for line in kept[i].split("\n"):
            first.setdefault(key(line), i)
    want = {i: "\n".join(x for x in kept[i].split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i in ids}
    want = {i: t for i, t in want.items() if t or not kept[i]}
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    apart = step["n-gram Jaccard join"](spark, lines, SF)
    sets = {i: shingles(t) for i, t in want.items()}
    group = components(sets)
    assert {r.doc_id: r.text for r in apart.collect()} == {i: want[i] for i in want if group[i] == i} and apart.columns == docs.columns
    packed = step["curve packing"](spark, apart, SF).collect()
    assert_packed(packed, {r.doc_id: r.text for r in apart.collect()})
    assert {(r.doc_id, r.start, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.start, r.sequence_id, r.offset) for r in packed}
    clear(spark)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets):
    """The smallest id that each one reaches, from all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in sets}


def assert_packed(rows, texts, length=2048):
    """Every id lies in one piece, and sequences are full from 0 on but for the last."""
    encode, _ = library("word_bpe_49k.json")
    ids = {i: [*encode(t or ""), 1] for i, t in texts.items()}
    found: dict = {i: [] for i in ids}
    place = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * length + r.offset == place and r.offset + r.length <= length and r.doc_tokens == len(ids[r.doc_id])
        place += r.length
        found[r.doc_id].append((r.start, r.length, r))
    for i, parts in found.items():
        at = 0
        for start, n, r in sorted(parts, key=lambda x: x[0]):
            assert start == at
            piece = ids[i][start : start + n]
            assert r.ids == piece if "ids" in r else r.ids_crc32 == crc32(piece)
            at += n
        assert at == len(ids[i])


def test_token_file_query(spark, texts):
    encode, _ = library("byte_bpe_50k.json")
    start = 0
    rows = {r.doc_id: r for r in QUERIES["op1_token_file"](spark, SF).collect()}
    for i in sorted(texts):
        ids = [*encode(texts[i]), 0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc32(ids))
        start += len(ids)


def test_packing_query(spark, texts):
    assert_packed(QUERIES["op9_hilbert_packing"](spark, SF).collect(), texts)


def test_bpe_query(spark, texts):
    encode, held = library("word_bpe_49k.json")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op10_bpe"](spark, SF).collect():
        ids = encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(held.decode(ids, skip_special_tokens=False)))


def plain_features(text):
    raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    low = [w.lower() for w in words]
    share = [sum(b in held for b in raw) / max(1, len(raw)) for held in CLASSES.values()]
    beyond = sum(b > 127 for b in raw) / max(1, len(raw))
    again = sum(a == b for a, b in itertools.pairwise(low)) / (len(low) - 1) if len(low) > 1 else 0
    lines = raw.split(b"\n")
    n = len(words)
    return [math.log1p(len(raw)), math.log1p(n), *share, beyond, again, len(set(low)) / n if n else 0, len(text) / n if n else 0, len(set(lines)) / len(lines)]


def test_quality_scores_by_look_ups(spark, texts):
    """The query's scores from plain features and the model's tables, read one by one."""
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bin_of = lambda edges, x: sum(e < x for e in edges)
    for r in QUERIES["op5_quality_gam"](spark, SF).collect():
        x = plain_features(texts[r.doc_id])
        assert len(x) == len(FEATURES)
        total = model.intercept + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        total += sum(t[bin_of(model.coarse[a], x[a]), bin_of(model.coarse[b], x[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-35, min(35, total)))), abs_tol=1e-6)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_more_partitions_than_tasks(spark):
    """Rows are told apart where a task goes through several partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(120, "doc_id")
    step = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id: r.text for r in docs.collect()}
    group = components({i: shingles(t) for i, t in kept.items()})
    assert {r.doc_id for r in step["n-gram Jaccard join"](spark, docs, SF).collect()} == {i for i in kept if group[i] == i}
    assert_packed(step["curve packing"](spark, docs, SF).collect(), kept)
    lines = step["line deduplication"](spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted((r.doc_id, r.text) for r in step["line deduplication"](spark, docs.coalesce(1), SF).collect())
    out = {(r.doc_id, r.keep_id, r.group_size) for r in exact_duplicates(docs).collect()}
    assert out == {(r.doc_id, r.keep_id, r.group_size) for r in QUERIES["op7_exact_dedup"](spark, SF).collect()}
