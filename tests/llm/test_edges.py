"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from resultmart.llm.bpe import decode, encode
from resultmart.llm.exact_dedup import exact_duplicates
from resultmart.llm.line_dedup import dedup_lines
from resultmart.llm.metric_join import embedding_links
from resultmart.llm.near_dup import near_duplicates
from resultmart.llm.packing import pack
from resultmart.llm.quality import fit_quality, score_quality
from resultmart.llm.sharding import shard
from resultmart.llm.token_file import read_tokens, write_tokens
from resultmart.llm.warc import resolve_revisits

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "same text here, long enough\nsecond line of the text", 7, "x"),
    (2, "same  text here,\tlong enough second line of the text", 7, None),
    (2, "same text here, long enough\nsecond line of the text", 7, "x"),
    (3, None, None, None),
    (4, "", 7, "x"),
    (5, LONG, 7, "x"),
    (None, "same text here, long enough\nsecond line of the text", 7, "x"),
    (None, None, 7, "x"),
    (6, "   \n\n ", 7, "x"),
    (7, "word", 7, "x"),
    (7, "word", 7, "x"),
]
SCHEMA = "doc_id long, text string, n_lines int, `TEXT` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in rows), key=str)


def test_exact(docs, nothing):
    out = exact_duplicates(docs, fan_bits=1).collect()
    assert len(out) == len(ROWS)
    assert by_id(out, "keep_id", "group_size", "kept") == sorted([(1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True)], key=str)
    assert exact_duplicates(nothing).count() == 0


def test_lines(docs, nothing):
    out = {(r.doc_id, r.text): r for r in dedup_lines(docs).collect()}
    assert out[1, ROWS[0][1]].n_dropped == 0
    assert out[2, ""].n_dropped == 2 and out[2, ""].n_lines == 2 and out[2, ""].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[3, ""].n_lines == 1 and out[None, ROWS[0][1]].n_dropped == 0 and out[6, "   \n\n "].n_lines == 3
    assert dedup_lines(docs, min_docs=3).where("n_dropped > 0").count() == 0
    assert dedup_lines(nothing).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs, keep=["n_lines"])


def test_tokens(docs, nothing, spark, tmp_path):
    write_tokens(docs, f"{tmp_path}/a", BYTE, segment_ids=50)
    out = read_tokens(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    assert out[5].ids == [0] and out[6].ids == [0]
    write_tokens(nothing, f"{tmp_path}/b", BYTE)
    assert read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_bpe(docs, nothing):
    out = encode(docs, WORD)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert {r.doc_id: r.ids for r in out.collect()}[3] == []
    assert {r.doc_id: r.text for r in decode(out, WORD).collect()}[7] == "word</w>"
    assert decode(encode(nothing, WORD), WORD).count() == 0


def test_packing(docs, nothing):
    out = pack(docs, WORD, length=64).orderBy("sequence_id", "offset").collect()
    assert all(b.offset == (a.offset + a.length) % 64 for a, b in zip(out, out[1:]))
    assert sum(r.length for r in out) == sum(len(r.ids) + 1 for r in encode(docs, WORD).collect())
    assert pack(nothing, WORD).count() == 0


def test_near(docs, nothing):
    out = by_id(near_duplicates(docs).collect(), "n_shingles", "component_id")
    kept = by_id(near_duplicates(docs, keep=["n_lines"]).collect(), "kept", "n_lines")
    assert kept.count((1, True, 7)) == 1 and kept.count((2, False, 7)) == 2 and kept.count((7, True, 7)) == 2 and (3, True, None) in kept and (None, True, 7) in kept
    with pytest.raises(ValueError):
        near_duplicates(docs, keep=["n_shingles"])
    assert len(out) == len(ROWS) and (2, 6, 1) in out and (3, 0, 3) in out and (4, 0, 4) in out and (6, 0, 6) in out and (7, 1, 7) in out and (5, 29996, 5) in out
    assert near_duplicates(nothing).count() == 0


def test_quality(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (5, 0), (6, 1)], "doc_id long, quality int")
    out = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {True}
    empty = fit_quality(docs, labels.limit(0))
    assert {r.score for r in score_quality(docs, empty).collect()} == {0.5}
    assert score_quality(nothing, empty).count() == 0


def test_sharding(docs, nothing):
    out = shard(docs, 60).collect()
    assert len(out) == len(ROWS)
    sizes = {}
    for r in out:
        sizes.setdefault((r.prefix, r.part), []).append(r.n_bytes)
    assert all(sum(v) <= 60 or len(v) == 1 for v in sizes.values())
    assert all(r.shard_bytes == sum(sizes[r.prefix, r.part]) and r.shard_docs == len(sizes[r.prefix, r.part]) for r in out)
    assert shard(nothing, 60).count() == 0
    assert {r.depth for r in shard(docs, 1 << 40).collect()} == {0}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-300, 1e-300]), (9, [1e-300, 1e-300]), (10, [float("inf"), 1.0]), (11, [1.0, 0.0])]
    out = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=2)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (11, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, False), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True)], key=str)
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (1, [0.0, -1.0])]
    out = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=2)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()) == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.example/x/?b=1&a=2#f", 10, "response", 200, h(ETag='"q"', Content_Length="5", Server="s")),
        (2, "https://a.example:443/x?a=2&b=1&utm_source=z", 20, "revisit", 304, h(etag='W/"q"', content_length="0", date="d")),
        (3, "http://a.example/x?a=2&b=1", 10, "revisit", 304, h(etag='"q"')),
        (4, "http://a.example/x?a=2&b=1", 30, "response", 404, h(etag='"r"')),
        (5, "http://a.example/x?a=2&b=1", 40, "revisit", 304, h(etag='"r"')),
        (6, "http://a.example/x?a=2&b=1", 41, "revisit", 304, None),
        (7, None, 41, "revisit", 304, h(etag='"q"')),
        (8, "http://b.example", None, "revisit", 304, h(etag='"q"')),
        (9, "http://b.example", 5, "response", 200, h(Last_Modified="m")),
        (10, "http://b.example/index.html", 6, "revisit", 304, h(last_modified="m", expires="e")),
        (10, "http://b.example/index.html", 6, "revisit", 304, h(last_modified="m", expires="e")),
    ]
    schema = "record_id long, url string, captured long, kind string, status int, headers map<string,string>, full int, part string"
    out = resolve_revisits(spark.createDataFrame([(*r, 1, "x") for r in rows], schema))
    got = {r.record_id: (r.response_id, r.outcome) for r in out.collect()}
    assert got == {2: (1, "resolved"), 3: (None, "missing"), 5: (1, "changed"), 6: (1, "unvalidated"), 7: (None, "missing"), 8: (None, "missing"), 10: (9, "resolved")}
    assert out.count() == 8
    assert out.where("record_id = 2").first().headers == {"content-length": "5", "server": "s", "etag": 'W/"q"', "date": "d"}
    assert resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_many_lengths_of_vectors(spark):
    rows = [(10 * n + k, [1.0] * n + [0.01 * k]) for n in range(1, 8) for k in range(3)] + [(500, [0.0] * 5 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, block_rows=2, max_lengths=2).collect()}
    assert out == {10 * n + k: (2, 10 * n) for n in range(1, 8) for k in range(3)} | {500: (0, 500)}


def test_vectors_are_not_replicated(spark, monkeypatch):
    """However many cells a vector may have partners in, it is written once, and comparing blocks exchanges nothing."""
    from resultmart.llm import metric_join as m

    written, stage = {}, m.stage
    monkeypatch.setattr(m, "stage", lambda df, label, *a, **k: written.setdefault(label, (df, stage(df, label, *a, **k)))[1])
    v = np.random.default_rng(4).standard_normal((300, 32))
    v[150:200] = v[100:150] + 0.05
    v[200:260] = v[7]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    out = embedding_links(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), block_rows=16).orderBy("vec_id").collect()
    assert [r.n_links for r in out] == (linked.sum(axis=1) - 1).tolist() and linked.sum() > 3700
    assert "Exchange" not in written["links"][0]._jdf.queryExecution().executedPlan().toString()
    blocks = written["blocks"][1].collect()
    reps = np.concatenate([np.frombuffer(r.reps, np.int64) for r in blocks])
    assert len(blocks) > 15 and len(reps) == len(set(reps.tolist())) == 240
    pairs = {(r.a_block, r.b_block) for r in m._pairs(written["blocks"][1]).collect()}
    assert all(a == b or (b, a) not in pairs for a, b in pairs) and len(pairs) <= len(blocks) * (len(blocks) + 1) / 2


def test_hub_lists_over_many_tasks(spark):
    """One shingle list that goes on in other tasks has the hub of its first row there."""
    from resultmart.llm.near_dup import _shared, _with_hubs

    rows = [(5, p << 32 | 40, 100 + p) for p in range(30)] + [(t, 40, t) for t in range(20, 26)] + [(30, 40, 1), (30, 41, 2)]
    df = spark.createDataFrame(rows, "token long, spot long, cid long").repartitionByRange(6, "token", "spot", "cid").sortWithinPartitions("token", "spot", "cid")
    raw = df.mapInArrow(_shared, "token long, spot long, cid long, hub_spot long, hub long, part int").cache()
    out = _with_hubs(raw).collect()
    assert {(r.cid, r.hub, r.hub_spot) for r in out if r.token == 5} == {(100 + p, 100, 40) for p in range(30)}
    assert {(r.cid, r.hub) for r in out if r.token == 30} == {(1, 1), (2, 1)} and raw.select("part").distinct().count() > 2


def test_scratch_folder_is_named(spark, monkeypatch):
    from types import SimpleNamespace

    from resultmart.llm.common import clear, scratch, stage

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(other, "x")
    held = stage(spark.range(3), "three")
    assert held.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        held.count()
