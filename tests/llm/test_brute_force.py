"""Operators against plain versions of themselves."""

import itertools
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from resultmart.llm import components as graph
from resultmart.llm.bpe import Bpe
from resultmart.llm.elias_fano import EliasFano
from resultmart.llm.metric_join import embedding_links
from resultmart.llm.near_dup import near_duplicates
from resultmart.llm.packing import hilbert_key, pack
from resultmart.llm.quality import AdditiveModel, features, fit
from resultmart.llm.queries import op5_quality_gam, op10_bpe
from resultmart.llm.sharding import shard, write_shards
from resultmart.llm.shingles import shingle_sets
from resultmart.llm.token_file import read_tokens, token_slice, write_tokens
from resultmart.llm.tokens import PieceEncoder
from resultmart.llm.warc import resolve_revisits

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
CODERS = {p: PieceEncoder(p) for p in (WORD, BYTE)}
OWN = Bpe(WORD)
ODD = st.text(st.one_of(st.sampled_from(list(" \t\n\r\x1c\x85\xa0'sdlmretvABcd.,!?123½²éßΣİſ́　")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_coders_agree_with_the_library(text):
    for text in (text, f"<|endoftext|>{text} it's <|startoftext|>"):
        for path in (WORD, BYTE):
            want = LIBRARY[path].encode(text, add_special_tokens=False).ids
            assert np.frombuffer(CODERS[path].encode([text])[0], CODERS[path].dtype).tolist() == want
        ids = np.frombuffer(OWN.encode(text), "<i4").tolist()
        want = LIBRARY[WORD].encode(text, add_special_tokens=False).ids
        assert ids == want
        assert OWN.decode(ids) == LIBRARY[WORD].decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(gaps):
    values = np.cumsum(gaps).astype(np.int64)
    held = EliasFano.of(values)
    assert held.select_all().tolist() == values.tolist()
    assert [held.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    assert held.n_bytes() <= 16 + len(values) * (2 + max(1, int(values[-1]) // len(values)).bit_length() + 1) / 8 + 4 * (1 + len(values) / 256) if len(values) else True
    with pytest.raises(IndexError):
        held.select(len(values))


def test_token_file_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write_tokens(docs, f"{tmp_path}/t", BYTE, end_id=0, segment_ids=3000)
    texts = dict(docs.select("doc_id", "text").collect())
    start = 0
    for r in read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect():
        want = [*LIBRARY[BYTE].encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        start += len(want)
    some = max(texts)
    assert token_slice(spark, f"{tmp_path}/t", some) == [*LIBRARY[BYTE].encode(texts[some], add_special_tokens=False).ids, 0]


def test_encoding_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in op10_bpe(spark, SF).collect():
        assert r.n_tokens == len(LIBRARY[WORD].encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = pack(docs, WORD, end_id=1, length=512).orderBy("sequence_id", "offset").collect()
    ids = {i: [*LIBRARY[WORD].encode(t, add_special_tokens=False).ids, 1] for i, t in docs.select("doc_id", "text").collect()}
    found: dict = {i: [] for i in ids}
    place = 0
    for p in pieces:
        assert (p.sequence_id * 512 + p.offset, p.length, p.doc_tokens) == (place, len(p.ids), len(ids[p.doc_id])) and p.offset + p.length <= 512
        place += p.length
        found[p.doc_id].append((p.start, p.ids))
    for i, parts in found.items():
        assert list(itertools.chain(*[x for _, x in sorted(parts)])) == ids[i]


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_key(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def _groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    texts = ["A b c d e F", "a B c d E f", "a b", "a b c", "", " \n", "x " * 50, "ä Ä ö d e f g"]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(x) for x in sets] == [len(_shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and sets[2] != sets[3]


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    common = " ".join(word() for _ in range(60))
    texts = []
    for size, edits in ((60, 1), (90, 3), (40, 6), (8, 2), (200, 2)):
        base = [word() for _ in range(size)]
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(size)] = word()
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, 5)]
            texts.append(" ".join(copy))
    texts += [common + " " + " ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(60)]
    texts += ["one two", "One  two", "one", "", "zero one two three", "zero one two three four"]
    rng.shuffle(texts)
    sets = [_shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 3000
    out = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).orderBy("doc_id").collect()
    assert [r.n_shingles for r in out] == [len(s) for s in sets]
    assert [r.component_id for r in out] == _groups(len(texts), links)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)]
    want = _groups(1302, links)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    for bound in (20, 10_000):
        got = {r.node: r.component for r in graph.components(df, task_links=bound).collect()}
        assert got == {i: want[i] for i in {x for link in links if link[0] != link[1] for x in link}}


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 12))
    near = v[:40].repeat(5, axis=0) + 0.12 * rng.standard_normal((200, 12))
    v = np.concatenate([v, near, v[:30]]).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    want = _groups(len(v), np.argwhere(linked).tolist())
    for block in (64, 4096):
        out = embedding_links(df, block_rows=block).orderBy("vec_id").collect()
        assert [r.n_links for r in out] == linked.sum(axis=1).tolist()
        assert [r.component_id for r in out] == want
        assert [r.kept for r in out] == [i == c for i, c in enumerate(want)]


def test_vector_links_near_the_threshold(spark):
    """Few links in long vectors, where a bound from half of the parts comes first: just above and just below the threshold, with all weight in either half."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((700, 48))
    v[:100, 24:] = 0
    v[100:200, :24] *= 1e-3
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 60, 2):
        x = v[i * 10]
        y = rng.standard_normal(48) * (x != 0)
        y -= (y @ x) * x
        c = 0.9 + (1e-9 if i % 4 else -1e-9)
        v[i * 10 + 5] = 3 * (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert 20 <= linked.sum() <= 200
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = embedding_links(df, min_cells=2).orderBy("vec_id").collect()
    assert [r.n_links for r in out] == linked.sum(axis=1).tolist()
    assert [r.component_id for r in out] == _groups(len(v), np.argwhere(linked).tolist())


def test_quality_on_held_out_rows(spark):
    marks = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    out = [r for r in op5_quality_gam(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    known = [(r.predicted, marks[r.doc_id]) for r in out if r.doc_id in marks]
    assert len(known) > 5 and sum(a == b for a, b in known) >= 0.9 * len(known)


def test_pairs_are_learned():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    assert AdditiveModel().score(x).tolist() == [0.5] * 4000
    assert features(["", "a b"]).shape == (2, x.shape[1] * 0 + len(features([""])[0]))


def test_shards_are_minimal(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(600)], "doc_id long, text string")
    out = shard(docs, 1500, step=1)
    rows = out.collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.prefix] = sizes.get(r.prefix, 0) + r.n_bytes
    assert max(sizes.values()) <= 1500 and all(r.shard_bytes == sizes[r.prefix] for r in rows)
    for p in sizes:  # only what was too large together was split
        assert sum(v for q, v in sizes.items() if q.startswith(p[:-1])) > 1500
    write_shards(docs, out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 600 and back.select("prefix", "part").distinct().count() == len(sizes)


def test_null_and_repeated_keys_are_written_once(spark, tmp_path):
    texts = [(None, "n" * 20 + str(i)) for i in range(30)] + [(7, "s" * 30 + str(i % 4)) for i in range(60)] + [(7, "y" * 400), (7, None)] + [(i, "x" * (i % 50)) for i in range(100, 150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    write_shards(docs, shard(docs, 300, step=2), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(texts, key=str)
    shards: dict = {}
    for r in back:
        shards.setdefault((r.prefix, r.part), []).append(len(r.text or ""))
    assert len(shards) > 10 and all(sum(v) <= 300 or len(v) == 1 for v in shards.values())
    with pytest.raises(Exception, match="differ"):
        write_shards(docs, shard(docs.where("doc_id = 7"), 300), f"{tmp_path}/other")


def test_revisits_over_many_ranges(spark):
    rng = random.Random(4)
    rows, last, want = [], {}, {}
    for i in range(600):
        url = "http://hot.example/" if rng.random() < 0.6 else f"http://{rng.randrange(9)}.example/"
        if rng.random() < 0.1:
            rows.append((i, url, i, "response", 200, {"etag": str(rng.randrange(2))}))
            last[url] = rows[-1]
        else:
            tag = str(rng.randrange(2))
            rows.append((i, url, i, "revisit", 304, {"etag": tag}))
            found = last.get(url)
            want[i] = (None, "missing") if found is None else (found[0], "resolved" if found[5]["etag"] == tag else "changed")
    df = spark.createDataFrame(rows, "record_id long, url string, captured long, kind string, status int, headers map<string,string>").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.record_id: (r.response_id, r.outcome) for r in resolve_revisits(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_vocabulary_is_read_from_its_file():
    assert OWN.special == {x["content"]: x["id"] for x in json.load(open(WORD, encoding="utf-8"))["added_tokens"]}
