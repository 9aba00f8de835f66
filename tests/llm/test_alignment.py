"""Alignment of two tokenizers against a plain version over the libraries."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from resultmart.llm import alignment
from resultmart.llm.alignment import align, aligner, digest_of_groups, groups, links, merge_path, overlaps, score_links
from resultmart.llm.queries import BYTE_BPE, PIECES, op12_alignment
from tests.llm.test_token_fuzz import odd_texts

SF = "/root/testdata/sf0.001"
B = SentencePieceProcessor(model_file=PIECES)
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
A = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """(id, bytes) of both sides; none where they don't spell the text."""
    if not text:
        return [], []
    a = [(i, A.decode_single_token_bytes(i)) for i in A.encode_ordinary(" " + text)]
    b = [(i, bytes([int(x[3:5], 16)]) if B.is_byte(i) else x.replace("▁", " ").encode()) for i, x in ((i, B.id_to_piece(i)) for i in B.encode(text))]
    spelt = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == spelt == b"".join(x for _, x in b) else ([], [])


def plain_groups(text):
    a, b = tokens(text)
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        ids_a, ids_b = [], []
        while not ids_a or at_a != at_b:
            if at_a <= at_b:
                ids_a.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                ids_b.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
        out.append((ids_a, ids_b))
    return out


def plain(texts):
    """One tuple of FIELDS per text."""
    all_groups = [plain_groups(x) for x in texts]
    held = [Counter((x, y) for a, b in found for x in a for y in b) for found in all_groups]
    count = Counter(x for each in held for x in each)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for found, each in zip(all_groups, held, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        sums = sum(n for (a, b), n in each.items() if count[a, b] == best[a]), sum(n * count[x] for x, n in each.items())
        out.append((sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), each.total(), *sums, hashlib.sha256(line.encode()).hexdigest() if found else ""))
    return out


def scored(docs):
    return score_links(docs, BYTE_BPE, PIECES, digest_of_groups(BYTE_BPE, PIECES), "groups_sha256 string")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), max_size=60), st.integers(1, 9))
def test_pieces_of_the_merge_path(steps_a, steps_b, piece):
    total = sum(steps_a)
    a = np.cumsum(steps_a)
    b = np.append([x for x in np.cumsum(steps_b) if x < total], total) if steps_b else np.array([total])
    holder, meets = overlaps(a, b, piece)
    assert holder.tolist() == [int((b < x).sum()) for x in a]
    assert meets.tolist() == [x in b for x in a]
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    diagonals = np.arange(len(merged) + 1)
    assert merge_path(a, b, diagonals).tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals]


@pytest.mark.parametrize("limits", [(64, 2_000_000, 65_536), (1, 3, 7)])
def test_links_of_a_batch(limits, monkeypatch):
    plain_links, at_once, ends = limits
    monkeypatch.setattr(alignment, "PLAIN_LINKS", plain_links)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
    texts = [x.replace("\x00", "") for x in odd_texts(600, 8)] + ["na" * 500, "😀" * 200, "a▁b"]
    batch = aligner(BYTE_BPE, PIECES).align(pa.array(range(len(texts))), pa.array(texts))
    doc, code, times = links(batch, 50257)
    found = {(d, c // 50257, c % 50257): n for d, c, n in zip(doc.tolist(), code.tolist(), times.tolist(), strict=True)}
    expected = Counter((d, x, y) for d, text in enumerate(texts) for a, b in plain_groups(text) for x in a for y in b)
    assert found == expected


def test_rows_blocks_and_edges(spark, monkeypatch):
    texts = [None, "", " ", "a▁b", *odd_texts(300, 7), "same text. Twice", "same text. Twice", "x" * 50_000, "<|endoftext|> and <s>"]
    ids = [None, None, *range(len(texts) - 3), 5]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, n_links string").repartition(5)
    found = Counter((r.doc_id, *(r[x] for x in FIELDS)) for r in scored(docs).collect())
    assert found == Counter((i, *x) for i, x in zip(ids, plain(texts), strict=True))
    assert scored(docs.limit(0)).count() == 0
    spans = {}
    text = next(x for x in texts[10:] if len(plain_groups(x)) > 10)
    aligned = align(docs.where(F.col("text") == text), BYTE_BPE, PIECES)
    for r in groups(aligned, BYTE_BPE, PIECES).orderBy("group").collect():
        spans[r.group] = (r.a_ids, r.b_ids, r.start, r.end)
    spelt = (" " + text).encode()
    assert [(a, b) for a, b, _, _ in spans.values()] == plain_groups(text)
    assert b"".join(spelt[s:e] for _, _, s, e in spans.values()) == spelt


def test_query(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 1000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: x for r, x in zip(docs, plain([r.text for r in docs]), strict=True)}
    found = op12_alignment(spark, SF).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: tuple(r[x] for x in FIELDS) for r in found} == expected
