"""The SentencePiece operator against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from resultmart.llm.queries import op11_sentence_pieces
from resultmart.llm.sentence import SentencePiece, decode_pieces, encode_pieces
from tests.llm.test_token_fuzz import odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
RUNS = [" " * k + x for k in range(40) for x in ("", "a", "the", "\nfoo", " ▁", "é")]


@pytest.fixture(scope="module")
def own():
    return SentencePiece(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lists(flat, ends):
    return [x.tolist() for x in np.split(flat, ends[:-1])]


def test_texts_as_the_library_encodes_and_decodes_them(own):
    rng = random.Random(4)
    texts = odd_texts(8000, 3) + RUNS + ["".join(rng.choice("abenrst th") for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + ["ab" * 20_000, "日本語" * 5000]
    flat, ends = own.flat(pa.array(texts))
    expected = LIBRARY.encode(texts, num_threads=1)
    assert lists(flat, ends) == expected
    assert own.decoded(flat, ends).to_pylist() == [LIBRARY.decode(x) for x in expected]


def test_any_ids_are_decoded_as_by_the_library(own):
    rng = random.Random(5)
    ids = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), 28705, 259, rng.randrange(190, 259)]) for _ in range(rng.randrange(1, 8))] for _ in range(8000)]
    found = own.decoded(np.array([i for x in ids for i in x], np.int32), np.cumsum([len(x) for x in ids]))
    assert found.to_pylist() == [LIBRARY.decode(x) for x in ids]


def test_table_holds_the_last_token_of_every_prefix(own):
    for text in ("▁unbelievable", "▁▁▁strengths日", "▁internationalisation"):
        expected = []
        for k in range(1, len(text) + 1):
            ids = LIBRARY.encode(text[1:k].replace("▁", " "))
            expected.append(ids[-1] if k > 1 else own.plain["▁"])
        found = own.last_tokens(text)[1:]
        assert [x for x, c in zip(found, text, strict=True) if c != "日"] == [x for x, c in zip(expected, text, strict=True) if c != "日"]


def test_edges(spark, own):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "same  text\n", 0), (3, "same  text\n", 0), (4, "x" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = decode_pieces(encode_pieces(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text, r.ids) for r in found) == sorted((str(d), t or "", LIBRARY.encode(t or "")) for d, t, _ in rows)
    assert encode_pieces(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_pieces(nulls, PATH).collect()[0].text == ""


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in docs:
        ids = LIBRARY.encode(r.text or "")
        expected[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_sentence_pieces(spark, sf).collect()} == expected
