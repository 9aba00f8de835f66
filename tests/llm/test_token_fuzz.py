"""Encoders against their libraries on texts of odd letters, marks, punctuation and white space."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from resultmart.llm.bpe import Bpe
from resultmart.llm.tokens import PieceEncoder

LETTERS = "İ ı ß ẞ ǅ ﬁ Å é é Ω Ж 日 ก ำ İ̇ ŉ ΐ Σ ς Ǆ ² ½ Ⅷ ٣ 𐐀 ꟃ Ა ა a B z Q 7 0".split(" ")
MARKS = ["́", "̇", "ͅ", "⃝", "‍", "️", "̸", "▁"]
SIGNS = [*"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'", "…", "—", "«", "😀", "'s", "'LL", "<|endoftext|>", "<s>", "<0x41>"]
SPACES = [" "] * 8 + ["\n", "\t", "  ", "    ", " ", "　", "\r\n", "\x00"]
CASED = [chr(c) for c in range(0x80, 0x1F000) if chr(c).lower() != chr(c)]
ANY = [chr(c) for c in range(0xA1, 0x2FFFF) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    groups = [LETTERS, LETTERS, MARKS, SIGNS, SIGNS, SPACES, SPACES, CASED, ANY]
    return ["", " ", "YENİ.", "haber YENİ, bugün"] + ["".join(rng.choice(rng.choice(groups)) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_odd_texts(name, plain):
    path, texts = public_tokenizers.path(name), odd_texts(8000, 1)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = plain
    own = PieceEncoder(path, plain)
    found = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_merge_queue_on_odd_texts():
    path, texts = public_tokenizers.path("word_bpe_49k.json"), odd_texts(8000, 2)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own = Bpe(path)
    for text, x in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == x.ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
