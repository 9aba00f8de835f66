"""Byte-pair encoding and decoding.

A word is a doubly linked list of symbols; a priority queue holds the merges that are possible, by rank and then place.
A popped merge whose left symbol is gone, or whose pair would no longer give the same symbol, is stale and skipped.
Decoding joins the vocabulary strings of the ids.

The text before merging: strings of special tokens are cut out, the rest is composed (NFC), its white space runs become
one space, letters become lower case one by one, and the pattern below gives the words; each word's bytes stand for
symbols, and the last one carries the end-of-word mark. Beyond Latin letters, composition and letter classes depend on
the version of Unicode, and come from the vocabulary file's own normaliser and splitter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resultmart.llm.common import documents, parts_of, pick
from resultmart.llm.tokens import LETTERS, Pieces

#: Words of a generation that a worker remembers.
CACHE = 150_000
#: Text that is encoded at once.
TEXT_BYTES = 4_000_000
#: Fixed value: the pattern of words, for text up to U+024F.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w]|[_\x1c-\x1f])+")


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        self.end = held["model"]["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(held["model"]["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in (vocab | self.special).items():
            self.strings[i] = text
        self.inner = [vocab[x] for x in LETTERS]
        self.last = [vocab[x + self.end] for x in LETTERS]
        self.words: dict[bytes, bytes] = {}
        parts = Tokenizer.from_file(path)
        self.normalise, self.split = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str
        self.byte_of = {x: b for b, x in enumerate(LETTERS)}
        self.old: dict[bytes, bytes] = {}
        self.table = pa.array([x + " " for x in self.strings])

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        queue = [(*found, i) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, new, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue
            now = ranks.get((ids[i], ids[j]))
            if now is None or now[1] != new:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (*found, i))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (*found, h))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """The ids of a text without U+0020, as little-endian 32-bit bytes."""
        out = []
        for k, part in enumerate(self.cut.split(piece) if self.cut and "<|" in piece else [piece]):
            if k % 2:
                out.append(np.array([self.special[part]], "<i4").tobytes())
                continue
            if not part:
                continue
            if part.isascii() or max(part) < "ɐ" and "İ" not in part:
                found = [x.encode() for x in WORDS.findall(part.lower())]
            else:
                found = [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.split(self.normalise(part))]
            for word in found:
                ids = self.words.get(word)
                if ids is None:
                    if len(self.words) >= CACHE:
                        self.old, self.words = self.words, {}
                    ids = self.words[word] = self.old.get(word) or array("i", self.merge(word)).tobytes()
                out.append(ids)
        return b"".join(out)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's end. Words never hold white space, so each distinct piece between spaces is encoded once."""
        split = Pieces(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "))
        return split.gathered(pa.array(map(self._piece, split.names.to_pylist()), pa.binary()), np.dtype("<i4"))

    def encode(self, text: str) -> bytes:
        return self.flat(pa.array([text], pa.string()))[0].tobytes()

    def decoded(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that stand end to end: the vocabulary's strings, joined by one space."""
        strings = self.table.take(ids)
        places = np.zeros(len(ends) + 1, np.int32)
        places[1:] = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1)[ends]
        spaced = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), strings.buffers()[2] or pa.py_buffer(b"")])
        return pc.binary_slice(spaced, 0, -1).cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decoded(pa.array(ids, pa.int32()), np.array([len(ids)]))[0].as_py()


@functools.lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for rows in parts_of(batches, TEXT_BYTES):
            flat, ends = model.flat(rows.column(1))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], names=["doc_id", "ids"])

    return run


def _decode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy()
            for i in range(0, b.num_rows, 64):  # the strings of a whole batch would be many
                part = b.slice(i, 64)
                ends = at[i : i + part.num_rows + 1]
                texts = model.decoded(lists.values.slice(ends[0], ends[-1] - ends[0]), ends[1:] - ends[0])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; one row per input row.

    Null and empty texts have no ids. A null doc_id stays null, repeated rows repeat, an empty table stays empty, and
    extra columns are dropped. The strings of special tokens in a text give their ids.
    """
    return documents(docs, id_col, text_col).mapInArrow(_encode(tokenizer), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text: the vocabulary strings of the ids, special ones too, joined by one space. Null ids are no ids."""
    rows = pick(tokens, doc_id=(id_col, "long"), ids=(ids_col, "array<int>")).withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.mapInArrow(_decode(tokenizer), "doc_id long, ids array<int>, text string")
