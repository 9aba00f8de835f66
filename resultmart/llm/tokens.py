"""Encoding whole texts with the ``tokenizers`` library, each distinct piece of a batch once.

Both vocabularies in use cut a text at every space before they merge, so the ids of a text are the ids of its pieces in
order. A batch of texts is split at spaces and its distinct pieces are found by Arrow; the ids of a piece are those of
its word and of the ASCII punctuation behind it, and Arrow gathers them in the order of the texts. Word and punctuation
stand apart where the word, as the vocabulary's normaliser leaves it, ends in a letter or number that was one in Unicode
3.2 already (all later versions agree on it; a lower-case letter may be longer than its capital and end in a combining
mark, which the pattern joins with punctuation); other pieces go to the library in one. Words are merged by the
library's model once and remembered while a task runs, two generations of at most ``CACHE`` words; that changes no
result. A text for which the argument doesn't hold (white space side by side or at an end where it matters, a special
token's string) goes to the library whole. With ``plain`` the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation that a task remembers.
CACHE = 300_000
#: ASCII punctuation at the end of a piece, which both patterns cut off from a word; the apostrophe has rules of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is visible in Latin-1, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()
SPELT = dict(enumerate(LETTERS))
#: Stands for the ids of a piece whose text the library encodes whole.
WHOLE = None


class Pieces:
    """The pieces between spaces of a batch of texts: ``names`` holds each distinct one, ``index`` the texts' pieces in order, those of text i from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(texts, " ")
        self.at, self.pieces = lists.offsets.to_numpy(), lists.values
        held = self.pieces.dictionary_encode()
        self.index, self.names = held.indices.to_numpy(), held.dictionary

    def firsts(self) -> pa.Array:
        """The distinct pieces at the start of texts, which get numbers of their own in ``index``, after the others."""
        held = self.pieces.take(pa.array(self.at[:-1])).dictionary_encode()
        self.index = self.index.copy()
        self.index[self.at[:-1]] = held.indices.to_numpy() + len(self.names)
        return held.dictionary

    def gathered(self, ids: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end."""
        taken = ids.take(pa.array(self.index))
        places = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        data = taken.buffers()[2]
        return np.frombuffer(data, kind, places[-1] // kind.itemsize) if data and places[-1] else np.zeros(0, kind), places[self.at[1:]] // kind.itemsize


def split_at(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Each text's ids."""
    return [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def joined(parts: list[np.ndarray], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, kind), *parts]), np.cumsum([len(x) for x in parts]).astype(np.int64)


def lists_of(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of texts as binary values of an Arrow array."""
    places = np.zeros(len(ends) + 1, np.int32)
    places[1:] = ends * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(flat.tobytes())])


class PieceEncoder:
    """``flat(texts)`` gives the ids of all texts end to end as ``dtype``, and where each text's ids end."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special = [] if plain else [x["content"] for x in held["added_tokens"]]
        self.normalise = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.spaced = "Replace" not in json.dumps(held["normalizer"])  # a space is part of the word that follows it
        self.lowers = "Lowercase" in json.dumps(held["normalizer"])
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        """At the end of a task: the memory is another task's."""
        self.words: list[dict] = [{}, {}]  # of pieces at the start of a text or line, and of those behind a space
        self.old: list[dict] = [{}, {}]
        self.odd: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], spaced: bool) -> list[bytes]:
        """The ids of words, merged by the library's model; it takes a byte as a printable letter."""
        start, merge, found = LETTERS[32] if spaced and self.spaced else "", self.merge, []
        for x in words:
            if self.lowers:
                x = x.lower()
            if not x.isascii():
                x = x.encode().decode("latin-1").translate(SPELT)
            found.append(merge(start + x))
        flat = array(self.dtype.char, [t.id for x in found for t in x]).tobytes()
        at = [0, *itertools.accumulate(len(x) * self.dtype.itemsize for x in found)]
        return [flat[a:z] for a, z in itertools.pairwise(at)]

    def _ends_a_word(self, x: str) -> bool:
        return unicodedata.ucd_3_2_0.category((self.normalise(x) or " ")[-1])[0] in "LN"

    def _cores(self, names: list[str], spaced: bool) -> list[bytes | bool]:
        """The ids of pieces without the punctuation at their end; False for one that doesn't stand apart from it."""
        words, old = self.words[spaced], self.old[spaced]
        found = list(map(words.get, names))
        holes = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in holes:
            x = names[i]
            ids = old.get(x)
            if ids is None and x.isalpha() and (x.isascii() or max(x) < "İ"):
                new.append(i)
                continue
            if ids is None:
                ids = x[-1:].isalnum() and self._ends_a_word(x) and "<|" not in x and "\n" not in x and not x[0].isspace() and self._library([(" " if spaced and self.spaced else "") + x])[0].tobytes()
            found[i] = words[x] = ids
        for i, ids in zip(new, self._learn([names[i] for i in new], spaced), strict=True):
            found[i] = words[names[i]] = ids
        return found

    def _odd(self, x: str, spaced: bool) -> bytes | None:
        """The ids of a piece that isn't a word and punctuation."""
        if self.spaced:
            if not x and not spaced:
                return b""
            if not x or x[0].isspace() or x[-1].isspace():
                return WHOLE
        if "<|" in x and any(s in x for s in self.special):
            return WHOLE
        return self._library([(" " if spaced and self.spaced else "") + x])[0].tobytes()

    def _tail(self, x: str) -> bytes:
        if (ids := self.tails.get(x)) is None:
            ids = self.tails[x] = self._library([x])[0].tobytes()
        return ids

    def _pieces(self, names: pa.Array, spaced: bool) -> pa.Array:
        """The ids of distinct pieces: those of the word and of the punctuation behind it; null for ``WHOLE``."""
        cores = pc.ascii_rtrim(names, characters=TAIL)
        held = cores.dictionary_encode()
        ids = self._cores(held.dictionary.to_pylist(), spaced)
        n = (pc.binary_length(names).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)
        tails: dict[str, int] = {"": 0}
        tail = np.zeros(len(names), np.int64)
        some = np.flatnonzero(n)
        for i, x, k in zip(some, names.take(pa.array(some)).to_pylist(), n[some].tolist(), strict=True):
            tail[i] = tails.setdefault(x[-k:], len(tails))
        odd = np.array([x is False for x in ids], bool)[held.indices.to_numpy()]
        out = pc.binary_join_element_wise(
            pa.array([x or b"" for x in ids], pa.binary()).take(held.indices), pa.array([self._tail(x) if x else b"" for x in tails], pa.binary()).take(pa.array(tail)), pa.scalar(b"", pa.binary())
        )
        if odd.any():
            known = self.odd
            new = names.filter(pa.array(odd)).to_pylist()
            for x in new:
                if (x, spaced) not in known:
                    known[x, spaced] = self._odd(x, spaced)
            out = pc.replace_with_mask(out, pa.array(odd), pa.array([known[x, spaced] for x in new], pa.binary()))
        return out

    def _lines(self, names: pa.Array) -> pa.Array:
        """The ids of distinct pieces behind a space or a line feed, which is a word, and the piece behind it has no space before it."""
        fed = pc.starts_with(names, "\n")
        starts = pc.utf8_slice_codeunits(names.filter(fed), 1)
        behind = pc.if_else(pc.equal(starts, ""), pa.scalar(WHOLE, pa.binary()), self._pieces(starts, False))
        ids = pa.concat_arrays([self._pieces(names.filter(pc.invert(fed)), True), pc.binary_join_element_wise(pa.scalar(self._tail("\n")), behind, pa.scalar(b""))])
        place = np.argsort(np.argsort(fed.to_numpy(False), kind="stable"), kind="stable")
        return ids.take(pa.array(place))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if sum(map(len, self.words)) > CACHE:
            self.old, self.words = self.words, [{}, {}]
        if len(self.odd) + len(self.tails) > CACHE:
            self.odd, self.tails = {}, {}
        texts = pc.fill_null(texts, "")
        split = Pieces(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "))
        ids = self._lines(split.names) if self.spaced else self._pieces(split.names, True)
        if self.spaced:
            ids = pa.concat_arrays([ids, self._pieces(split.firsts(), False)])
        flat, ends = split.gathered(ids, self.dtype)
        if not ids.null_count:
            return flat, ends
        rows = np.unique(np.searchsorted(split.at, np.flatnonzero(ids.is_null().to_numpy(False)[split.index]), "right") - 1)
        parts = split_at(flat, ends)
        for i, found in zip(rows.tolist(), self._library(texts.take(pa.array(rows)).to_pylist()), strict=True):
            parts[i] = found
        return joined(parts, self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        return [x.tobytes() for x in split_at(*self.flat(pa.array(texts, pa.string())))]


@functools.lru_cache(2)
def encoder(path: str, plain: bool = False) -> PieceEncoder:
    return PieceEncoder(path, plain)
