"""SentencePiece (BPE) encoding and decoding by a table of the last token of each prefix.

A list of tokens is the encoding of the text that it spells exactly where every two neighbours are compatible: merging
the text of the two gives the two again. So each prefix of a text has one last token: the one token that ends there (an
automaton of all pieces finds them) and is compatible with the last token of the prefix before it. The table is filled
from left to right, and the ids are read backwards from its end. A text of n characters takes at most 16 n tests,
whatever it holds; a merge queue isn't needed.

The model merges the two neighbours whose joined string has the best score, the leftmost first among equals. Two tokens
are tested by taking their own last merges back, latest first: where the two symbols at the border could have been joined
before the merge that was taken back, they aren't compatible. Characters that are no pieces are never merged; their
bytes are tokens.

No piece holds a space behind another character, so a text is cut before each space that follows something else, and
each distinct word of a batch is encoded once, apart from the punctuation behind it where no piece holds both. Texts with
spaces side by side, or with the model's own space mark, are cut word by word.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resultmart.llm.common import documents, parts_of, pick, release
from resultmart.llm.tokens import TAIL, Pieces, joined, split_at

#: Words of a generation that a task remembers.
CACHE = 200_000
#: Pairs of tokens whose test a task remembers.
PAIRS = 1_000_000
#: Text that is encoded at once.
TEXT_BYTES = 4_000_000
#: Fixed value: how the model spells a space.
MARK = "▁"
#: The words of a text: before each of them stands no mark.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: An unknown character in the table: compatible with all others.
UNKNOWN = -1


class _Tests(dict):
    """Tests of pairs (a << 20 | b), each made when first asked for; at most ``PAIRS`` are remembered."""

    def __init__(self, test) -> None:
        super().__init__()
        self.test = test

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[key] = found = self.test(key >> 20, key & 0xFFFFF)
        return found


class SentencePiece:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        held = SentencePieceProcessor(model_file=path)
        n = held.get_piece_size()
        self.names = [held.id_to_piece(i) for i in range(n)]
        self.bytes = {int(x[3:5], 16): i for i, x in enumerate(self.names) if held.is_byte(i)}
        self.byte_ids = frozenset(self.bytes.values())
        self.control = frozenset(i for i in range(n) if held.is_control(i))
        self.unknown = held.unk_id()
        others = self.byte_ids | self.control | {self.unknown}
        plain = {x: i for i, x in enumerate(self.names) if i not in others}
        if len(self.bytes) != 256 or any(MARK in x.lstrip(MARK) or any(c not in plain for c in x) or held.is_unused(i) for x, i in plain.items()):
            raise ValueError(f"{path} isn't a model with bytes for unknown characters, spaces at the start of pieces, and all characters as pieces")
        if held.encode("a  b") != held.encode(" a  b")[1:] and held.decode(held.encode("  a  b ")) != "  a  b ":
            raise ValueError(f"{path} changes white space")
        scores = sorted({held.get_score(i) for i in plain.values()}, reverse=True)
        order = {x: k for k, x in enumerate(scores)}
        self.plain, self.rank = plain, [0] * n
        for i in plain.values():
            self.rank[i] = order[held.get_score(i)]
        self.halves: list[tuple[int, int] | None] = [None] * n
        self.known = _Tests(self._compatible)
        automaton = ahocorasick.Automaton()
        for x, i in sorted(plain.items(), key=lambda e: (len(e[0]) > 1, self.rank[e[1]], len(e[0]))):
            if len(x) > 1:
                self.halves[i] = self._last_merge(x, self.rank[i])
            if len(x) == 1 or self.halves[i]:
                automaton.add_word(x, (len(x), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        #: What stands before punctuation in a piece; the empty word isn't apart from it either.
        self.joining = {"", "\n", MARK} | {a for x in plain for a, b in itertools.pairwise(x) if b in TAIL and a not in TAIL}
        self.forget()
        out = [b"" if i in self.control else x.replace(MARK, " ").encode() for i, x in enumerate(self.names)]
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        self.token_bytes = list(out)  # what each token covers in a text
        out[self.unknown] = " ⁇ ".encode()
        self.table = pa.array(out, pa.binary())

    def _last_merge(self, x: str, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives the piece when its text is encoded; None for one that is never made."""
        for k in range(1, len(x)):
            a, b = self.plain.get(x[:k]), self.plain.get(x[k:])
            if a is not None and b is not None and all(len(y) == 1 or self.halves[i] for y, i in ((x[:k], a), (x[k:], b))) and self._compatible(a, b, rank):
                return a, b
        return None

    def _compatible(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether merges of a rank below ``limit`` leave the two tokens apart."""
        names, rank, halves, plain = self.names, self.rank, self.halves, self.plain
        while True:
            both = plain.get(names[a] + names[b])
            if both is not None and rank[both] < limit:
                return False
            x, y = halves[a], halves[b]
            if x and (not y or rank[a] > rank[b]):
                limit, a = rank[a], x[1]  # the left one's merge comes before a border merge of the same rank
            elif y:
                limit, b = rank[b] + 1, y[0]
            else:
                return True

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: the last token of each prefix, UNKNOWN where that is a character without a piece."""
        last = [UNKNOWN] * (len(text) + 1)
        compatible = self.known.__getitem__
        filled = 0
        for end, (size, token) in self.matches(text):
            if end < filled:
                continue
            before = last[end + 1 - size]
            if before < 0 or compatible(before << 20 | token):
                last[end + 1] = token
                filled = end + 1
        return last

    def ids(self, text: str) -> list[int]:
        """The ids of a text in the model's spelling, read backwards from its prefix table."""
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token == UNKNOWN:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(token)
                at -= len(self.names[token])
        out.reverse()
        return out

    def word(self, text: str) -> bytes:
        """The ids of a text in the model's spelling."""
        found = self.words.get(text)
        if found is None:
            found = self.words[text] = self.old.get(text) or array("i", self.ids(text)).tobytes()
        return found

    def _piece(self, x: str) -> bytes | None:
        """The ids of what stands between two spaces, or behind a line feed; None where its text has to be cut word by word."""
        if not x or x[-1] == MARK:
            return None
        if x[0] == "\n":
            return array("i", self.ids(x[:1]) + self.ids(x[1:])).tobytes()
        return array("i", self.ids(MARK + x)).tobytes()

    def _known(self, names: list[str]) -> list[bytes | None]:
        """The ids of pieces, those that aren't remembered encoded anew."""
        known, old = self.pieces, self.old_pieces
        found = list(map(known.get, names))
        for i, ids in enumerate(found):
            if ids is None:
                x = names[i]
                found[i] = known[x] = old.get(x) or self._piece(x)
        return found

    def _pieces(self, names: pa.Array) -> pa.Array:
        """The ids of distinct pieces: those of the word and of the punctuation behind it where no model piece holds both."""
        cores = pc.ascii_rtrim(names, characters=TAIL)
        held = cores.dictionary_encode()
        words = held.dictionary.to_pylist()
        whole = np.array([x[-1:] in self.joining for x in words], bool)[held.indices.to_numpy()]
        n = (pc.binary_length(names).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)
        tails: dict[str, int] = {"": 0}
        tail = np.zeros(len(names), np.int64)
        some = np.flatnonzero((n > 0) & ~whole)
        for i, x, k in zip(some, names.take(pa.array(some)).to_pylist(), n[some].tolist(), strict=True):
            tail[i] = tails.setdefault(x[-k:], len(tails))
        ids = pa.array(self._known(words), pa.binary()).take(held.indices)
        behind = pa.array([self.word(x) if x else b"" for x in tails], pa.binary()).take(pa.array(tail))
        out = pc.binary_join_element_wise(ids, behind, pa.scalar(b"", pa.binary()))
        if whole.any():
            mask = pa.array(whole)
            out = pc.replace_with_mask(out, mask, pa.array(self._known(names.filter(mask).to_pylist()), pa.binary()))
        return out

    def whole(self, text: str) -> np.ndarray:
        """The ids of any text, cut word by word."""
        spelt = MARK + text.replace(" ", MARK) if text else ""
        return np.frombuffer(b"".join(map(self.word, WORDS.findall(spelt))), "<i4")

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's end. Null is empty."""
        if len(self.words) + len(self.pieces) >= CACHE:
            self.old, self.words, self.old_pieces, self.pieces = self.words, {}, self.pieces, {}
        texts = pc.fill_null(texts, "")
        split = Pieces(pc.replace_substring(texts, "\n", " \n"))
        ids = self._pieces(split.names)
        flat, ends = split.gathered(ids, np.dtype("<i4"))
        if not ids.null_count:
            return flat, ends
        rows = np.unique(np.searchsorted(split.at, np.flatnonzero(ids.is_null().to_numpy(False)[split.index]), "right") - 1)
        parts = split_at(flat, ends)
        for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True):
            parts[i] = self.whole(text)
        return joined(parts, np.dtype("<i4"))

    def forget(self) -> None:
        """At the end of a task: the memory is another task's."""
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.old_pieces: dict[str, bytes | None] = {}
        self.known.clear()

    def _first(self, ids: np.ndarray) -> int:
        """1 if the text of the ids starts with the space that encoding puts before every text."""
        for i in ids:
            if i not in self.control:
                return int(i not in self.byte_ids and i != self.unknown and self.names[i].startswith(MARK))
        return 0

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that stand end to end. A byte that is in no character becomes U+FFFD."""
        strings = self.table.take(pa.array(ids))
        places = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1) if len(strings) else np.zeros(1, np.int32)
        raw = memoryview(strings.buffers()[2] or b"")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        controls = np.flatnonzero(np.isin(ids, list(self.control)))
        broken = set((np.searchsorted(ends, controls, "right")).tolist())
        out = []
        for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            text = bytes(raw[places[a] + self._first(ids[a:z]) : places[z]])
            if i in broken:  # bytes on two sides of a control token are no character
                at = [places[a], *places[controls[(controls >= a) & (controls < z)]], places[z]]
                out.append("".join(_lenient(bytes(raw[x:y])) for x, y in itertools.pairwise(at))[self._first(ids[a:z]) :])
                continue
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(_lenient(text))
        return pa.array(out, pa.string())


def _lenient(raw: bytes) -> str:
    """Text of bytes, each of which becomes U+FFFD if no character holds it."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


@functools.lru_cache(2)
def sentence_piece(path: str) -> SentencePiece:
    return SentencePiece(path)


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sentence_piece(model)
        for rows in parts_of(batches, TEXT_BYTES):
            flat, ends = pieces.flat(rows.column(1))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], names=["doc_id", "ids"])
        pieces.forget()
        release()

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sentence_piece(model)
        for b in batches:
            at = b.column(1).offsets.to_numpy().astype(np.int64)
            i = 0
            while i < b.num_rows:  # slices of about a million ids
                z = max(i + 1, int(np.searchsorted(at, at[i] + 1_000_000, "right")) - 1)
                part = b.slice(i, z - i)
                texts = pieces.decoded(b.column(1).values.slice(at[i], at[z] - at[i]).to_numpy(), at[i + 1 : z + 1] - at[i])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "text"])
                i = z
        release()

    return run


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the library gives them without begin and end; one row per input row.

    Null and empty texts have no ids. A null doc_id stays null, repeated rows repeat, an empty table stays empty, and
    other columns are dropped. Strings of special tokens are ordinary text.
    """
    return documents(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode_pieces(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text, as the library decodes: without the space that encoding put first. Null ids are no ids."""
    rows = pick(tokens, doc_id=(id_col, "long"), ids=(ids_col, "array<int>")).withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.mapInArrow(_decode(model), "doc_id long, ids array<int>, text string")
