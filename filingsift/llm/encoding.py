"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: prefix dynamic programming. Every prefix of a byte string has one valid encoding, hence one valid last token, and
a token may stand last exactly if it may follow the last token of the prefix before it. Storing the last token of each
prefix gives the encoding by walking back, an exact append by going on from the stored prefixes, and re-encoding near an
edit from the last prefix before it. The tokenizer's split pattern cuts texts into pieces first; pieces are encoded once
per worker and looked up afterwards.

The encoding of a document needs nothing of another: one narrow ``mapInArrow`` over the scan, without a shuffle.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer files lie; every function takes another path. A worker that has no such path takes the file of
#: that name which the session shipped (``SparkContext.addFile``).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Encodings of distinct pieces, and pairs of tokens with whether one may follow the other, that a worker keeps; beyond it the
#: memory is emptied, which changes no result.
KEPT_PIECES, KEPT_PAIRS = 1_000_000, 2_000_000

# The tokenizer's published split pattern, with its white space spelled out; the second is the first for
# texts of ASCII characters only.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000, 45, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder(dict):
    """Piece -> its ids as packed 32-bit integers; a missing piece is encoded and kept."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        found = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))  # shipped by SparkContext.addFile
        with open(found, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocabulary = {s: i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.width: dict[int, int] = {i: len(s) for s, i in vocabulary.items()}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items()}
        self.made_at: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge_of: dict[tuple[int, int], int] = {}
        for when, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            both, whole = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.merge_of[both] = when
            self.made_at.setdefault(whole, when)
            self.halves.setdefault(whole, both)
        self.finder = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.halves:  # special tokens are made of nothing and stay out
                self.finder.add_word(b.decode("latin-1"), i)
        self.finder.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII, re.ASCII)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that touch its edge (0: left, 1: right), each with the time at which it is absorbed."""
        edge, until = [(token, float("inf"))], float("inf")
        while token in self.halves:
            until, token = self.made_at[token], self.halves[token][side]
            edge.append((token, until))
        return edge

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the border between them: no merge across it is due while both of its
        sides exist. Among equal merges the leftmost goes first, so one inside ``left`` precedes one across."""
        known = self.follows.get((left, right))
        if known is None:
            known = True
            if len(self.follows) >= KEPT_PAIRS:
                self.follows.clear()
            for a, a_until in self._edge(left, 1):
                for b, b_until in self._edge(right, 0):
                    when = self.merge_of.get((a, b))
                    if when is not None and when < a_until and when <= b_until and when > self.made_at.get(a, -1) and when > self.made_at.get(b, -1):
                        known = False
            self.follows[left, right] = known
        return known

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """``last[i]``: the last token of the encoding of ``data[:i + 1]``; goes on from the prefixes already in it."""
        known = len(last)
        last = last + [-1] * (len(data) - known)
        for end, token in self.finder.iter(data.decode("latin-1")):
            if end >= known and last[end] < 0:
                start = end + 1 - self.width[token]
                if not start or self.may_follow(last[start - 1], token):
                    last[end] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= self.width[ids[-1]]
        return ids[::-1]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        packed = array("i", self.walk(self.extend([], piece.encode("utf-8", "replace")))).tobytes()
        self[piece] = packed
        return packed

    def pieces(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each; null and empty texts have none."""
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.packed(text)))


class EncodedText:
    """A text with the last token of each prefix of each of its pieces: appends and edits re-encode what they touch."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces, self.lasts = encoder, [], []
        self.redone = 0
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        return [i for last in self.lasts for i in self.encoder.walk(last)]

    def append(self, text: str) -> None:
        """Only the last two pieces can grow or be cut by what follows them (an apostrophe and the letters after it may
        become one piece); the stored prefixes of a piece that begins as before stay valid."""
        old = [(self.pieces.pop(), self.lasts.pop()) for _ in range(min(2, len(self.pieces)))][::-1]
        tail = "".join(p for p, _ in old)
        for k, piece in enumerate(self.encoder.split.findall(tail + text)):
            data, known = piece.encode("utf-8", "replace"), []
            if k < len(old) and [p for p, _ in old[:k]] == self.pieces[len(self.pieces) - k :] and piece.startswith(old[k][0]):
                known = old[k][1]
            self.redone += len(data) - len(known)
            self.pieces.append(piece)
            self.lasts.append(self.encoder.extend(known, data))

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters [start, end): pieces before it stay; splitting goes on until it meets an old border."""
        bounds = [0]
        for p in self.pieces:
            bounds.append(bounds[-1] + len(p))
        first = max(0, next((k for k, b in enumerate(bounds) if b >= start), len(bounds)) - 1)
        first = max(0, first - 1)
        whole = self.text
        rest = whole[bounds[first] : start] + text + whole[end:]
        shift = len(text) - (end - start)
        old = {b + shift: k for k, b in enumerate(bounds) if b >= end}
        at, pieces, lasts, kept = bounds[first], [], [], len(self.pieces)
        for m in self.encoder.split.finditer(rest):
            if at >= start + len(text) and at in old:
                kept = old[at]
                break
            data = m.group().encode("utf-8", "replace")
            self.redone += len(data)
            pieces.append(m.group())
            lasts.append(self.encoder.extend([], data))
            at += len(m.group())
        self.pieces[first:] = pieces + self.pieces[kept:]
        self.lasts[first:] = lasts + self.lasts[kept:]


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encoded(documents: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): one row per input row, without special tokens; a string that spells one is ordinary text. Null and
    empty texts give an empty list, whatever other columns there are."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [own.packed(t) for t in part.column(1).to_pylist()]
                offsets = array("i", [0])
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())]), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY, text: str = "text", size: str = "tokens") -> DataFrame:
    """The input's other columns with ``size``, the number of tokens of ``text`` (0 for null and empty texts)."""
    rest = [c for c in documents.columns if c not in (text, size)]
    docs = documents.select(text, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n = [len(own.packed(t)) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*rest, size])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}{', ' if rest else ''}`{size}` long")
