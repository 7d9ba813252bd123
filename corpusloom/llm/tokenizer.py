"""Problem 5: token ids of whole texts by a public byte-level BPE vocabulary.

The merge list is compiled into a deterministic automaton over tokens by successive merge gadgets.
Before any merge the automaton has one state with an arc to itself for each byte.  The gadget of a
merge (u, v) -> w splits the state q behind the arcs labelled u: those arcs now lead to a copy of q
without the arc v, and every state that had the arc u gets an arc w to the place where v led.  A
path of arcs is then exactly a tokenization that the merge rules produce.  A state is kept as the
token that leads to it; its arcs are entered in a transition table the first time they are asked
for, from the gadgets that touched them, so the table holds only what the corpus uses.

A pre-split word is encoded by table look-ups over its byte positions: each prefix has exactly one
path, so the last arc of a prefix is the one token that the table allows after the path before it.
Decoding emits the labels (bytes) of the arcs.

Python workers cache the ids of each space-delimited piece of text, so a piece that occurs again
costs one dictionary look-up.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per Python worker before the cache starts afresh (memory bound; no effect on results).
CACHE_PIECES = 400_000
DEFAULT_VOCABULARY = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
BPE_50K = "byte_bpe_50k.json"

#: The public pre-splitting pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, as symbol -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic automaton over the tokens of a merge list; see the module's text."""

    def __init__(self, label: list[bytes], left: list[int], right: list[int], time: list[int]):
        # Of each token: its bytes, its two parts (-1 for a byte) and the number of its merge (-1 for a byte).
        self.label, self.left, self.right, self.time = label, left, right, time
        self.gadget = {(left[t], right[t]): time[t] for t in range(len(label)) if time[t] >= 0}
        self.token = {b: t for t, b in enumerate(label)}
        self.longest = max(map(len, label))
        self.prefixes = {b[:i] for b in label for i in range(1, len(b) + 1)}
        self.arcs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_symbols()
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        label, left, right, time = [b""] * size, [-1] * size, [-1] * size, [-1] * size
        for symbol in byte:
            label[vocab[symbol]] = bytes([byte[symbol]])
        for n, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            w = vocab[u + v]
            left[w], right[w], time[w] = vocab[u], vocab[v], n
            label[w] = label[vocab[u]] + label[vocab[v]]
        return cls(label, left, right, time)

    def removed(self, x: int, t: int, until: int) -> bool:
        """Whether the gadgets before the merge number `until` left the state behind x without an arc t."""
        while True:
            at = self.gadget.get((x, t))
            if at is not None and at < until:
                return True  # the gadget of x + t itself
            if self.time[x] > self.time[t]:
                x, until = self.right[x], self.time[x]  # x's gadget led its arc to the state behind its right part
            elif self.time[t] >= 0:
                t, until = self.left[t], self.time[t] + 1  # t's gadget gave an arc only to states with its left part
            else:
                return False

    def allows(self, x: int, t: int) -> bool:
        """The transition table: may token t follow token x?"""
        key = (x, t)
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = not self.removed(x, t, len(self.label))
        return known

    def inner(self, t: int) -> bool:
        """Whether t is what its own bytes are merged to: its parts may not stand side by side otherwise."""
        return self.time[t] < 0 or (
            not self.removed(self.left[t], self.right[t], self.time[t]) and self.inner(self.left[t]) and self.inner(self.right[t])
        )

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n = len(word)
        whole = self.token.get(word)
        if whole is not None and self.inner(whole):
            return [whole]
        last: list[int] = [-2] * (n + 1)  # of each prefix, the last arc of its path; -2: not known
        last[0] = -1
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = word[i:j]
                if part not in self.prefixes:
                    break
                t = self.token.get(part)
                if t is not None:
                    ends[j].append((i, t))
            if i + 1 <= n:
                for at, t in ends[i + 1]:
                    before = last[at]
                    if self.inner(t) and (before == -1 or self.allows(before, t)):
                        last[i + 1] = t
                        break
        ids = []
        while n:
            ids.append(last[n])
            n -= len(self.label[last[n]])
        return ids[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.label[i] for i in ids)


class Encoder(dict):
    """Piece of text, without the space before it -> packed int32 ids of it and that space.  None: an empty piece, or white
    space at an end of it."""

    def __init__(self, automaton: MergeAutomaton):
        import regex

        super().__init__()
        self.automaton, self.split, self.words = automaton, regex.compile(WORD_PATTERN).findall, {}

    def of_words(self, text: str) -> bytes:
        out = []
        for word in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) > CACHE_PIECES:
                    self.words.clear()
                    self.automaton.arcs.clear()
                ids = self.words[word] = np.array(
                    self.automaton.encode_word(word.encode("utf-8", "replace")), np.int32
                ).tobytes()
            out.append(ids)
        return b"".join(out)

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) > CACHE_PIECES:
            self.clear()
        odd = not piece or piece[0].isspace() or piece[-1].isspace()
        value = self[piece] = None if odd else self.of_words(" " + piece)
        return value

    def ids(self, text: str | None) -> bytes:
        """Packed ids of a whole text.  Splitting at a single space between two other characters is exact: the pattern
        gives such a space to what follows it, whatever lies before."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if first and not first[-1].isspace():
                return self.of_words(first) + b"".join(map(self.__getitem__, rest))
        except TypeError:
            pass  # None: an odd space somewhere
        out, held = [], first
        for i, piece in enumerate(rest):
            if self[piece] is not None and held[-1:] and not held[-1].isspace():
                out.append(held)
                held = piece
            else:
                held += " " + piece
        return self.joined(out, held)

    def joined(self, pieces: list[str], last: str) -> bytes:
        """Packed ids of pieces that followed each other with one space between."""
        first, *rest = [*pieces, last]
        return self.of_words(first) + b"".join([self[p] or self.of_words(" " + p) for p in rest])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(MergeAutomaton.from_file(path))
    return _ENCODERS[path]


def vocabulary_path(name: str = BPE_50K, folder: str = DEFAULT_VOCABULARY) -> str:
    return os.path.join(folder, name)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row of df.

    A null text and an empty text have an empty list.  Text that looks like a special token is ordinary text.  Repeated
    rows give repeated results; other columns of df, whatever their names, are not read.  An empty table gives no rows.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            packed = [enc.ids(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def sizes(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens int) for every row of df; 0 for a null or an empty text."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = np.fromiter((len(enc.ids(t)) // 4 for t in batch.column(1).to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], [key, "n_tokens"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, n_tokens int")


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text string) from lists of ids, by emitting the labels of the arcs; null lists give a null text."""
    path = path or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = encoder(path).automaton
        for batch in batches:
            texts = [None if x is None else automaton.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"{key} {kind}, text string")
