"""Token ids against the public library; packing by its invariants and against an exact small case."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing
from corpusloom.llm import tokenizer as tok

pytestmark = pytest.mark.skipif(not os.path.exists(tok.vocabulary_path()), reason="no vocabulary files")
ODD = ["", " ", "  ", "a  b", " x", "x ", "a\x1cb \x1c c", "x\n \ny", "don't 's I'LL 've", "<|endoftext|> hi", "½ ² ٣ 𝔘 𠀀 👩‍🔧", "a" * 500, "\r\n\r\n x", "a b", "é ́", "ab\x85cd \x85", "Hello, world! 12345 foo_bar", "\t\t if x:\n    return", "    ", "\u3000 \u2028x"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.vocabulary_path())
    t.encode_special_tokens = True
    return t


def unpack(b: bytes) -> list[int]:
    return np.frombuffer(b, np.int32).tolist()


def test_odd_texts_match_the_library():
    enc, lib = tok.encoder(tok.vocabulary_path()), library()
    for t in ODD:
        assert unpack(enc.ids(t)) == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert enc.automaton.decode(unpack(enc.ids(t))).decode() == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta'bcdeE1.,"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_matches_the_library(text):
    assert unpack(tok.encoder(tok.vocabulary_path()).ids(text)) == library_once().encode(text, add_special_tokens=False).ids


_LIB: list = []


def library_once():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def test_automaton_of_a_small_merge_list():
    # Bytes a, b; merges a+a, aa+b, b+b: checked against merging step by step.
    label = [b"a", b"b", b"aa", b"aab", b"bb"]
    auto = tok.MergeAutomaton(label, [-1, -1, 0, 2, 1], [-1, -1, 0, 1, 1], [-1, -1, 0, 1, 2])

    def merged(word: bytes) -> list[bytes]:
        parts = [bytes([c]) for c in word]
        for u, v in ((b"a", b"a"), (b"aa", b"b"), (b"b", b"b")):
            i = 0
            while i + 1 < len(parts):
                if parts[i] == u and parts[i + 1] == v:
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    from itertools import product

    for n in range(1, 9):
        for w in product(b"ab", repeat=n):
            word = bytes(w)
            assert [label[t] for t in auto.encode_word(word)] == merged(word), word


def test_encode_rows(spark):
    rows = [(1, "a b"), (2, ""), (3, None), (4, "a b"), (4, "a b"), (5, "x " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "'z' as n_tokens")
    got = sorted((r.doc_id, len(r.ids)) for r in tok.encode(df).collect())
    lib = library_once()
    assert got == sorted((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in tok.sizes(df).collect()) == got
    assert {r.doc_id: r.text for r in tok.decode(tok.encode(df)).collect()}[5] == "x " * 40_000
    assert tok.encode(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_place_keeps_the_capacity(sizes):
    where = packing.place(np.array(sizes, np.int64), 30)
    room = np.bincount(where, weights=sizes) if sizes else np.zeros(0)
    assert (room <= 30).all() and (room > 0).all()


def test_place_fills_perfect_bins():
    assert len(set(packing.place(np.array([6, 4] * 50), 10))) == 50


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5, 10, 25, 0, None, 3, 3, 7, 10, 1] * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").selectExpr("*", "1 as container_id", "'x' as _key", "2 as _size")
    out = packing.pack(df, [10, 50]).collect()
    for c in (10, 50):
        mine = [r for r in out if r.capacity_tokens == c]
        room: dict[int, int] = {}
        by_doc: dict[int, list] = {}
        for r in mine:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
            by_doc.setdefault(r.doc_id, []).append(r)
        assert max(room.values()) <= c
        for i, n in rows:
            got = sorted(by_doc.get(i, []), key=lambda r: r.piece_no)
            assert sum(r.n_tokens for r in got) == (n or 0)
            assert len(got) == (0 if not n else 1 if n <= c else -(-n // c))
            assert [r.token_start for r in got] == [c * k for k in range(len(got))]
        assert sum(n or 0 for _, n in rows) / (len(room) * c) > 0.95
    assert packing.pack(df.limit(0), [10]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [])
