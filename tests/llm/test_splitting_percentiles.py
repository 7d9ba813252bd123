"""Splitting by its invariants, percentiles against sorting."""

from __future__ import annotations

import math
import random

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import percentiles as P
from corpusloom.llm import splitting as S

PLANS = [(1, "chars", 20, 5, 4, 2, True), (2, "tokens", 20, 5, 4, 2, True), (3, "chars", 12, 9, 0, 0, False), (4, "tokens", 9, 3, 50, 50, True)]
PLAN_SCHEMA = "plan_id int, chunk_strategy string, chunk_chars int, chunk_tokens int, chunk_overlap_chars int, chunk_overlap_tokens int, preserve_heading_ancestry boolean"
CHUNKS = "chunk_key bigint, plan_id int, text string, heading_ancestry array<struct<level int, text string, line int>>, overlap_text string"
TEXTS = st.lists(st.sampled_from(["word ", "a", "End. ", "\n", "\n\n", "\r\n", "😀", "e\u0301", "、", "longerword", "\u00a0", "# Head\n", "```\n", "x" * 25, "\u2028", ", "]), max_size=30).map("".join)


def tokens(t: str) -> int:
    return len(regex.findall(r"\P{White_Space}+", t))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_pieces(spark, texts):
    plans = spark.createDataFrame(PLANS, PLAN_SCHEMA)
    rows = [(i * 10 + p[0], p[0], t, None, "before") for i, t in enumerate(texts) for p in PLANS]
    df = spark.createDataFrame(rows, CHUNKS)
    found = {r[0] for r in S.oversized(df, plans).collect()}
    pieces: dict[int, list] = {}
    for r in S.split_oversized(df, plans).collect():
        pieces.setdefault(r.chunk_key, []).append(r)
    for key, plan, text, _, _ in rows:
        _, kind, chars, toks, over_c, over_t, keeps = PLANS[plan - 1]
        limit, over, size = (chars, over_c, len) if kind == "chars" else (toks, over_t, tokens)
        over = min(over, limit - 1)
        got = sorted(pieces[key], key=lambda r: r.piece_index)
        assert (key in found) == (size(text) > limit) == (len(got) > 1)
        assert "".join(r.text for r in got) == text
        for a, b in zip(got, got[1:]):
            assert size(b.text) + size(b.overlap_text) <= limit and size(a.text) <= limit
            assert size(b.overlap_text) == min(over, size(a.text)) and a.text.endswith(b.overlap_text)
            assert b.char_start == a.char_start + len(a.text)
            if kind == "chars" and a.text[-1] == "e":
                assert b.text[:1] != "\u0301" or len(a.text) == 1
        assert keeps or all(r.heading_ancestry == [] for r in got)


def test_boundaries_headings_and_edges(spark):
    plans = spark.createDataFrame([(1, "chars", 60, 9, 10, 2, True)], PLAN_SCHEMA)
    text = "# One\n\nSome words here that go on.\n\n## Two\n\nMore words here that go on and on.\n\n```\n# no heading\n```\n# Three\n\nLast words of all."
    rows = [(1, 1, text, [(1, "Zero", 3)], "old"), (2, 1, None, None, None), (3, 1, "", [], ""), (4, 1, " \n ", None, None), (5, 9, "x" * 100, None, None), (6, None, "y", None, None), (7, 1, "z" * 60, None, None), (7, 1, "z" * 60, None, None), (8, 1, "z" * 61, None, None)]
    df = spark.createDataFrame(rows, CHUNKS).selectExpr("*", "1 as chars", "2 as _limit", "3 as piece_index")
    out = S.split_oversized(df, plans).collect()
    one = sorted((r for r in out if r.chunk_key == 1), key=lambda r: r.piece_index)
    assert all(r.text.endswith("\n") for r in one[:-1])
    assert one[0].overlap_text == "old" and one[0].overlap_source == "previous" and [h.text for h in one[0].heading_ancestry] == ["Zero"]
    for r in one[1:]:
        want = ["Three"] if r.char_start >= text.index("# Three") else ["One", "Two"] if r.char_start >= text.index("## Two") else ["One"]
        assert [h.text for h in r.heading_ancestry] == want
    single = {r.chunk_key: r for r in out if r.chunk_key in (2, 3, 4, 5, 6)}
    assert len(single) == 5 and all(r.piece_total == 1 for r in single.values()) and single[2].text is None
    assert sum(r.chunk_key == 7 for r in out) == 2
    assert [r[0] for r in S.oversized(df, plans).orderBy("chunk_key").collect()] == [1, 8]
    assert S.split_oversized(df.limit(0), plans).count() == 0


def test_very_long_texts(spark):
    plans = spark.createDataFrame([(1, "chars", 20_000, 9, 100, 2, True), (2, "tokens", 9, 5_000, 1, 100, True)], PLAN_SCHEMA)
    mixed = "😀a" * 60_000  # widths that change at every character
    df = spark.createDataFrame([(1, 1, mixed, None, None), (2, 2, "ab " * 60_000, None, None), (3, 1, "q" * 300_000, None, None)], CHUNKS)
    out: dict[int, list] = {}
    for r in S.split_oversized(df, plans).collect():
        out.setdefault(r.chunk_key, []).append(r)
    for key, text in ((1, mixed), (2, "ab " * 60_000), (3, "q" * 300_000)):
        assert "".join(r.text for r in sorted(out[key], key=lambda r: r.piece_index)) == text and len(out[key]) > 5


def exact(values: list, p: float):
    return sorted(values)[max(1, math.ceil(len(values) * p)) - 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_radix_select(spark, seed):
    rng = random.Random(seed)
    make = [lambda: rng.randrange(-5, 300), lambda: int(rng.lognormvariate(9, 3)), lambda: -int(rng.lognormvariate(12, 2)), lambda: rng.choice([0, 2**62, -(2**62), 2**63 - 1, -(2**63) + 1, 7]), lambda: 1234567]
    rows = [(g, rng.choice(["x", None]), make[g % 5]() if rng.random() > 0.1 else None, rng.randrange(10)) for g in range(7) for _ in range(rng.randrange(1, 400))]
    rows += [(8, "x", 5, None)]
    df = spark.createDataFrame(rows, "g int, h string, v bigint, w bigint").selectExpr("*", "'c' as p", "1 as _key", "2 as n", "3 as measure")
    got = {(r.g, r.h, r.measure, r.p): (r.n, r.value) for r in P.radix_select(df, ["g", "h"], ["v", "w"]).collect()}
    want = {}
    for g, h in {(r[0], r[1]) for r in rows}:
        for m, i in (("v", 2), ("w", 3)):
            vals = [r[i] for r in rows if (r[0], r[1]) == (g, h) and r[i] is not None]
            for p in P.PROBABILITIES if vals else ():
                want[(g, h, m, p)] = (len(vals), exact(vals, p))
    assert got == want
    s = P.summary(df, ["g", "h"], ["v", "w"])
    for r in P.from_summary(s, ["g", "h"]).collect():
        value = want[(r.g, r.h, r.measure, r.p)][1]
        assert r.low <= value <= r.high and abs(r.estimate - value) <= abs(value) / 2**P.LEADING + 1


def test_summaries_add_up(spark):
    df = spark.range(5000).select(F.pmod("id", F.lit(3)).alias("day"), (F.col("id") * 37 % 1009).alias("v"))
    whole = P.summary(df, [], ["v"])
    parts = P.merge(P.summary(df, ["day"], ["v"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_floating_values(spark):
    rng = random.Random(4)
    vals = [rng.gauss(0, 1) * 10 ** rng.randrange(-5, 9) for _ in range(500)] + [0.0, -0.0, 1e300, -1e300]
    df = spark.createDataFrame([("g", v) for v in vals] + [("g", None)], "g string, x double")
    assert {r.p: r.value for r in P.radix_select(df, ["g"], ["x"]).collect()} == {p: exact(vals, p) for p in P.PROBABILITIES}
    assert P.radix_select(df.limit(0), ["g"], ["x"]).count() == 0
