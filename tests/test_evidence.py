"""Verification, de-duplication and selection against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.functions import parsing
from corpusloom.operators import evidence as E


def test_drop_reasons(spark):
    source = "The first line must stay. The second one."
    rows = [(1, "The first line must stay."), (2, '"The first line must stay."'), (3, ""), (4, "x" * 700), (5, "Title: x"), (6, "not there at all in it"), (7, "not there at all in it"), (8, None)]
    df = spark.createDataFrame([("f", i, t, source) for i, t in rows], "file string, ord int, text string, source string")
    got = {r.ord: r.drop_reason for r in E.drop_reasons(df, "source", ["file"], "ord").collect()}
    assert got == {1: None, 2: "duplicate", 3: "unverified", 4: "too_long", 5: "low_signal", 6: "unverified", 7: "unverified", 8: "unverified"}


def brute_diverse(rows, wanted, distance=20):
    """(score, char_start, line, text) rows."""
    ranked = sorted(rows, key=lambda r: (-r[0], r[1]))
    got = []
    for r in ranked:
        if len(got) < wanted and all(abs(r[2] - g[2]) > distance for g in got):
            got.append(r)
    for r in ranked:
        if len(got) < wanted and r[3] not in {g[3] for g in got}:
            got.append(r)
    return [(r[0], r[2]) for r in got]


def test_diverse(spark):
    rng = random.Random(5)
    docs = {d: [(rng.randrange(6), i * 10, rng.randrange(120), f"t{rng.randrange(12)}") for i in range(rng.randrange(1, 30))] for d in range(25)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "doc int, score int, char_start int, line_no int, text string")
    got: dict[int, list] = {}
    for r in E.select_diverse(df, ["doc"], 5).orderBy("doc", "position").collect():
        got.setdefault(r.doc, []).append((r.score, r.line_no))
    assert got == {d: brute_diverse(rows, 5) for d, rows in docs.items()}


def test_round_robin(spark):
    rows = [("a", 9, "a1"), ("a", 8, "a2"), ("a", 7, "a3"), ("b", 8, "b1"), ("c", 1, "c1"), ("c", 1, "c2")]
    df = spark.createDataFrame([(p, s, i, i, t) for i, (p, s, t) in enumerate(rows)], "input_path string, score int, start_line int, char_start int, text string")
    got = [r.text for r in E.round_robin(df, E.order_of(), 2, 10).orderBy("position").collect()]
    assert got == ["a1", "b1", "c1", "a2", "c2"]
    assert E.round_robin(df, E.order_of(), 0, 10).count() == 0
    assert [r.text for r in E.round_robin(df, E.order_of(), 1, 2).orderBy("position").collect()] == ["a1", "b1"]


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("p", 1, 1, 0, "Same text."), ("p", 5, 2, 0, "same  TEXT"), ("q", 5, 1, 0, "(same text)"), ("q", 9, 9, 9, "...")], "input_path string, score int, start_line int, char_start int, text string")
    assert [r.text for r in E.dedupe(df, E.order_of()).collect()] == ["same  TEXT"]


def test_merge_items(spark):
    rows = [
        ("f", "k", 1, "claim", "first", "chunk_only", 0.5, "s1"), ("f", "k", 2, "claim", "second", "snippet_verified", 0.9, "s2"), ("f", "k", 3, "claim", "third", "snippet_verified", 0.8, "s1"),
        *[("f", "k", 10 + i, "claim", "x", "chunk_only", 0.1, f"t{i}") for i in range(9)], (None, "k", 1, "fact", "other", "chunk_only", 0.4, None),
    ]
    df = spark.createDataFrame(rows, "file string, item_key string, ord int, kind string, text string, source_support string, rank_score double, s string").withColumn("source", F.struct("s"))
    got = {r.file: r for r in E.merge_items(df, ["file"], 5).collect()}
    assert got["f"].text == "second" and got["f"].rank_score == 0.9 and got["f"].ord == 1
    assert [x.s for x in got["f"].sources] == ["s1", "s2", "t0", "t1", "t2", "t3"]
    assert got[None].text == "other" and got[None].rank_in_group == 1


def test_numbered(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(977)).alias("x"), "id")
    rows = sorted((r.x, r.id, r.n) for r in E.numbered(df, F.col("x"), F.col("id"), name="n").collect())
    assert [r[2] for r in rows] == list(range(1, 1001))
    assert E.numbered(df.limit(0), F.col("x"), name="n").count() == 0


def test_tagged_lines(spark):
    raw = "CLAIM | A claim | A claim\nTASK | do it\nENTITY | Tool Kit | Hammer | a=1; b=2 | Hammer\nENTITY | x\nLINK | https://a.b | | \nNOPE | x\nno pipe here\n- FACT | y\nFACT | \n\nQUESTION | why? | A  claim"
    df = spark.createDataFrame([("d", raw, "A claim about a Hammer")], "id string, raw string, src string")
    rows = parsing.tagged_lines(df, "raw", source="src").orderBy("line_no").collect()
    got = [(r.kind, r.problem, r.text, r.source_support, r.char_start) for r in rows]
    assert got == [
        ("claim", None, "A claim", "snippet_verified", 0), ("task", "unsupported_type", "do it", "chunk_only", None), ("entity", None, "Hammer", "snippet_verified", 16), ("entity", "invalid", "", "chunk_only", None),
        ("link", None, "https://a.b", "chunk_only", None), ("nope", "invalid", "x", "chunk_only", None), ("_ fact", "invalid", "y", "chunk_only", None), ("fact", "invalid", "", "chunk_only", None), ("question", None, "why?", "snippet_verified", 0),
    ]
    assert rows[2].entity_type == "tool_kit" and rows[2].attributes == {"a": "1", "b": "2"}


def test_summary(spark):
    raws = [
        '```json\n{"title": "T", "abstract": "a", "bullets": ["x", "y"], "open_questions": [], "confidence": "HIGH"}\n```',
        "Before\nTITLE: My title\nABSTRACT: one\ntwo\nKEY POINTS:\n- a\n2. b\n- none\nOPEN QUESTIONS:\n- None\nCONFIDENCE: low risk",
        "Just text\n- one\n* two\n3) three\nrest",
        "{broken",
        "",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r.s for r in parsing.with_summary(df, "raw", "s").orderBy("i").collect()]
    assert [g.structured_valid for g in got] == [True, True, False, False, False]
    assert (got[0].payload.title, got[0].payload.bullets, got[0].payload.confidence) == ("T", ["x", "y"], "high")
    assert (got[1].payload.title, got[1].payload.abstract, got[1].payload.bullets, got[1].payload.open_questions, got[1].payload.confidence) == ("My title", "one two", ["a", "b"], [], "low")
    assert (got[2].payload.title, got[2].payload.abstract, got[2].payload.bullets) == ("Untitled", "Just text", ["one", "two", "three"])


def test_snippet_candidates(spark):
    lines = ["TEXT: one", "goes on", "REASON: because", "TEXT: none", "- TEXT: 'two'", "", "REASON: r2", "stray"]
    df = spark.createDataFrame([(lines,), ([],)], "l array<string>")
    got = [[(c.text, c.reason) for c in r[0]] for r in df.select(parsing.snippet_candidates(F.col("l"))).collect()]
    assert got == [[("one goes on", "because"), ("two", "r2")], []]
