"""Text functions against plain Python, on odd inputs."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ODD = ["", " ", " x ", "﻿text", "a\r\nb\rc", "İ ı ẞ", "😀😀 x", "none", "N/A", "Title: x", "A - B", "see https://x.y", "**Rule:** keep 5%", "x" * 3000, "\x1c\x1d y \x85", None]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", expr(F.col("t")).alias("r")).orderBy("i").select("r").collect()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40), min_size=1, max_size=30))
def test_strip_is_python_strip(spark, values):
    assert column(spark, values, T.strip) == [v.strip() for v in values]


def test_strip_of_odd_texts(spark):
    assert column(spark, ODD, T.strip) == [None if v is None else v.strip() for v in ODD]


def test_slug(spark):
    got = column(spark, ["  Foo, Bar! ", "https://A.b/c", "___", "", None, "Ünï"], T.slug)
    assert got == ["foo-bar", "a-b-c", "", "", None, "n"]


def test_duplicate_key(spark):
    assert column(spark, ["  “A  b” .", "(A b)!", "...", None, ""], T.duplicate_key) == ["“a b”", "a b", "", None, ""]


def test_find_counts_code_points(spark):
    df = spark.createDataFrame([("😀ab😀ab", "ab"), ("abc", "x"), ("abc", ""), ("", "a"), (None, "a"), ("a", None)], "t string, p string")
    assert [r[0] for r in df.select(T.find(F.col("t"), F.col("p"))).collect()] == [1, None, None, None, None, None]


def test_line_of(spark):
    df = spark.createDataFrame([("a\nb\nc", 0), ("a\nb\nc", 2), ("a\nb\nc", 4), ("", 0)], "t string, at int")
    assert [r[0] for r in df.select(T.line_of(F.col("t"), F.col("at"))).collect()] == [1, 2, 3, 1]


def test_clip(spark):
    df = spark.createDataFrame([("x" * 10,), ("x" * 5 + "     tail",), ("",), (None,)], "t string")
    text, cut = T.clip(F.col("t"), 10)
    rows = df.select(text.alias("t"), cut.alias("c")).collect()
    assert rows[0].t == "x" * 10 and not rows[0].c
    assert rows[1].t == "xxxxx\n\n[Input truncated: first 10 of 14 characters.]" and rows[1].c
    assert rows[2].t == "" and rows[3].t is None


def test_score_by_hand(spark):
    texts = ["This must never fail because the limit is 5 tokens, and it shows the main step of it all.", "Title: nothing", "Never skip", "see more at http://x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = T.signals(F.col("t"))
    df = df.withColumn("s", shown)
    got = df.select(T.points(F.col("s"), F.length("t")), F.array_join(T.reasons(F.col("s"), F.length("t")), ",")).collect()
    assert got[0][1] == "useful_length,claim,limit,metric,operation,rule,thesis" and got[0][0] == 2 + 2 + 2 + 1 + 1 + 2 + 2 + 1
    assert got[1] == (-10, "low_signal")
    assert got[2] == (4, "rule")
    assert got[3] == (-10, "low_signal")


def test_globs():
    cases = [("*.md", "a/b.md", True), ("**/x", "x", True), ("**/x", "a/x", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("[ab]c", "bc", True), ("a.b", "axb", False), ("", "", True)]
    for pattern, path, want in cases:
        regex = T.glob_regex(pattern).replace(r"\z", r"\Z")
        assert bool(re.search(regex, path)) is want, (pattern, path)


def test_attributes(spark):
    got = column(spark, ["a=1; B c = x y ;bad;=z;d=", "a=1;a=2", "", None], T.attributes)
    assert got == [{"a": "1", "b_c": "x y"}, {"a": "2"}, {}, None]


def test_failure_codes_in_order(spark):
    messages = ["No such file", "Permission denied", "no usable text", "Timed out", "Connection refused", "model m not found", "context of JSON", "bad json", "odd", ""]
    want = ["input_missing", "input_unreadable", "input_empty", "model_timeout", "model_unavailable", "model_unavailable", "context_overflow", "model_output_invalid", "internal_error", "internal_error"]
    assert column(spark, messages, T.failure_code) == want


def test_elapsed_is_half_to_even(spark):
    df = spark.sql("select timestamp_micros(0) a, timestamp_micros(x) b from values (500L), (1500L), (2500L), (-5L), (null) t(x)")
    assert [r[0] for r in df.select(T.elapsed_ms(F.col("a"), F.col("b"))).collect()] == [0, 2, 2, 0, None]
