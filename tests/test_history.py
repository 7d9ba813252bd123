"""Rollups, comparisons, gauges, packages and contracts."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators import history as H
from corpusloom.operators import packaging as K
from corpusloom.plans import config, contracts


def test_run_states(spark):
    rows = [("ok", "complete", 0), ("warn", "complete", 2), ("warn", "complete", 0), ("part", "failed", 0), ("part", "complete", 0), ("bad", "failed", 0), (None, "odd", None)]
    df = spark.createDataFrame(rows, "run string, status string, warning_count int")
    got = {r.run: r.final_status for r in H.run_states(df, ["run"]).collect()}
    assert got == {"ok": "complete", "warn": "complete_with_warnings", "part": "partial", "bad": "failed", None: "complete"}
    counts = {r.run: (r.total, r.failed, r.complete) for r in H.state_counts(df, ["run"]).collect()}
    assert counts[None] == (1, 0, 0) and counts["part"] == (2, 1, 1)


def test_compare_with_null_keys_and_repeats(spark):
    a = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), (None, 1, 5), ("gone", 1, 1)], "k string, ord int, m int")
    b = spark.createDataFrame([("x", 1, 50), (None, 1, 7), ("new", 1, None)], "k string, ord int, m int")
    got = {r.k: (r.base_m, r.other_m, r.delta_m, r.presence) for r in H.compare(a, b, ["k"], ["m"], "ord").collect()}
    assert got == {"x": (20, 50, 30, "both"), None: (5, 7, 2, "both"), "gone": (1, None, None, "removed"), "new": (None, None, None, "added")}


def test_concurrency_gauge_keeps_long_jobs(spark, tmp_path):
    rows = [(1, "a", 10_000_000), (2, "a", 1_117_000_000_000), (3, "a", 2**63 - 1), (4, "a", 5), (5, "b", 0), (6, "b", None), (7, "b", 7)]
    jobs = spark.createDataFrame(rows, "job_key bigint, model string, duration_ms bigint")
    jobs = jobs.withColumn("recorded_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("job_key"))).withColumn("ingested_at", F.col("recorded_at"))
    for c in ("record_key", "job_id", "input_path", "profile", "status", "queue_wait_ms", "chunk_count", "warning_count"):
        jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    jobs.write.parquet(str(tmp_path / "dogfood_jobs.parquet"))
    assert {r.model: r.peak for r in queries.q_concurrency_gauge(spark, str(tmp_path)).collect()} == {"a": 4, "b": 1}


def test_concurrency(spark):
    rng = random.Random(3)
    spans = [(g, s, s + rng.randrange(1, 300_000)) for g in ("a", "b", None) for s in (rng.randrange(0, 600_000) for _ in range(60))]
    df = spark.createDataFrame(spans, "g string, s long, e long")
    got = {r.g: r.peak for r in H.concurrency(df, ["g"], F.timestamp_seconds("s"), F.timestamp_seconds("e")).collect()}
    for g in ("a", "b", None):
        mine = [x for x in spans if x[0] == g]
        assert got[g] == max(sum(s <= t < e for _, s, e in mine) for _, t, _ in mine)


def test_previous(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 400) * 86_400, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, s long, k int").withColumn("at", F.timestamp_seconds("s"))
    got = {r.k: r.before.k if r.before else None for r in H.previous(df, ["g"], "at", "k", ["k"], F.date_trunc("month", "at")).collect()}
    want = {}
    for g in ("a", "b", None):
        mine = sorted((s, k) for x, s, k in rows if x == g)
        want |= {k: mine[i - 1][1] if i else None for i, (_, k) in enumerate(mine)}
    assert got == want


def test_setting_changes(spark):
    a = spark.createDataFrame([(1, "x", "y", None)], "id int, p string, q string, r string")
    b = spark.createDataFrame([(1, "x", "z", "new"), (2, "x", None, None)], "id int, p string, q string, r string")
    got = {(r.id, r.setting): r.change for r in H.setting_changes(a, b, ["id"]).collect()}
    assert got == {(1, "q"): "update", (1, "r"): "add", (2, "p"): "add"}


def test_fit_policies():
    item = {"title": "T", "abstract": "a" * 20, "bullets": ["b" * 20] * 3, "open_questions": ["q" * 20] * 2, "snippets": ["s" * 20] * 2, "confidence": "low"}
    bare = {**item, "title": "U", "snippets": []}
    whole = K.fit([item], None)
    assert len(whole[0][0]["bullets"]) == 3 and len(item["bullets"]) == 3 and not any(whole[2].values())
    kept, text, gone = K.fit([item], len(whole[1]) - 1, "evidence-first")
    assert len(kept[0]["open_questions"]) == 1 and len(kept[0]["snippets"]) == 2 and gone["open_questions"] == 1
    kept, text, gone = K.fit([item], len(whole[1]) - 1, "summary-first")
    assert len(kept[0]["snippets"]) == 1 and len(kept[0]["bullets"]) == 3 and gone["snippets"] == 1
    # Items with evidence stay, even where nothing fits; those without go.
    for policy in K.FIT_POLICIES[1:]:
        kept, text, gone = K.fit([item, bare], 30, policy)
        assert gone == {"open_questions": 4, "bullets": 6, "items": 2, "snippets": 2} or gone["items"] == 1
    kept, text, gone = K.fit([item, bare], len(K.fit([{**item, "bullets": [], "open_questions": []}], None)[1]), "evidence-first")
    assert [x["title"] for x in kept] == ["T"] and gone == {"open_questions": 4, "bullets": 6, "items": 1, "snippets": 0}
    # By turns.
    kept, text, gone = K.fit([item], len(whole[1]) - 24, "balanced")
    assert gone == {"open_questions": 1, "bullets": 0, "items": 0, "snippets": 1}
    for cap in range(0, len(whole[1]), 7):
        for policy in K.FIT_POLICIES:
            kept, text, gone = K.fit([item, bare], cap, policy)
            assert text == K.fit(kept, None)[1] and (len(text) <= cap or not any(x["bullets"] or x["open_questions"] or x["snippets"] for x in kept))


def test_snippet_packs(spark):
    rows = [("s", f"f{i % 3}", 10 - i, i, i, f"text number {i} of all") for i in range(9)] + [("s", "f0", 1, 1, 1, "Text  number 0 of all!"), (None, "f", 1, 1, 1, "alone")]
    df = spark.createDataFrame(rows, "src string, input_path string, score int, start_line int, char_start int, text string")
    got = {r.src: r for r in K.snippet_packs(df, ["src"], most=5, per_file=2, max_chars=100).collect()}
    assert got["s"].chars <= 100 and got["s"].snippets + got["s"].dropped == 5 and got["s"].fit
    assert got[None].markdown == "- [1] f: alone"
    tiny = K.snippet_packs(df, ["src"], max_chars=3).collect()
    assert all(r.snippets == 0 and not r.fit for r in tiny)


def test_contract_violations(spark):
    good = {"title": "t", "abstract": "", "bullets": ["a"], "open_questions": [], "confidence": "low", "extra": 1}
    docs = [json.dumps(good), json.dumps({**good, "bullets": ["a", 1]}), json.dumps({**good, "confidence": "odd"}), json.dumps({k: v for k, v in good.items() if k != "title"}), json.dumps({**good, "title": None}), "[]", "{bad", None, ""]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r.e for r in df.select("i", contracts.violations(F.col("d"), contracts.SUMMARY).alias("e")).orderBy("i").collect()]
    assert got == [[], ["$.bullets[1]: must be string"], ["$.confidence: is not an allowed value"], ["$: lacks title"], ["$.title: must be string"], ["$: must be object"], ["$: is not JSON"], ["$: is not JSON"], ["$: is not JSON"]]


def test_contract_kinds(spark):
    c = {"type": "object", "properties": {"n": {"type": "integer"}, "b": {"type": "boolean"}, "u": {"type": ["string", "null"]}, "k": {"const": "x"}}}
    c["properties"] |= {"e": {"type": "string", "enum": ["ä"]}, "l": {"type": "array", "items": {"type": "string", "const": "é"}}}
    docs = ['{"n": 1, "b": true, "u": null, "k": "x", "e": "ä", "l": ["é"]}', '{"n": true, "b": 1, "u": 3, "k": "y"}', '{"e": 1, "l": ["e", "é", 2]}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [sorted(r.e) for r in df.select("i", contracts.violations(F.col("d"), c).alias("e")).orderBy("i").collect()]
    assert got == [[], ["$.b: must be boolean", '$.k: must be "x"', "$.n: must be integer", "$.u: must be string or null"], ["$.e: is not an allowed value", "$.e: must be string", '$.l[0]: must be "é"', '$.l[2]: must be "é"', "$.l[2]: must be string"]]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"chunk_chars": 500}')
    s, where = config.resolve("large", str(tmp_path / "s.json"), snippets=2)
    assert (s.chunk_chars, s.reduce_chars, s.snippets) == (500, 12000, 2)
    assert (where["chunk_chars"], where["reduce_chars"], where["snippets"], where["attempts"]) == ("file", "profile", "call", "default")
    for bad in ({"profile": "no"}, {"nope": 1}, {"chunk_chars": 0}, {"chunk_chars": True}):
        try:
            config.resolve(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert config.changes({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3, "d": 4}, "e": 5}) == [("update", "a.c", 2, 3), ("add", "a.d", None, 4), ("add", "e", None, 5)]
