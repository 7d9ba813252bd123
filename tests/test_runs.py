"""Sources, whole runs, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C
from corpusloom.plans import model
from corpusloom.plans import pipeline as P
from corpusloom.sources import folder
from corpusloom.streaming import intake


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sub" / "deep" / "x").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "sub" / "b.txt").write_text("text é")
    (tmp_path / "sub" / "deep" / "x" / "c.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "sub" / "deep" / "d.bin").write_bytes(b"a\x00b")
    (tmp_path / "sub" / "cut.txt").write_bytes(b"x" * 8191 + "é".encode() + b"y")
    (tmp_path / "sub" / "e.min.js").write_text("x")
    (tmp_path / "sub" / "song.MP3").write_text("x")
    (tmp_path / "sub" / "lib.so").write_text("text by another name")
    (tmp_path / "node_modules" / "n.md").write_text("x")
    (tmp_path / ".hidden" / "_h.md").write_text("seen")
    return tmp_path


def test_folder(spark, files):
    rows = {r.rel_path: r for r in folder.read_folder(spark, str(files), exclude=["sub/b*"]).collect()}
    reasons = {k: r.skip_reason for k, r in rows.items()}
    assert reasons == {
        "a.md": None, "sub/b.txt": "excluded_by_pattern", "sub/deep/x/c.txt": "built_in_non_text", "sub/deep/d.bin": "built_in_non_text", "sub/cut.txt": None, "sub/e.min.js": "built_in_skipped_suffix", ".hidden/_h.md": None,
        "node_modules/n.md": "built_in_skipped_dir", "sub/song.MP3": "built_in_skipped_suffix", "sub/lib.so": None,
    }
    assert rows["a.md"].content == "one\ntwo\nthree" and rows["sub/b.txt"].skip_pattern == "sub/b*"
    listed = {r.rel_path: r.skip_reason for r in folder.read_folder(spark, str(files), include=["*.md"], exclude=["sub/*", "a*"]).collect()}
    assert [k for k, r in listed.items() if r is None] == [".hidden/_h.md"] and listed["a.md"] == "excluded_by_pattern" and listed["sub/b.txt"] == "not_included_by_pattern"
    with pytest.raises(NotADirectoryError):
        folder.read_folder(spark, str(files / "none"))


def test_a_flat_folder_is_many_shards(tmp_path, monkeypatch):
    for i in range(10):
        (tmp_path / f"{i}.md").write_text("x" * i)
    monkeypatch.setattr(folder, "SHARD_FILES", 4)
    assert [len(x.files) for x in folder._Reader({"path": str(tmp_path)}).partitions()] == [4, 4, 2]
    monkeypatch.setattr(folder, "SHARD_BYTES", 9)
    assert all(len(x.files) <= 4 for x in folder._Reader({"path": str(tmp_path)}).partitions())


def test_the_model_is_told_what_to_do(spark, tmp_path):
    """A client that keeps what it is sent: task, shape, limits, instructions and guidance, and chunks within the limit."""

    class Keeper:
        def complete(self, system, user):
            with open(tmp_path / f"{hash(user)}.txt", "w") as f:
                f.write(system + "\0" + user)
            return model.ExtractiveStub().complete(system, user)

    s = P.Settings(chunk_chars=400, reduce_chars=600, guidance="Be brief.", snippets=3, snippet_chars=123)
    P.summarize(sources(spark).where("rel_path in ('a', 'b')"), Keeper(), s, "Mind the rules.").jobs.count()
    sent = [p.read_text().split("\0") for p in tmp_path.glob("*.txt")]
    kinds = {"single": 0, "chunk": 0, "reduce": 0}
    for system, user in sent:
        task, text = user.split("\nFile content:\n", 1)
        assert system.endswith("Guidance: Be brief.") and "Mind the rules." in task and "OPEN QUESTIONS:" in task and "CONFIDENCE: low|medium|high" in task
        kind = "reduce" if "Chunk summaries:" in text else "chunk" if "\nChunk text:\n" in text else "single"
        kinds[kind] += 1
        assert (("up to 3 source snippets" in task) and ("at most 123 characters" in task)) == (kind != "reduce")
        body = text.split("\nChunk text:\n", 1)[-1]
        assert kind == "reduce" or len(body) + len(C.HEADER % ("a", 1, 1, 1) + C.BODY) <= 420
    assert kinds["single"] == 1 and kinds["chunk"] > 3 and kinds["reduce"] >= 1
    for f in tmp_path.glob("*.txt"):
        f.unlink()
    P.extract(sources(spark).where("rel_path = 'b'"), Keeper(), P.Settings(preset="work", items_per_chunk=7), "deadlines").jobs.count()
    (system, user), *more = [p.read_text().split("\0") for p in tmp_path.glob("*.txt")]
    assert not more and "tagged lines" in system and "at most 7 items" in user and "Focus: deadlines" in user and "blocker, decision, follow_up" in user


def sources(spark):
    long = "\n\n".join(f"# Part {i}\n\nParagraph {i} must say that the limit is {i} because of the rule number {i}." for i in range(30))
    return spark.createDataFrame([("a", long), ("b", "Short text that shows the main finding because it must."), ("c", " \n "), ("d", None), ("e", "BOOM here is a text that fails in the model call.")], "rel_path string, content string")


def test_summarize_and_retry(spark):
    s = P.Settings(chunk_chars=400, reduce_chars=600, overlap_chars=40)
    run = P.summarize(sources(spark), model.ExtractiveStub(fail_if="BOOM"), s)
    jobs = {r.rel_path: r for r in run.jobs.collect()}
    assert {k: r.status for k, r in jobs.items()} == {"a": "complete", "b": "complete", "c": "failed", "d": "failed", "e": "failed"}
    assert jobs["a"].chunks > 3 and jobs["a"].selected == 4 and jobs["a"].verified >= 4
    assert jobs["e"].failure.code == "model_timeout" and jobs["e"].failure.retryable and jobs["c"].failure.code == "input_empty"
    calls = {(r.rel_path, r.kind): r.n for r in run.calls.groupBy("rel_path", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert calls[("a", "chunk_map")] == jobs["a"].chunks and calls[("a", "reduce")] >= 1
    assert run.calls.where("rel_path = 'e'").first().attempts == 2
    assert P.state(run).first().final_status == "partial"
    again = P.retry_failed(run, sources(spark), model.ExtractiveStub(), s)
    assert {r.rel_path: r.status for r in again.jobs.collect()} == {"c": "failed", "d": "failed", "e": "complete"}
    with pytest.raises(FileNotFoundError):
        P.retry_failed(run, sources(spark).where("rel_path != 'e'"), model.ExtractiveStub(), s)


def test_snippets_stand_in_the_source(spark):
    run = P.summarize(sources(spark), model.ExtractiveStub(), P.Settings(chunk_chars=400))
    texts = {r.rel_path: r.content for r in sources(spark).collect()}
    rows = run.snippets.collect()
    assert rows and all(texts[r.rel_path][r.char_start : r.char_start + len(r.text)] == r.text for r in rows)
    assert all(texts[r.rel_path].count("\n", 0, r.char_start) + 1 == r.line_no for r in rows)


def test_extract_and_prompt(spark):
    run = P.extract(sources(spark), model.TaggingStub(), P.Settings(chunk_chars=400, items_per_file=6))
    jobs = {r.rel_path: r for r in run.jobs.collect()}
    assert jobs["a"].items == 6 and jobs["b"].items == 1 and jobs["c"].status == "failed"
    texts = {r.rel_path: r.content for r in sources(spark).collect()}
    for r in run.items.collect():
        for x in r.sources:
            if x.snippet:
                assert texts[x.rel_path][x.char_start : x.char_start + len(x.snippet)] == x.snippet
    assert P.coverage(run).first().asDict() == {"jobs": 5, "done": 3, "failed": 2, "coverage": "partial", "items": 8, "kept": 8}
    assert P.prompt(sources(spark), model.ExtractiveStub(), "Say it").jobs.where("status = 'complete'").count() == 5


def test_empty_sources(spark):
    none = sources(spark).limit(0)
    assert P.summarize(none, model.ExtractiveStub()).jobs.count() == 0
    assert P.extract(none, model.TaggingStub()).jobs.count() == 0


def test_bad_settings():
    for bad in ({"chunk_chars": 0}, {"snippets": -1}, {"preset": "x"}):
        with pytest.raises(ValueError):
            P.Settings(**bad)


def test_intake(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("first\r\nline")
    (tmp_path / "in" / "deep" / "b c.txt").write_text("second")
    stream = intake.sources(spark, str(tmp_path / "in"))
    for _ in range(2):
        intake.run(stream, lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        (tmp_path / "in" / "c.txt").write_text("third")
    rows = {r.rel_path: r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"a.txt": "first\nline", "deep/b c.txt": "second", "c.txt": "third"}


def test_windowed_drops_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 09:00:00", "y", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = intake.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.events, r.total) for r in spark.table("w").collect()} == {("x", 2, 3.0), ("y", 1, 4.0)}


def test_latest_state(spark):
    df = spark.createDataFrame([("r", 1, "queued"), ("r", 3, "complete"), ("r", 2, "running")], "run_id string, at int, phase string")
    assert intake.latest_state(df).first().phase == "complete"
