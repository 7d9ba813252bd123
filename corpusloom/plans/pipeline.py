"""Whole runs over a table of sources: plan chunks, call the model, parse, verify, select, reduce, and state what came of it.

sources is (rel_path string, content string).  Chunks are rows, so a long text is worked on by many tasks.  What the model
said is written to the checkpoint folder before anything reads it, so a lost executor never repeats calls already made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import parsing
from corpusloom.functions import text as T
from corpusloom.operators import chunking as C
from corpusloom.operators import evidence as E
from corpusloom.operators import history as H
from corpusloom.plans import prompts
from corpusloom.plans.model import ModelClient, call
from corpusloom.session import cut, ship


@dataclass(frozen=True)
class Settings:
    """Limits of a run."""

    chunk_chars: int = 7000
    overlap_chars: int = 0
    keep_headings: bool = True
    reduce_chars: int = 8000
    attempts: int = 2
    snippets: int = 4
    snippet_chars: int = 600
    preset: str = "research"
    items_per_chunk: int = 10
    items_per_file: int = 40
    guidance: str = ""

    def __post_init__(self) -> None:
        for name in ("chunk_chars", "reduce_chars", "attempts", "snippet_chars", "items_per_chunk", "items_per_file"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"{name} must be a positive whole number")
        if self.overlap_chars < 0 or self.snippets < 0 or self.preset not in T.PRESETS:
            raise ValueError("overlap_chars and snippets must not be negative and the preset must be known")


@dataclass(frozen=True)
class Run:
    """Tables of a run; items is there for extractions, snippets for summaries."""

    jobs: DataFrame
    calls: DataFrame
    snippets: DataFrame | None = None
    items: DataFrame | None = None


def _texts(sources: DataFrame) -> DataFrame:
    return sources.select("rel_path", T.newlines(F.coalesce(F.col("content"), F.lit(""))).alias("text"))


def _called(sources: DataFrame, client: ModelClient, s: Settings, ask: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(texts that are blank, chunks with the model's response).  A text within the limit is one call, as it is; a longer one is
    planned in chunks that keep within the limit with the lines they are shown with."""
    ship(sources.sparkSession)
    texts = _texts(sources)
    blank = texts.where(T.strip(F.col("text")) == "").select("rel_path")
    texts = texts.where(T.strip(F.col("text")) != "")
    whole = texts.where(F.length("text") <= s.chunk_chars)
    whole = whole.select("rel_path", F.lit("single").alias("kind"), F.lit("chunk-0001").alias("chunk_id"), F.lit(1).alias("chunk_index"), F.lit(0).alias("char_start"), F.lit(1).alias("line_start"), F.col("text").alias("source_span"), F.col("text").alias("shown"))
    chunks = C.plan(texts.where(F.length("text") > s.chunk_chars), s.chunk_chars, s.overlap_chars, s.keep_headings, header=True)
    shown = C.render(F.col("rel_path"), F.col("chunk_index"), F.col("chunk_total"), F.col("text"), F.col("heading_ancestry"), F.col("overlap_text"))
    chunks = chunks.select("rel_path", F.lit("chunk_map").alias("kind"), "chunk_id", "chunk_index", "char_start", "line_start", "source_span", shown.alias("shown"))
    rows = whole.unionByName(chunks).withColumn("prompt", ask(F.col("rel_path"), F.col("shown"))).drop("shown")
    return blank, cut(call(rows, client, s.attempts))


def _calls(made: DataFrame) -> DataFrame:
    return made.select("rel_path", "kind", "chunk_id", "attempts", "started_at", "ended_at", "duration_ms", "error")


def _state(error: str = "error") -> F.Column:
    return F.when(F.col(error).isNotNull(), "failed")


def _rendered(p: Column) -> Column:
    """A chunk's summary as the reduce step is shown it, after its heading."""
    listed = lambda c: F.array_join(F.transform(c, lambda b: F.concat(F.lit("- "), b)), "\n")
    questions = F.when(F.size(p["open_questions"]) > 0, F.concat(F.lit("\n\nOpen questions:\n"), listed(p["open_questions"]))).otherwise("")
    return F.concat(F.lit("\n\nTitle: "), p["title"], F.lit("\nAbstract: "), p["abstract"], F.lit("\n\nKey points:\n"), listed(p["bullets"]), questions, F.lit("\n\n"))


def summarize(sources: DataFrame, client: ModelClient, s: Settings = Settings(), instructions: str = "") -> Run:
    """Summaries per source: jobs (rel_path, status, failure, chunks, verified, selected, title, abstract, bullets, ...).

    A blank source fails with input_empty; a source with a failed chunk or reduce call fails with that call's failure.  Chunk
    summaries are reduced in generations of batches until one is left.  Every call is a row of calls.
    """
    ask = lambda path, shown: prompts.summarize(path, shown, F.lit(s.snippets), s.snippet_chars, instructions, s.guidance)
    blank, made = _called(sources, client, s, ask)
    parsed = parsing.with_summary(made, "response", "_s")
    # Snippets: candidates of every chunk, verified in its part of the source, selected over the whole source.
    said = F.transform(F.filter(parsing.sections(F.col("response")), lambda x: x["section"] == "snippets"), lambda x: x["line"])
    cands = made.where("error is null").select("rel_path", "chunk_index", "char_start", "line_start", "source_span", said.alias("_said"))
    cands = cands.withColumn("_said", parsing.snippet_candidates(F.col("_said"))).withColumn("_found", E.placed(F.col("source_span"), F.col("_said")))
    cands = cands.select("rel_path", "chunk_index", F.col("char_start").alias("chunk_start"), "line_start", F.posexplode("_found").alias("_i", "_c"))
    cands = cands.select("rel_path", F.struct("chunk_index", "_i").alias("ord"), "chunk_start", "line_start", "_c.text", "_c.reason", "_c.char_start", "_c.lines_before")
    checked = cut(E.drop_reasons(cands, None, ["rel_path"], "ord", s.snippet_chars))
    good = checked.where("drop_reason is null").withColumn("char_start", F.col("chunk_start") + F.col("char_start")).withColumn("line_no", F.col("line_start") + F.col("lines_before"))
    scored = E.scored(good.drop("lines_before", "line_start"), reason="reason")
    selected = cut(E.select_diverse(scored, ["rel_path"], s.snippets)) if s.snippets else scored.limit(0).withColumn("position", F.lit(0))
    # Reduce.
    level = cut(parsed.select("rel_path", F.col("chunk_index").alias("ord"), F.col("_s.payload").alias("payload"), F.col("_s.structured_valid").alias("ok"), "error"))
    calls = _calls(made)
    generation = 0
    while True:  # each generation leaves at most half of a source's summaries, or joins some of them
        generation += 1
        groups = level.groupBy("rel_path").agg(F.count(F.lit(1)).alias("_n"), F.max("error").alias("_failed"))
        open_ = groups.where("_n > 1 and _failed is null").select("rel_path")
        if open_.limit(1).count() == 0:
            break
        some = level.join(open_, "rel_path", "left_semi").withColumn("_t", _rendered(F.col("payload")))
        lists = some.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("ord", "_t"))).alias("_l"))
        numbers = C.batches(F.transform("_l", lambda x: F.length(x["_t"]) + len("## Chunk 9999")), s.reduce_chars)
        rows = lists.withColumn("_b", numbers).select("rel_path", F.posexplode("_l").alias("_i", "_x"), "_b").withColumn("_k", F.element_at("_b", F.col("_i") + 1))
        # A generation that joins nothing (each payload alone too long) puts pairs together, so that every one makes progress.
        stuck = rows.groupBy("rel_path").agg((F.countDistinct("_k") == F.count(F.lit(1))).alias("_stuck"))
        rows = rows.join(stuck, "rel_path").withColumn("_k", F.when(F.col("_stuck"), F.floor(F.col("_i") / 2)).otherwise(F.col("_k")))
        batches = rows.groupBy("rel_path", F.col("_k").cast("int").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("_i", "_x._t"))).alias("_l"))
        shown = F.array_join(F.transform("_l", lambda x, i: F.concat(F.lit("## Chunk "), (i + 1).cast("string"), x["_t"])), "")
        asked = batches.select("rel_path", "ord", prompts.reduce(F.col("rel_path"), shown, F.size("_l"), instructions, s.guidance).alias("prompt"))
        reduced = cut(call(asked, client, s.attempts))
        calls = calls.unionByName(_calls(reduced.withColumn("kind", F.lit("reduce")).withColumn("chunk_id", F.format_string(f"reduce-{generation}-%04d", "ord"))))
        new = parsing.with_summary(reduced, "response", "_s").select("rel_path", "ord", F.col("_s.payload").alias("payload"), F.col("_s.structured_valid").alias("ok"), "error")
        level = cut(level.join(open_, "rel_path", "left_anti").unionByName(new))
    final = level.groupBy("rel_path").agg(F.min_by("payload", "ord").alias("payload"), F.min_by("ok", "ord").alias("ok"), F.max("error").alias("error"))
    counted = made.groupBy("rel_path").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    verified = good.groupBy("rel_path").agg(F.count(F.lit(1)).alias("verified"))
    picked = selected.groupBy("rel_path").agg(F.count(F.lit(1)).alias("selected"))
    jobs = counted.join(final, "rel_path").join(verified, "rel_path", "left").join(picked, "rel_path", "left")
    few = F.coalesce("selected", F.lit(0)) < F.least(F.lit(s.snippets), F.coalesce("verified", F.lit(0)))
    status = F.coalesce(_state(), F.when(~F.coalesce("ok", F.lit(False)) | few, "complete_with_warnings"), F.lit("complete"))
    answered = lambda name: F.when(F.col("error").isNull(), F.col("payload." + name)).alias(name)
    jobs = jobs.select(
        "rel_path", status.alias("status"), F.when(F.col("error").isNotNull(), T.failure(F.col("error"))).alias("failure"), "chunks", F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("selected", F.lit(0)).alias("selected"),
        *map(answered, ("title", "abstract", "bullets", "open_questions", "confidence")),
    )
    empty = blank.select("rel_path", F.lit("failed").alias("status"), T.failure(F.lit("input file contains no usable text")).alias("failure"), F.lit(0).alias("chunks"), F.lit(0).cast("bigint").alias("verified"), F.lit(0).cast("bigint").alias("selected"))
    return Run(jobs.unionByName(empty, allowMissingColumns=True), calls, snippets=selected)


def extract(sources: DataFrame, client: ModelClient, s: Settings = Settings(), focus: str = "") -> Run:
    """Items per source: parsed and verified per chunk (the best per chunk kept), merged per source (the best per source kept).
    jobs has status, failure, chunks and items; coverage says how much of the run they cover."""
    ask = lambda path, shown: prompts.extract(path, shown, s.preset, s.items_per_chunk, s.snippet_chars, focus, s.guidance)
    blank, made = _called(sources, client, s, ask)
    rows = made.where("error is null").select("rel_path", "chunk_id", "chunk_index", F.col("char_start").alias("chunk_start"), "source_span", "response")
    lines = parsing.tagged_lines(rows, "response", s.preset, source="source_span").where("problem is null")
    items = lines.withColumn("item_key", T.item_key(F.col("kind"), F.col("text"), F.col("entity_type"), F.col("url"))).withColumn("rank_score", T.rank(F.col("kind"), F.col("source_support"), F.col("text")))
    items = items.withColumn("ord", F.struct("chunk_index", "line_no"))
    items = items.withColumn("source", F.struct("rel_path", "chunk_id", (F.col("chunk_start") + F.col("char_start")).alias("char_start"), "snippet"))
    by_chunk = E.merge_items(items, ["rel_path", "chunk_id"], s.items_per_chunk).withColumn("source", F.explode("sources"))
    merged = cut(E.merge_items(by_chunk.drop("sources"), ["rel_path"], s.items_per_file))
    n = merged.groupBy("rel_path").agg(F.count(F.lit(1)).alias("items"))
    done = made.groupBy("rel_path").agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.max("error").alias("error")).join(n, "rel_path", "left")
    status = F.coalesce(_state(), F.lit("complete"))
    jobs = done.select("rel_path", status.alias("status"), F.when(F.col("error").isNotNull(), T.failure(F.col("error"))).alias("failure"), "chunks", F.coalesce("items", F.lit(0)).alias("items"))
    empty = blank.select("rel_path", F.lit("failed").alias("status"), T.failure(F.lit("input file contains no usable text")).alias("failure"), F.lit(0).alias("chunks"), F.lit(0).cast("bigint").alias("items"))
    return Run(jobs.unionByName(empty), _calls(made), items=merged)


def prompt(sources: DataFrame, client: ModelClient, instructions: str, s: Settings = Settings()) -> Run:
    """One call per source with the caller's instructions; never in chunks.  jobs has status, failure and markdown."""
    ship(sources.sparkSession)
    asked = _texts(sources).select("rel_path", F.lit("single").alias("kind"), F.lit("chunk-0001").alias("chunk_id"), prompts.prompt(F.col("rel_path"), F.col("text"), instructions, s.guidance).alias("prompt"))
    made = cut(call(asked, client, s.attempts))
    jobs = made.select("rel_path", F.coalesce(_state(), F.lit("complete")).alias("status"), F.when(F.col("error").isNotNull(), T.failure(F.col("error"))).alias("failure"), F.col("response").alias("markdown"))
    return Run(jobs, _calls(made))


def coverage(run: Run, s: Settings = Settings()) -> DataFrame:
    """One row on an extract run: jobs, those done and failed, coverage (complete, partial, failed), the items of the done jobs
    that mean different things, and how many of them the run keeps (items_per_file for each done job)."""
    done = run.jobs.where("status != 'failed'").select("rel_path")
    items = E.merge_items(run.items.join(done, "rel_path", "left_semi").withColumn("ord", F.struct("rel_path", "ord")).withColumn("source", F.explode("sources")), [])
    n = run.jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") != "failed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    both = n.join(items.agg(F.count(F.lit(1)).alias("items")), how="cross")  # one row each
    state = F.when(F.col("failed") == 0, "complete").when(F.col("done") > 0, "partial").otherwise("failed")
    return both.select("jobs", "done", "failed", state.alias("coverage"), "items", F.least("items", F.col("done") * s.items_per_file).alias("kept"))


def retry_failed(run: Run, sources: DataFrame, client: ModelClient, s: Settings = Settings()) -> Run:
    """A new summarize run over the sources whose job failed.  A failed job without its source is an error, raised before any
    call is made."""
    failed = run.jobs.where("status = 'failed'").select("rel_path")
    if failed.limit(1).count() == 0:
        raise ValueError("the run has no failed jobs")
    missing = failed.join(sources, "rel_path", "left_anti")
    if missing.limit(1).count():
        raise FileNotFoundError("sources of failed jobs are missing")
    return summarize(sources.join(failed, "rel_path", "left_semi"), client, s)


def state(run: Run) -> DataFrame:
    """One row: jobs in all, failed and with warnings, and the run's state."""
    jobs = run.jobs.withColumn("_one", F.lit(1)).withColumn("warning_count", F.lit(0))
    return H.run_states(jobs, ["_one"]).drop("_one")
