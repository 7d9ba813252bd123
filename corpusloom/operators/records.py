"""Records of runs: what was asked for and found, catalogues, and results as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Why snippets are dropped.
DROP_REASONS = ("duplicate", "low_signal", "too_long", "unverified")
# The parts of a summary in their order, and the parts that each template shows.
PARTS = ("title", "abstract", "bullets", "open_questions", "confidence")
TEMPLATES = {"standard": PARTS, "compact": ("title", "abstract", "confidence"), "claims": ("title", "bullets"), "questions": ("title", "open_questions")}


def snippet_status(rows: DataFrame, by: Sequence[str], requested: Column, reason: str = "drop_reason") -> DataFrame:
    """Snippets per `by`: (by..., requested, candidates, verified, selected, dropped_<reason>...).  A row without a reason is
    verified; as many as were requested of those are selected.  requested is an aggregate."""
    counted = rows.groupBy(*by).agg(
        requested.alias("requested"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col(reason).isNull()).alias("verified"), *[F.count_if(F.col(reason) == r).alias("dropped_" + r) for r in DROP_REASONS]
    )
    return counted.withColumn("selected", F.least(F.col("requested").cast("bigint"), "verified"))


def quality_totals(status: DataFrame, by: Sequence[str]) -> DataFrame:
    """snippet_status() of jobs, summed per `by`, with the number of jobs; a null counts nothing."""
    names = ["requested", "candidates", "verified", "selected", *["dropped_" + r for r in DROP_REASONS]]
    return status.groupBy(*by).agg(F.count(F.lit(1)).alias("jobs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def diagnostics(items: DataFrame, by: Sequence[str], order: str, raw: str, problem: str = "problem", samples: int = 5) -> DataFrame:
    """Lines of an extraction per `by`: (by..., candidates, parsed, invalid, unsupported, samples): how they were read, and the
    first few invalid lines.  Only these few of each `by` are gathered."""
    counts = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col(problem).isNull()).alias("parsed"), F.count_if(F.col(problem) == "invalid").alias("invalid"), F.count_if(F.col(problem) == "unsupported_type").alias("unsupported")
    )
    from corpusloom.operators.evidence import top_per_group

    few = top_per_group(items.where(F.col(problem) == "invalid").select(*by, order, raw), by, F.col(order), samples)
    few = few.groupBy(*[F.col(c).alias("_k_" + c) for c in by]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", F.col(raw).alias("_raw")))), lambda x: x["_raw"]).alias("samples"))
    joined = counts.join(few, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in by], "left")
    return joined.select(*counts.columns, F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def catalogue(entries: DataFrame, path: str = "run_path", status: str = "status", at: str = "recorded_at") -> DataFrame:
    """Runs from several listings: one row per path, the one recorded last, without entries that have no path or status."""
    rest = [c for c in entries.columns if c != path]
    known = entries.where(F.col(path).isNotNull() & F.col(status).isNotNull())
    last = known.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_r"))
    return last.select(path, *[F.col("_r." + c).alias(c) for c in rest])


def noted(jobs: DataFrame, notes: DataFrame, path: str = "input_path", job: str = "job_id") -> DataFrame:
    """jobs with the note (key, note) on them: by their path, else by their id, else by the file's name.  A key has one note."""
    name = F.element_at(F.split(path, "/"), -1)
    out = jobs
    for i, key in enumerate((F.col(path), F.col(job), name)):
        mine = notes.select(F.col("key").alias(f"_k{i}"), F.col("note").alias(f"_n{i}"))
        out = out.join(mine, key == F.col(f"_k{i}"), "left")
    return out.select(*jobs.columns, F.coalesce("_n0", "_n1", "_n2").alias("note"))


def skipped_lines(files: DataFrame) -> DataFrame:
    """(rel_path, line) of skipped files (rel_path, skip_reason, skip_pattern) as they are listed: with the reason and the pattern,
    where they are known."""
    why = F.when(F.col("skip_reason").isNotNull(), F.concat(F.lit(" - "), "skip_reason", F.when(F.col("skip_pattern").isNotNull(), F.concat(F.lit(" `"), "skip_pattern", F.lit("`"))).otherwise(""))).otherwise("")
    return files.select("rel_path", F.concat(F.lit("- `"), "rel_path", F.lit("`"), why).alias("line"))


def snippet_record(job_path: Column, snippet: Column) -> Column:
    """A snippet (JSON text) as one struct: places under either of their names, lenient numbers, and its own source path only
    where that is another than the job's.  Null for a snippet without text."""
    text = T.strip(F.coalesce(T.at_path(snippet, "text"), F.lit("")))
    source = T.strip(F.coalesce(T.at_path(snippet, "source_path"), F.lit("")))
    either = lambda a, b: F.when(F.try_variant_get(F.try_parse_json(snippet), "$." + a, "variant").isNotNull(), T.whole_number(snippet, a)).otherwise(T.whole_number(snippet, b))
    record = F.struct(
        text.alias("text"), T.strip(F.coalesce(T.at_path(snippet, "reason"), F.lit(""))).alias("reason"), T.whole_number(snippet, "score").alias("score"), T.whole_number(snippet, "start_line").alias("start_line"), T.whole_number(snippet, "end_line").alias("end_line"),
        either("start_char", "char_start").alias("start_char"), either("end_char", "char_end").alias("end_char"), F.when((source != "") & (source != job_path), source).alias("source_path"),
    )
    return F.when(text != "", record)


def shaped(summary: Column, template: str = "standard", parts: Sequence[str] | None = None) -> Column:
    """The parts of a summary that a template shows, or those named, in the order of PARTS."""
    wanted = TEMPLATES[template] if parts is None else parts
    if not wanted or set(wanted) - set(PARTS):
        raise ValueError(f"parts must be some of {', '.join(PARTS)}")
    return F.struct(*[summary[p].alias(p) for p in PARTS if p in wanted])


def summary_markdown(summary: Column) -> Column:
    """A summary as Markdown: title, abstract, key points, open questions and confidence."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    points = F.when(F.size(summary["bullets"]) > 0, listed(summary["bullets"])).otherwise("- No key points returned.")
    questions = F.when(F.size(summary["open_questions"]) > 0, F.concat(F.lit("\n\n## Open Questions\n\n"), listed(summary["open_questions"]))).otherwise("")
    return F.concat(F.lit("# "), summary["title"], F.lit("\n\n"), summary["abstract"], F.lit("\n\n## Key Points\n\n"), points, questions, F.lit("\n\nConfidence: `"), summary["confidence"], F.lit("`\n"))
