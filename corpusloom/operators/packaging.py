"""Packages of evidence and summaries under a budget of characters.

Everything is cut to at most `most` rows per package by windows that limit groups before the shuffle; only then does a
package's rendering look at its rows one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evidence as E

# How a bundle that is too long is made to fit.
FIT_POLICIES = ("summary-first", "evidence-first", "balanced")


def effective_cap(max_chars: int | None, max_tokens: int | None = None, per_token: float = 4.0) -> int | None:
    """The smaller of a limit in characters and one in tokens; None for no limit."""
    if any(x is not None and x <= 0 for x in (max_chars, max_tokens)) or per_token <= 0:
        raise ValueError("limits must be positive")
    caps = [x for x in (max_chars, None if max_tokens is None else int(max_tokens * per_token)) if x is not None]
    return min(caps) if caps else None


def snippet_packs(rows: DataFrame, by: Sequence[str], most: int = 24, per_file: int = 4, max_chars: int | None = None, path: str = "input_path") -> DataFrame:
    """One package per `by`: (by..., snippets, files, dropped, chars, fit, markdown).

    Distinct snippets in rounds over the files, each with its score; the last ones are dropped until the package is within
    the budget.  If not even the first fits, the package is empty and fit is false.
    """
    keyed = rows.withColumn("_key", T.duplicate_key(F.col("text"))).where("_key != ''")
    cols = rows.columns
    best = keyed.groupBy(*by, "_key").agg(F.min_by(F.struct(*cols), E.order_of(path)).alias("_r")).select(*[F.col(f"_r.`{c}`").alias(c) for c in cols])
    kept = E.top_per_group(best.withColumn("_order", E.order_of(path)), [*by, path], F.col("_order"), per_file)
    kept = kept.withColumn("_best", F.min("_order").over(Window.partitionBy(*by, path)))
    turn = Window.partitionBy(*by).orderBy("rank_in_group", "_best", "_order")
    chosen = kept.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= most)
    line = F.concat(F.lit("- ["), F.col("score").cast("string"), F.lit("] "), F.col(path), F.lit(": "), F.col("text"))
    running = Window.partitionBy(*by).orderBy("position")
    sized = chosen.withColumn("_line", line).withColumn("_upto", F.sum(F.length("_line") + 1).over(running) - 1)
    cap = effective_cap(max_chars)
    within = F.lit(True) if cap is None else F.col("_upto") <= cap
    lines = F.transform(F.array_sort(F.collect_list(F.when(within, F.struct("position", "_line")))), lambda x: x["_line"])
    packs = sized.groupBy(*by).agg(
        F.count_if(within).alias("snippets"), F.countDistinct(F.when(within, F.col(path))).alias("files"), F.count_if(~within).alias("dropped"), F.array_join(lines, "\n").alias("markdown")
    )
    return packs.select(*by, "snippets", "files", "dropped", F.length("markdown").alias("chars"), (F.col("snippets") > 0).alias("fit"), "markdown")


def with_size(markdown: Column) -> Column:
    """A package under a line that states the characters of the whole, that line and its own digits included."""
    rest = F.length(markdown) + len("Size:  characters\n")
    whole = F.coalesce(*[F.when(F.length((rest + d).cast("string")) == d, rest + d) for d in range(1, 12)])
    return F.concat(F.lit("Size: "), whole.cast("string"), F.lit(" characters\n"), markdown)


def _lines(x: dict) -> list[str]:
    """An item as it is rendered."""
    return [f"## {x['title']}", "", x["abstract"], "", *[f"- {b}" for b in x["bullets"]], *[f"? {q}" for q in x["open_questions"]], *[f"> {s}" for s in x["snippets"]], f"Confidence: {x['confidence']}", ""]


def fit(items: list[dict], cap: int | None, policy: str = "balanced") -> tuple[list[dict], str, dict[str, int]]:
    """(items within the cap, their rendering, what was given up by kind).

    One unit after the other is given up, each from the end: details (open questions, then bullets), items without snippets,
    and snippets; evidence-first in this order, summary-first snippets first, balanced by turns as the numbers given up so far
    say.  Texts are never shortened and items with snippets never dropped, so the result may be longer than the cap.
    """
    if policy not in FIT_POLICIES:
        raise ValueError(f"unknown policy {policy}")
    items = [{**x, **{k: list(x[k]) for k in ("bullets", "open_questions", "snippets")}} for x in items]
    gone = dict.fromkeys(("open_questions", "bullets", "items", "snippets"), 0)
    size = sum(len(line) + 1 for x in items for line in _lines(x)) - 1

    def part(kind: str) -> int:
        """Characters that the last unit of a kind takes; 0 if there is none."""
        x = next((x for x in reversed(items) if x[kind]), None)
        gone[kind] += x is not None
        return len(x[kind].pop()) + 3 if x else 0

    def item() -> int:
        i = next((i for i in range(len(items) - 1, -1, -1) if not items[i]["snippets"]), None)
        gone["items"] += i is not None
        return sum(len(line) + 1 for line in _lines(items.pop(i))) if i is not None else 0

    while cap is not None and size > cap:
        snippets_first = policy == "summary-first" or (policy == "balanced" and gone["open_questions"] + gone["bullets"] + gone["items"] > gone["snippets"])
        less = (part("snippets") if snippets_first else 0) or part("open_questions") or part("bullets") or item() or part("snippets")
        if not less:
            break
        size -= less
    return items, "\n".join(line for x in items for line in _lines(x)), gone


def bundles(items: DataFrame, by: Sequence[str], key: str, most: int = 20, max_chars: int | None = None, policy: str = "balanced") -> DataFrame:
    """One bundle per `by` of the first `most` items by key: (by..., items, dropped_items, dropped_open_questions, dropped_bullets,
    dropped_snippets, chars, fit, markdown).

    items needs title, abstract, bullets, open_questions, confidence and, if there are any, snippets (array<string>).  Rows
    per bundle are cut to `most` before they are gathered.
    """
    cap = effective_cap(max_chars)
    if "snippets" not in items.columns:
        items = items.withColumn("snippets", F.array().cast("array<string>"))
    first = E.top_per_group(items, by, F.col(key), most)
    kinds = dict(items.dtypes)
    fields = ["title", "abstract", "bullets", "open_questions", "confidence", "snippets"]

    def run(rows):
        rows = rows.sort_values("rank_in_group")
        given = [{f: list(r[f]) if f in ("bullets", "open_questions", "snippets") else r[f] for f in fields} for r in rows.to_dict("records")]
        kept, text, gone = fit(given, cap, policy)
        head = {c: rows[c].iloc[0] for c in by}
        return pd.DataFrame([{**head, "items": len(kept), "dropped_items": gone["items"], "dropped_open_questions": gone["open_questions"], "dropped_bullets": gone["bullets"], "dropped_snippets": gone["snippets"], "chars": len(text), "fit": cap is None or len(text) <= cap, "markdown": text}])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", items int, dropped_items int, dropped_open_questions int, dropped_bullets int, dropped_snippets int, chars int, fit boolean, markdown string"
    return first.select(*by, "rank_in_group", *fields).groupBy(*by).applyInPandas(run, schema)


def collection(jobs: DataFrame, artifacts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Manifest of jobs with what was found for them: (jobs' columns, has_json, has_markdown, outcome).  A job of another state
    than complete is skipped, as is one without artifacts; broken JSON is collected with that diagnosis."""
    found = artifacts.groupBy(*on).agg(F.max("json").alias("_json"), F.max("markdown").alias("_md"))
    joined = jobs.join(found, list(on), "left")
    has_json, has_md = F.col("_json").isNotNull(), F.col("_md").isNotNull()
    outcome = (
        F.when(~F.col("status").isin("complete", "complete_with_warnings"), "job_not_complete")
        .when(~has_json & ~has_md, "missing_result_artifacts")
        .when(has_json & F.try_parse_json("_json").isNull(), "malformed_json")
        .otherwise("collected")
    )
    return joined.select(*jobs.columns, has_json.alias("has_json"), has_md.alias("has_markdown"), outcome.alias("outcome"))
