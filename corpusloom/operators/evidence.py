"""Verifying, scoring, de-duplicating and selecting snippets and items.

De-duplication is an aggregation with a partial step before the shuffle (``min_by``), never a window over all rows of a key,
so a text that a third of all rows repeat costs one row per task.  Per-file limits are taken the same way: each task keeps
a file's best rows before they are shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import cut, small

FAR_LINE, FAR_CHAR = 10**9, 10**12


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripped lines of the last column's texts, each with the other columns, its number and its place; linear in the text."""
    for batch in batches:
        *rest, text = batch.columns
        of_text = pc.split_pattern(pc.fill_null(text, ""), "\n")
        line, row = of_text.flatten(), pc.list_parent_indices(of_text).to_numpy()
        size = pc.utf8_length(line).to_numpy().astype(np.int64) + 1
        end = np.cumsum(size)
        first = of_text.offsets.to_numpy()[:-1][row]  # the text's first line among all lines
        start = end - size - (end - size)[first]
        bare = pc.utf8_ltrim(line, characters=T.SPACE_CHARS)
        start += size - 1 - pc.utf8_length(bare).to_numpy()
        bare = pc.utf8_rtrim(bare, characters=T.SPACE_CHARS)
        kept = np.flatnonzero(pc.not_equal(bare, "").to_numpy(zero_copy_only=False))
        at, from_row = pa.array(kept), pa.array(row[kept])
        columns = [c.take(from_row) for c in rest] + [pa.array((np.arange(len(row)) - first + 1)[kept].astype(np.int32)), pa.array(start[kept].astype(np.int32)), bare.take(at)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "line_no", "char_start", "text"])


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The lines of texts as snippet candidates: (key, keep..., line_no, char_start, text), without blank lines.  One pass over
    whole columns of text, as a fold over a text's lines would copy its result at every line."""
    rows = documents.select(key, *keep, T.newlines(F.col(text)).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_lines, f"{kinds}, line_no int, char_start int, text string")


def scored(rows: DataFrame, text: str = "text", reason: str | None = None) -> DataFrame:
    """rows with score and score_reasons; the text must be stripped."""
    rows = rows.withColumn("_shown", T.signals(F.col(text), F.col(reason) if reason else None))
    n = F.length(text)
    return rows.withColumn("score", T.points(F.col("_shown"), n)).withColumn("score_reasons", T.reasons(F.col("_shown"), n)).drop("_shown")


def _bare(text: Column) -> Column:
    return F.regexp_replace(T.strip(F.coalesce(text, F.lit(""))), r"\A[\"']+|[\"']+\z", "")


def _first_places(sources: pd.Series, texts: pd.Series) -> pd.Series:
    """Of each text its first place in the source and the lines before it."""
    out = []
    for source, wanted in zip(sources, texts, strict=True):
        breaks = [m.start() for m in re.finditer("\n", source or "")]
        found = [(source or "").find(t) if t else -1 for t in (wanted if wanted is not None else [])]
        out.append([{"char_start": at, "lines_before": bisect.bisect_left(breaks, at)} if at >= 0 else {"char_start": None, "lines_before": None} for at in found])
    return pd.Series(out)


def placed(source: Column, candidates: Column) -> Column:
    """array<struct<..., text, ...>> with each candidate's 0-based char_start in the source and the lines of the source that end
    before it (lines_before); null where it does not stand there.  The source stays one value: explode what comes out."""
    find = F.pandas_udf(_first_places, "array<struct<char_start:int,lines_before:int>>")
    places = find(source, F.transform(candidates, lambda c: _bare(c["text"])))
    return F.zip_with(candidates, places, lambda c, p: c.withField("char_start", p["char_start"]).withField("lines_before", p["lines_before"]))


def drop_reasons(rows: DataFrame, source: str | None, by: Sequence[str], order: str, max_chars: int = 600, text: str = "text") -> DataFrame:
    """rows with drop_reason (null: verified) and the 0-based char_start of the text in its source.

    In this order: empty is unverified; too long; low signal; a text verified before among the same `by` is a duplicate; not
    in the source is unverified.  `source` and `text` are columns; a null text counts as empty.  The source column is left
    out of the result, and never shuffled; without one, rows have char_start already (placed()).
    """
    rows = rows.withColumn("_bare", _bare(F.col(text)))
    if source is not None:
        rows = rows.withColumn("char_start", T.find(F.col(source), F.col("_bare"))).drop(source)
    early = F.when(F.col("_bare") == "", "unverified").when(F.length("_bare") > max_chars, "too_long").when(T.is_low_signal(F.col("_bare")), "low_signal")
    early = F.coalesce(early, F.when(F.col("char_start").isNull(), "unverified"))
    rows = rows.withColumn("_early", early)
    # Only rows that would be verified compete; the first of each text wins.
    keys = [*by, "_bare"]
    firsts = rows.where("_early is null").groupBy(*[F.col(c).alias("_k_" + c) for c in keys]).agg(F.min(order).alias("_first"))
    joined = rows.join(firsts, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in keys], "left").drop(*["_k_" + c for c in keys])
    reason = F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_first") != F.col(order), "duplicate")
    return joined.withColumn("drop_reason", reason).drop("_bare", "_early", "_first")


def order_of(path: str = "input_path", line: str = "start_line", char: str = "char_start", text: str = "text") -> Column:
    """The total order of snippets as one struct: best score first, then path, line, place and text."""
    return F.struct(
        (-F.coalesce(F.col("score"), F.lit(0))).alias("a"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("b"),
        F.coalesce(F.col(line).cast("long"), F.lit(FAR_LINE)).alias("c"),
        F.coalesce(F.col(char).cast("long"), F.lit(FAR_CHAR)).alias("d"),
        F.coalesce(F.col(text), F.lit("")).alias("e"),
    )


def dedupe(rows: DataFrame, order: Column, text: str = "text") -> DataFrame:
    """The first row, in the given order, of each text that says the same; texts of punctuation only are dropped."""
    rest = rows.columns
    keyed = rows.withColumn("_key", T.duplicate_key(F.col(text))).where("_key != ''")
    best = keyed.groupBy("_key").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest])


def top_per_group(rows: DataFrame, by: Sequence[str], order: Column, most: int) -> DataFrame:
    """The first `most` rows of each group, with rank_in_group from 1.

    Spark limits groups per task before the shuffle (rank limit pushed below the exchange), so a hot group is not gathered.
    """
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= most)


def round_robin(rows: DataFrame, order: Column, per_file: int, most: int, path: str = "input_path") -> DataFrame:
    """At most `most` rows, at most `per_file` of a file, in rounds: every file's best, then every file's second, and so on;
    files in the order of their best.  With position from 1; zero caps give no rows."""
    if most <= 0 or per_file <= 0:
        return rows.limit(0).withColumn("rank_in_group", F.lit(0)).withColumn("position", F.lit(0))
    kept = top_per_group(rows.withColumn("_order", order), [path], F.col("_order"), per_file)
    best = kept.withColumn("_best", F.min("_order").over(Window.partitionBy(path)))
    chosen = best.orderBy("rank_in_group", "_best", "_order").limit(most)
    # At most `most` rows are left, so numbering them takes one task.
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("rank_in_group", "_best", "_order"))).drop("_order", "_best")


def diverse(rows: Column, wanted: int, distance: int = 20) -> Column:
    """Of a file's ranked array<struct<line, text, ...>>, `wanted` that lie more than `distance` lines apart; if there are
    fewer, filled up in rank order with texts not yet taken."""
    kind = lambda a: F.slice(a, 1, 0)  # noqa: E731  (an empty array of the same type)
    far = F.aggregate(
        rows,
        kind(rows),
        lambda got, x: F.when((F.size(got) < wanted) & ~F.exists(got, lambda g: F.abs(g["line"] - x["line"]) <= distance), F.concat(got, F.array(x))).otherwise(got),
    )
    return F.aggregate(
        rows, far, lambda got, x: F.when((F.size(got) < wanted) & ~F.exists(got, lambda g: g["text"] == x["text"]), F.concat(got, F.array(x))).otherwise(got)
    )


def select_diverse(rows: DataFrame, by: Sequence[str], wanted: int, distance: int = 20) -> DataFrame:
    """diverse() per group, with position from 1.  A group must be the snippets of one text, which was one row."""
    packed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col("char_start").alias("b"), F.col("line_no").alias("line"), "text")))
    groups = rows.groupBy(*by).agg(packed.alias("_r"))
    chosen = groups.select(*by, F.posexplode(diverse(F.col("_r"), wanted, distance)).alias("_i", "_x"))
    return chosen.select(*by, (F.col("_i") + 1).alias("position"), (-F.col("_x.a")).alias("score"), F.col("_x.b").alias("char_start"), F.col("_x.line").alias("line_no"), F.col("_x.text").alias("text"))


def merge_items(items: DataFrame, by: Sequence[str], most: int | None = None, order: str = "ord") -> DataFrame:
    """Items that mean the same (equal item_key) within `by` as one: the first item; text, support and rank of the first
    verified one where the first is not; up to 6 of their sources, in order; ranked, at most `most` per `by`.

    Needs item_key, kind, text, source_support, rank_score, source (a struct) and the order column.
    """
    # Two aggregations read the items, so they are parsed once and written.
    items = cut(items.select(*by, "item_key", "kind", "text", "source_support", "rank_score", "source", order))
    verified = F.col("source_support") == "snippet_verified"
    say = F.struct("text", "source_support", "rank_score")
    merged = items.groupBy(*by, "item_key").agg(
        F.min(order).alias("ord"),
        F.min_by("kind", order).alias("kind"),
        F.coalesce(F.min_by(F.when(verified, say), F.when(verified, F.col(order))), F.min_by(say, order)).alias("_say"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    first = Window.partitionBy(*by, "item_key").orderBy("_at")
    distinct = items.groupBy(*by, "item_key", "source").agg(F.min(order).alias("_at"))
    few = distinct.withColumn("_k", F.row_number().over(first)).where("_k <= 6")
    sources = few.groupBy(*by, "item_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "source"))), lambda x: x["source"]).alias("sources"))
    keys = [*by, "item_key"]
    joined = merged.join(sources.select(*[F.col(c).alias("_s_" + c) for c in keys], "sources"), [F.col(c).eqNullSafe(F.col("_s_" + c)) for c in keys])
    out = joined.select(*keys, "ord", "kind", "_say.*", "n_merged", "sources")
    if most is None:
        return out
    return top_per_group(out, list(by), F.struct((-F.col("rank_score")).alias("a"), F.col("kind").alias("b"), F.col("text").alias("c"), F.col("ord").alias("d")), most)


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df in the given order with numbers from 1, without gathering it: a range-partitioned sort, then each partition's rows
    are numbered from the count of those before.  The sorted rows are written once, so both steps see the same partitions."""
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    # One row per partition.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before", "_from")
    return laid.join(small(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_from") + 1).select(*df.columns, name)
