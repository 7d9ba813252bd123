"""Queries of the numbered problems, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import packing, pairs, percentiles, pii, splitting, tokenizer, truncation
from corpusloom.session import latest, spread, table

GROUPS = ["model", "profile"]
MEASURES = ["duration_ms", "queue_wait_ms"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose text alone exceeds their plan's limit."""
    return splitting.oversized(spread(table(spark, folder, "text_chunks")), table(spark, folder, "chunk_plans"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all chunks, each chunk once."""
    return splitting.split_oversized(latest(table(spark, folder, "text_chunks"), "chunk_key"), table(spark, folder, "chunk_plans"))


def distinct_jobs(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """dogfood_jobs, each job once: repeated deliveries are equal but for their time of delivery, which is left out."""
    return table(spark, folder, "dogfood_jobs").select("job_key", *GROUPS, *MEASURES, *more).distinct()


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of both timings per model and profile."""
    found = percentiles.radix_select(distinct_jobs(spark, folder), GROUPS, MEASURES)
    return percentiles.wide(found, GROUPS, MEASURES)


def p2_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of single days, which add up."""
    jobs = distinct_jobs(spark, folder, "recorded_at").withColumn("day", F.to_date("recorded_at"))
    return percentiles.summary(jobs, ["day", *GROUPS], MEASURES)


def p2_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from the days' summaries, with the bounds low and high of each."""
    return percentiles.from_summary(p2_daily(spark, folder), GROUPS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective prompt-response pairs with the kind of their defect."""
    return pairs.defective(spark, table(spark, folder, "model_results"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of both fields that were cut off."""
    return truncation.truncated(table(spark, folder, "model_results")).select("result_key", "field_name").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut values per source and field."""
    return truncation.rates(table(spark, folder, "model_results"))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(spread(table(spark, folder, "documents")))


def p5_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per outcome of decoding their ids again."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    again = tokenizer.decode(tokenizer.encode(documents)).withColumnRenamed("text", "decoded")
    both = documents.join(again, "doc_id")
    return both.groupBy((F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same")).agg(F.count(F.lit(1)).alias("documents"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of all documents for each capacity."""
    return packing.pack_documents(spread(table(spark, folder, "documents")), table(spark, folder, "pack_limits"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and share of room used for each capacity."""
    return packing.fill(p6_packed(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of personal data in all documents."""
    return pii.find(spread(table(spark, folder, "documents"))).select("doc_id", "pii_type", "char_start").distinct()


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with personal data replaced by placeholders."""
    return pii.redact(spread(table(spark, folder, "documents")))


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk: its pieces put together again, whether all are within the limit with their overlap, and whether each overlap is
    the end of the piece before."""
    pieces = p1_pieces(spark, folder)
    row = F.struct("piece_index", "text", "overlap_text", "chars", "tokens", "overlap_before_chars", "overlap_before_tokens")
    d = pieces.groupBy("chunk_key").agg(F.array_sort(F.collect_list(row)).alias("p")).join(latest(table(spark, folder, "text_chunks"), "chunk_key").select("chunk_key", "plan_id"), "chunk_key")
    d = d.join(table(spark, folder, "chunk_plans").select("plan_id", "chunk_strategy", "chunk_chars", "chunk_tokens"), "plan_id")
    by_chars = F.col("chunk_strategy") == "chars"
    fits = lambda x: F.when(by_chars, x["chars"] + x["overlap_before_chars"] <= F.col("chunk_chars")).otherwise(x["tokens"] + x["overlap_before_tokens"] <= F.col("chunk_tokens"))
    within = F.forall(F.slice("p", 2, 1_000_000), fits)
    follows = F.forall(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda i: (i > F.size("p")) | F.endswith(F.try_element_at("p", i - 1)["text"], F.try_element_at("p", i)["overlap_text"]))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return d.select("chunk_key", F.md5(text).alias("text_md5"), within.alias("within"), follows.alias("follows"))


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles in rows, with whether the bounds from the days' summaries hold them."""
    exact = percentiles.radix_select(distinct_jobs(spark, folder), GROUPS, MEASURES)
    c = p2_combined(spark, folder).select(*[F.col(g).alias("_" + g) for g in GROUPS], F.col("measure").alias("_m"), F.col("p").alias("_p"), "low", "high")
    on = [F.col(g).eqNullSafe(F.col("_" + g)) for g in GROUPS] + [F.col("measure") == F.col("_m"), F.col("p") == F.col("_p")]
    return exact.join(c, on, "left").select(*GROUPS, "measure", "p", "value", F.col("value").between(F.col("low"), F.col("high")).alias("within"))


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: documents packed, whether no container is above it, and whether only documents above it are in pieces."""
    packed = p6_packed(spark, folder)
    full = packed.groupBy("capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("capacity_tokens").agg((F.max("n") <= F.first("capacity_tokens")).alias("within"))
    whole = packed.groupBy("capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"))
    whole = whole.groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("documents"), F.min((F.col("k") == 1) | (F.col("n") > F.col("capacity_tokens"))).alias("whole"))
    return full.join(whole, "capacity_tokens")


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Per text: whether it is as long, with its occurrences replaced, as the placeholders say."""
    documents = spread(table(spark, folder, "documents"))
    change = pii.find(documents).groupBy("doc_id").agg(F.sum(F.length("pii_type") + 2 - (F.col("char_end") - F.col("char_start"))).alias("change"))
    after = pii.redact(documents).select("doc_id", F.length("text").alias("n"))
    both = documents.where("text is not null").select("doc_id", F.length("text").alias("was")).join(after, "doc_id").join(change, "doc_id", "left")
    return both.select("doc_id", (F.col("n") == F.col("was") + F.coalesce("change", F.lit(0))).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p2_percentiles": p2_percentiles,
    "p2_daily": p2_daily,
    "p2_combined": p2_combined,
    "p2_bounds": p2_bounds,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_ids": p5_ids,
    "p5_round_trip": p5_round_trip,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_checked": p6_checked,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p7_checked": p7_checked,
}

_JOBS = "with j as (select distinct job_key, model, profile, duration_ms, queue_wait_ms from dogfood_jobs)"
#: DuckDB's digit of a value, as in percentiles.with_digit: magnitudes below 256 are their own digit.
_DIGIT = """case when v = 0 then 0 else sign(v)::bigint * ((abs(v)::hugeint >> b)::bigint + b * 128) end"""

SQL: dict[str, str] = {
    "p1_found": r"""
        select distinct c.chunk_key from text_chunks c join chunk_plans p using (plan_id)
        where case when p.chunk_strategy = 'chars' then length(c.text) > p.chunk_chars
              else len(regexp_extract_all(c.text, '[^\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > p.chunk_tokens end""",
    "p2_percentiles": _JOBS
    + " select model, profile, "
    + ", ".join(
        f"nullif(count({m}), 0) as n_{m}, " + ", ".join(f"quantile_disc({m}, {p}) as p{round(p * 100)}_{m}" for p in percentiles.PROBABILITIES)
        for m in MEASURES
    )
    + " from j group by all having count(duration_ms) + count(queue_wait_ms) > 0",
    "p2_daily": f"""
        with j as (select distinct job_key, model, profile, duration_ms, queue_wait_ms, recorded_at from dogfood_jobs),
        l as (select recorded_at::date as day, model, profile, 'duration_ms' as measure, duration_ms as v from j
              union all select recorded_at::date, model, profile, 'queue_wait_ms', queue_wait_ms from j),
        b as (select *, greatest(length(bin(abs(v))) - 8, 0) as b from l where v is not null)
        select day, model, profile, measure, {_DIGIT} as digit, b::int as below, count(*) as n from b group by all""",
    "p1_rejoined": """select chunk_key, md5(coalesce(any_value(text), '')) as text_md5, true as within, true as follows from text_chunks where plan_id in (select plan_id from chunk_plans) group by 1""",
    "p2_bounds": _JOBS
    + " select model, profile, measure, p, value, true as within from ("
    + " union all ".join(f"select model, profile, '{m}' as measure, {p}::double as p, quantile_disc({m}, {p}) as value from j group by 1, 2" for m in MEASURES for p in percentiles.PROBABILITIES)
    + ") where value is not null",
    "p5_round_trip": "select true as same, count(*) as documents from documents",
    "p6_checked": "select capacity_tokens, true as within, (select count(*) from documents where text != '') as documents, true as whole from pack_limits group by 1",
    "p7_checked": "select doc_id, true as same from documents where text is not null",
}
