"""Run histories: rollups of jobs and calls, comparisons of runs, gauges and failure counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: The states of a job that are counted apart.
STATES = ("queued", "running", "complete", "complete_with_warnings", "partial", "failed")


def state_counts(jobs: DataFrame, by: Sequence[str], state: str = "status") -> DataFrame:
    """Jobs per state and in all; a state that is not known counts in the total only."""
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in STATES])


def final_state(total: Column, failed: Column, warned: Column) -> Column:
    """State of a run by its jobs."""
    return (
        F.when(total == 0, "complete_with_warnings").when(failed == total, "failed").when(failed > 0, "partial").when(warned > 0, "complete_with_warnings").otherwise("complete")
    )


def run_states(jobs: DataFrame, by: Sequence[str], state: str = "status", warnings: str = "warning_count") -> DataFrame:
    """(by..., total, failed, warned, final_status)."""
    counted = jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(state) == "failed").alias("failed"),
        F.count_if((F.col(state) == "complete_with_warnings") | (F.coalesce(F.col(warnings), F.lit(0)) > 0)).alias("warned"),
    )
    return counted.withColumn("final_status", final_state(F.col("total"), F.col("failed"), F.col("warned")))


def rollup_jobs(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Jobs, chunks (1 where unknown), warnings and times per `by`; a null time adds nothing but its job counts."""
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum(F.coalesce("chunk_count", F.lit(1))).alias("chunks"),
        F.sum(F.coalesce("warning_count", F.lit(0))).alias("warnings"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"),
        F.sum(F.coalesce("queue_wait_ms", F.lit(0))).alias("queue_wait_ms"),
        F.max("duration_ms").alias("longest_ms"),
    )


def totals_or(own: Column, fallback: Column) -> Column:
    """A total, or what was recorded where the total is 0 or unknown."""
    return F.coalesce(F.nullif(own, F.lit(0)), fallback)


def by_kind(calls: DataFrame, by: Sequence[str], kind: str, duration: Column) -> DataFrame:
    """Calls and their time per kind; a missing kind is `unknown`, a missing time 0."""
    return calls.groupBy(*by, F.coalesce(F.col(kind), F.lit("unknown")).alias("kind")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(duration, F.lit(0))).alias("duration_ms")
    )


def slowest(rows: DataFrame, duration: str, tie: Sequence[str], most: int) -> DataFrame:
    """The `most` slowest rows, unknown times last; equal times in the order of `tie`."""
    return rows.orderBy(F.desc(F.coalesce(F.col(duration), F.lit(-1))), *tie).limit(most)


def compare(base: DataFrame, other: DataFrame, on: Sequence[str], measures: Sequence[str], order: str | None = None) -> DataFrame:
    """Full outer comparison: (on..., base_<m>, other_<m>, delta_<m>, presence).  A delta is null if a side is missing; null
    keys are equal; of repeated keys the last by `order` counts (any, if there is none)."""

    def one(df: DataFrame, prefix: str) -> DataFrame:
        # max() of a struct that starts with the order takes its row as a whole.
        row = F.struct(*([F.col(order).alias("_o")] if order else []), *[F.col(m) for m in measures])
        best = df.groupBy(*on).agg(F.max(row).alias("_r"))
        return best.select(*[F.col(c).alias(prefix + c) for c in on], F.lit(True).alias(prefix + "here"), *[F.col("_r." + m).alias(prefix + m) for m in measures])

    b, o = one(base, "base_"), one(other, "other_")
    joined = b.join(o, [F.col("base_" + c).eqNullSafe(F.col("other_" + c)) for c in on], "full_outer")
    presence = F.when(F.col("base_here").isNull(), "added").when(F.col("other_here").isNull(), "removed").otherwise("both")
    keys = [F.when(F.col("base_here").isNotNull(), F.col("base_" + c)).otherwise(F.col("other_" + c)).alias(c) for c in on]
    cols = [x for m in measures for x in (F.col("base_" + m), F.col("other_" + m), (F.col("other_" + m) - F.col("base_" + m)).alias("delta_" + m))]
    return joined.select(*keys, *cols, presence.alias("presence"))


def differing(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of the settings that differ, null being a value like any other."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs]))


def previous(rows: DataFrame, by: Sequence[str], at: str, tie: str, keep: Sequence[str], bucket: Column) -> DataFrame:
    """rows with `before`, a struct of the `keep` columns of the row before it among equal `by`, in the order of at and tie; null
    for the first.

    bucket must rise with `at` (a month, say).  Rows look back within their bucket, so no group is gathered in one task; the
    first of a bucket is given the last row of the bucket before, of which there is one per bucket.
    """
    rows = rows.withColumn("_bucket", bucket)
    row = F.struct(*keep)
    inside = rows.withColumn("before", F.lag(row).over(Window.partitionBy(*by, "_bucket").orderBy(at, tie)))
    lasts = rows.groupBy(*by, "_bucket").agg(F.max_by(row, F.struct(at, tie)).alias("_last"))
    carried = lasts.withColumn("_last", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket")))
    keys = [*by, "_bucket"]
    carried = carried.select(*[F.col(c).alias("_k_" + c) for c in keys], "_last")
    joined = inside.join(carried, [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in keys], "left")
    return joined.withColumn("before", F.coalesce("before", "_last")).drop("_bucket", "_last", *["_k_" + c for c in keys])


def settings_long(df: DataFrame, on: Sequence[str], name: str = "value") -> DataFrame:
    """(on..., setting, value) for each setting of a row that is not null."""
    rest = [c for c in df.columns if c not in on]
    pairs = F.array(*[F.struct(F.lit(c).alias("setting"), F.col(c).cast("string").alias("value")) for c in rest])
    return df.select(*on, F.explode(pairs).alias("_p")).select(*on, "_p.setting", F.col("_p.value").alias(name)).where(F.col(name).isNotNull())


def setting_changes(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows (on..., setting, before_value, after_value, change) for each setting that was added, removed or changed."""
    joined = settings_long(before, on, "before_value").join(settings_long(after, on, "after_value"), [*on, "setting"], "full_outer")
    change = F.when(F.col("before_value").isNull(), "add").when(F.col("after_value").isNull(), "remove").when(F.col("before_value") != F.col("after_value"), "update")
    return joined.withColumn("change", change).where("change is not null")


def concurrency(spans: DataFrame, by: Sequence[str], start: Column, end: Column, width_s: int = 86_400) -> DataFrame:
    """The most spans open at once per `by`: (by..., peak).  A span is open from start until before end.

    A sweep over +1 and -1 events in two steps, so that no group is gathered in one task: events are counted per moment and
    summed within buckets of time; the buckets' running sums, few per group, give what is open where each begins.
    """
    events = spans.select(*by, F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    moments = events.groupBy(*by, F.col("_e.at").alias("_at")).agg(F.sum("_e.d").alias("_d")).where("_at is not null")
    moments = moments.withColumn("_bucket", F.floor(F.unix_micros("_at") / (width_s * 1_000_000)))
    inside = moments.withColumn("_run", F.sum("_d").over(Window.partitionBy(*by, "_bucket").orderBy("_at")))
    buckets = inside.groupBy(*by, "_bucket").agg(F.sum("_d").alias("_net"), F.max("_run").alias("_peak"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    carried = buckets.withColumn("_before", F.sum("_net").over(w) - F.col("_net"))
    return carried.groupBy(*by).agg(F.greatest(F.max(F.col("_before") + F.col("_peak")), F.lit(0)).cast("long").alias("peak"))


def failure_counts(rows: DataFrame, by: Sequence[str], message: Column) -> DataFrame:
    """Failures per code and whether a retry may help: (by..., code, category, retryable, failures)."""
    failed = rows.select(*by, T.failure(message).alias("_f"))
    return failed.groupBy(*by, F.col("_f.code").alias("code"), F.col("_f.category").alias("category"), F.col("_f.retryable").alias("retryable")).agg(F.count(F.lit(1)).alias("failures"))


def keep_warnings(warnings: Column, drop_prefix: str = "snippet_") -> Column:
    """Distinct warnings in their order, without those of a prefix."""
    return F.filter(F.array_distinct(F.coalesce(warnings, F.array().cast("array<string>"))), lambda w: ~w.startswith(drop_prefix))
