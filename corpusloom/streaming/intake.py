"""Structured Streaming: a drop folder into the pipeline, the state of runs, and counts of events in windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T


def sources(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files of a folder as a stream of (rel_path, content).  As with all of Spark's file streams, names that begin with
    . or _ are not seen."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    # The name after the folder, whatever the scheme of the address is.
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^.*?/" + re.escape(folder.strip("/")) + "/", "")
    return files.select(path.alias("rel_path"), T.newlines(F.col("value")).alias("content"))


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Works on each batch of sources and appends its rows to Parquet, under the batch's number; a batch that is repeated
    after a failure replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Events, and their value summed, per kind and window; rows later than `late` behind are dropped, as a watermark says."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))


def latest_state(events: DataFrame, key: str = "run_id", order: str = "at") -> DataFrame:
    """The last event of each run; an append-only log of progress instead of a status rewritten in place."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, *[F.col("_e." + c).alias(c) for c in rest])
