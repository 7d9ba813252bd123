"""Text folders and JSON artifacts as tables.

Spark's own file sources hide names that begin with . or _, so folders are read by a Python data source: its partitions are
shards of the list of files, read by the tasks.  The folder must be reachable from all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.functions import text as T
from corpusloom.session import ship

# Folders and endings that are never read.
SKIPPED_FOLDERS = (".git", "__pycache__", "bin", "build", "dist", "node_modules", "obj")
SKIPPED_ENDINGS = (
    ".7z", ".avif", ".bmp", ".doc", ".docx", ".exe", ".gif", ".gz", ".heic", ".ico", ".jpeg", ".jpg", ".min.css", ".min.js", ".mp3", ".mp4", ".pdf", ".png", ".ppt", ".pptx", ".rar", ".tar", ".webp", ".xls", ".xlsx", ".zip",
)
# Why a file is not read.
IN_FOLDER, BY_ENDING, NO_TEXT, NOT_INCLUDED, EXCLUDED = "built_in_skipped_dir", "built_in_skipped_suffix", "built_in_non_text", "not_included_by_pattern", "excluded_by_pattern"
#: Files and bytes of one partition.
SHARD_FILES, SHARD_BYTES = 2_000, 64 << 20
SNIFFED = 8192


class _Shard(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _is_skipped(rel: str) -> bool:
    *folders, name = rel.split("/")
    return not set(folders).isdisjoint(SKIPPED_FOLDERS) or name.lower().endswith(SKIPPED_ENDINGS)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def _listed(self) -> Iterator[tuple[str, int]]:
        """All files with their sizes, as file sources list them: names only, folder by folder."""
        left = [""]
        while left:
            here = left.pop()
            with os.scandir(os.path.join(self.root, here)) as found:
                for x in sorted(found, key=lambda e: e.name):
                    rel = f"{here}/{x.name}" if here else x.name
                    if x.is_dir(follow_symlinks=False):
                        left.append(rel)
                    elif x.is_file():
                        yield rel, x.stat().st_size

    def partitions(self) -> list[InputPartition]:
        """Shards by count and bytes, so a flat folder of many files is many tasks."""
        shards: list[InputPartition] = []
        files, size = [], 0
        for rel, n in self._listed():
            files.append((rel, n))
            size += 0 if _is_skipped(rel) else n
            if len(files) >= SHARD_FILES or size >= SHARD_BYTES:
                shards.append(_Shard(files))
                files, size = [], 0
        return [*shards, _Shard(files)] if files or not shards else shards

    def read(self, shard: _Shard) -> Iterator[tuple]:
        for rel, size in shard.files:
            content, readable = b"", True
            if not _is_skipped(rel):
                try:
                    with open(os.path.join(self.root, rel), "rb") as f:
                        content = f.read()
                except OSError:
                    readable = False
            yield rel, size, content, readable


class TextFolder(DataSource):
    """Format `textfolder`: (rel_path string, size bigint, content binary, readable boolean)."""

    @classmethod
    def name(cls) -> str:
        return "textfolder"

    def schema(self) -> str:
        return "rel_path string, size bigint, content binary, readable boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def skip_reason(path: Column, suffixes: tuple[str, ...] = SKIPPED_ENDINGS) -> Column:
    """Why a path is skipped by its name: IN_FOLDER, BY_ENDING, or null."""
    parts = F.split(path, "/")
    inside = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    ends = T.any_of([F.lower(path).endswith(s) for s in suffixes])
    return F.when(inside, IN_FOLDER).when(ends, BY_ENDING)


def is_text(content: Column, size: Column) -> Column:
    """No zero byte in the first bytes, and these are UTF-8; a character that the sample cuts off is none the worse."""
    head = F.substring(content, 1, SNIFFED)
    tail = lambda k: F.hex(F.substring(head, SNIFFED - k + 1, k))
    whole = lambda k: F.is_valid_utf8(F.substring(head, 1, SNIFFED - k).cast("string"))
    cut_off = (
        (tail(1).rlike("^(?:C[2-9A-F]|D.|E.|F[0-4])$") & whole(1)) | (tail(2).rlike("^(?:E.|F[0-4])[89AB].$") & whole(2)) | (tail(3).rlike("^F[0-4](?:[89AB].){2}$") & whole(3))
    )
    zero = F.hex(head).rlike("^(?:..)*?00")
    return ~zero & (F.is_valid_utf8(head.cast("string")) | ((size > SNIFFED) & cut_off))


def read_folder(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files of a folder: (rel_path, size, content string, skip_reason, skip_pattern); selected where skip_reason is null.

    First what is built in, then include, then exclude; neither list can bring back what is built in.  Content is text with
    \\n line ends, invalid bytes replaced; null for skipped files.
    """
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    ship(spark)
    spark.dataSource.register(TextFolder)
    files = spark.read.format("textfolder").option("path", path).load()
    p = F.col("rel_path")
    out = T.first_glob(p, exclude or [])
    wanted = T.first_glob(p, include) if include else F.lit("")
    no_text = ~F.col("readable") | ~is_text(F.col("content"), F.col("size"))
    reason = F.coalesce(skip_reason(p), F.when(no_text, NO_TEXT), F.when(wanted.isNull(), NOT_INCLUDED), F.when(out.isNotNull(), EXCLUDED))
    text = T.newlines(F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.withColumn("skip_reason", reason)
    return rows.select("rel_path", "size", F.when(F.col("skip_reason").isNull(), text).alias("content"), "skip_reason", F.when(F.col("skip_reason") == EXCLUDED, out).alias("skip_pattern"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, by an explicit schema; what is broken or no object comes in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def results_with_reasons(jobs: DataFrame, results: DataFrame, on: list[str], payload: str = "payload") -> DataFrame:
    """Jobs with their result and, first match, why it can't be used: not complete, missing, malformed, without snippets."""
    joined = jobs.join(results, on, "left")
    doc = F.try_parse_json(payload)
    reason = (
        F.when(~F.col("status").isin("complete", "complete_with_warnings"), "job_not_complete")
        .when(F.col(payload).isNull(), "missing_result")
        .when(doc.isNull(), "malformed_json")
        .when(F.coalesce(F.json_array_length(F.get_json_object(payload, "$.snippets")), F.lit(0)) == 0, "no_snippets")
    )
    return joined.withColumn("skip_reason", reason)


def write_runs(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Appends rows of runs, one folder per run."""
    df.write.mode("append").partitionBy(by).parquet(path)
