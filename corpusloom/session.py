"""Session, table and lineage helpers that all modules share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast by :func:`small`; at about 100 bytes a row this is about 2 MB.
BROADCAST_ROWS = 20_000


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's results rest on: UTC, ANSI off-by-none defaults, adaptive execution."""
    builder = SparkSession.builder.appName("corpusloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once; they import it wherever the session was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver serves the archive from here as long as the session lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "corpusloom"), "zip", os.path.dirname(package), "corpusloom"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset and the master is local (tests), a new local one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not known and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: cuts the lineage and survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (counted, with a limit, so never more than that is read);
    else df as it is, so that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than that, as small test tables do; large inputs have more and
    are left as they are, so nothing is shuffled there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """The distinct rows of df, laid out by a key in as many partitions as shuffles have.  The number is explicit, so adaptive
    execution does not merge the partitions: what follows takes time rather than bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).distinct()


def latest(df: DataFrame, key: str, order: str = "ingested_at") -> DataFrame:
    """One row per key, the one delivered last.  Repeated deliveries of a key differ only in the time of delivery, so the
    columns are taken from one of the rows as a whole."""
    rest = [c for c in df.columns if c != key]
    if order not in rest:
        return df.dropDuplicates([key])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def unicode_strip(c: Column) -> Column:
    """strip() of Unicode white space at both ends."""
    return F.regexp_replace(c, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")
