"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "evgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for (UTC, AQE, Kryo-free defaults)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Only a local session without that setting (tests) gets a machine-local one; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def as_pattern(path: str) -> str:
    """path as a glob that matches it alone: file streams take a folder or a pattern, and path may be a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of few columns that are sent to all tasks at once (some 50 MB).
BROADCAST_ROWS = 1 << 19


def few(df: DataFrame, name: str) -> DataFrame:
    """df, a table of few columns, stored as the right side of a join: broadcast up to BROADCAST_ROWS, so that common keys of the left side need no task of their own; merged beyond."""
    rows = stored(df, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


#: Rows that a task of `dealt` groups by keys that hardly repeat (some 200 MB).
GROUPED_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns before it is grouped: to tasks that hold their share of `rows` in memory, and without a first grouping of unlike rows, which spills."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // GROUPED_ROWS)), *by)


def importable_by_workers(spark: SparkSession) -> None:
    """Lets local Python workers import this package wherever the driver was started; elsewhere the path does no harm."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
