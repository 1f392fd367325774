"""Session helpers: one place for the settings the package expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sitewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set and the session is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder, and this session's executors may be on other machines")
    path = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(path)
    return path


def spread(df: DataFrame, *keys: str, rows_per_task: int) -> DataFrame:
    """df dealt by keys to as many tasks as its rows ask for, so that what one task holds doesn't grow with the table.

    Counts df once, so it belongs on a table or a plain view of one, before rows are multiplied; groupings and
    windows whose keys contain these keep the partitioning.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows_per_task)), *keys)
