"""Resumable runs: what is left to do, what may be reused, and which slice is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def todo(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.join(done.select(key), key, "left_anti")


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of an earlier run; none where it has not written anything yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_missing(cases: DataFrame, path: str, key: str = "case_id") -> None:
    """Append the rows whose key is not in the output yet."""
    done = existing(cases.sparkSession, path, cases.schema)
    todo(cases, done, key).write.mode("append").parquet(path)


def reusable(force: bool, retry_failed: bool, enable_critic: bool) -> Column:
    """True where the previous row stands. Needs prev_status, had_critic and outcome_status.

    Not on a forced run, not for crashed cases on a retry, and not across modes, apart from
    district lookups and cases without a prediction, which do not depend on the mode.
    """
    had = F.coalesce(F.col("had_critic"), F.lit(False))
    district = F.coalesce(F.col("outcome_status") == "district_lookup", F.lit(False))
    nothing = (F.col("prev_status") == "no_prediction") & ~had
    mismatch = (had != F.lit(enable_critic)) & ~district & ~nothing
    return (
        F.when(F.lit(force) | F.col("prev_status").isNull(), False)
        .when(F.lit(retry_failed) & (F.col("prev_status") == "crashed"), False)
        .otherwise(~mismatch)
    )


def cache_decision(cases: DataFrame, previous: DataFrame, force=False, retry_failed=False, enable_critic=False) -> DataFrame:
    """case_id, reuse."""
    joined = cases.join(previous, "case_id", "left")
    return joined.select("case_id", reusable(force, retry_failed, enable_critic).alias("reuse"))


def case_slice(
    cases: DataFrame, offset: int = 0, limit: int | None = None, only: Sequence[str] | None = None, key: str = "case_id"
) -> DataFrame:
    """Cases in name order from `offset` on, at most `limit`; exact names override both.

    The skipped part is found as one boundary key, so what follows stays a distributed filter.
    """
    if only:
        return cases.where(F.col(key).isin(*only))
    rows = cases
    if offset:
        edge = cases.select(key).orderBy(key).limit(offset).agg(
            F.max(key).alias("_edge"), F.count("*").alias("_n")
        ).withColumn("_k", F.lit(0))
        rows = rows.withColumn("_k", F.lit(0)).join(F.broadcast(edge), "_k").where(F.col(key) > F.col("_edge"))
        rows = rows.select(*cases.columns)
    return rows.orderBy(key).limit(limit) if limit else rows
