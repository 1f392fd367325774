"""Writers: partitioned results, whole replacements, and small sorted summaries."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewise.functions.geometry import to_geojson
from sitewise.operators.roads import road_index


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_results(results: DataFrame, path: str) -> None:
    """One row per run and case, failures included; a later row replaces the earlier one of its case only.

    Partitioned by run. Cases that `results` doesn't name stay as they are, and runs that it doesn't
    name aren't read. Null is a run, or a case, like any other. The merged runs are first written whole beside the table, so a job that dies
    while they are put in place can be run again. Columns may come and go between calls (null where
    absent). Rows that share run and case within one call are one case: the greatest by hash stays.
    """
    spark = results.sparkSession
    keys, staged = ["run", "case_id"], f"{path}.new-{uuid.uuid4().hex}"
    row = F.struct(*results.columns)
    new = results.groupBy(*keys).agg(F.max_by(row, F.xxhash64(*results.columns)).alias("_r")).select("_r.*")
    if _exists(spark, path):
        extra = [f for f in spark.read.parquet(path).schema if f.name not in results.columns]
        old = spark.read.schema(StructType([*results.schema.fields, *extra])).parquet(path)
        # Two joins, as a null-safe one would read every run's partition.
        nameless = old.where("run is null").join(results.where("run is null").select("run").limit(1).withColumnRenamed("run", "_run"), F.lit(True), "left_semi")
        old = old.join(results.select("run").distinct(), "run", "left_semi").unionByName(nameless)
        named = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
        old = old.join(named, F.col("run").eqNullSafe(F.col("_run")) & F.col("case_id").eqNullSafe(F.col("_case_id")), "left_anti")
        new = old.unionByName(new, allowMissingColumns=True)
    new.write.partitionBy("run").parquet(staged)
    merged = spark.read.schema(new.schema).parquet(staged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    _remove(spark, staged)


def write_geojson(results: DataFrame, path: str) -> None:
    """One GeoJSON text line per case with a geometry, in folders by case."""
    found = results.where(F.col("geom").isNotNull())
    found.select("case_id", to_geojson(F.col("geom")).alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a finished folder in the place of a table; the old one is put back if that fails."""
    jvm = spark.sparkContext._jvm
    target, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not put {fresh} in place of {path}")
    if fs.exists(old):
        fs.delete(old, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the target and swap. A reader sees the old or the new table, never half of one;
    between the two renames it may see none, so readers should try again."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    _swap(df.sparkSession, fresh, path)


def write_summary(summary: DataFrame, path: str, order: Sequence[str], kind: str = "json") -> None:
    """A small aggregate as one sorted file of JSON lines or CSV."""
    one = summary.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite")
    if kind == "csv":
        one.option("header", True).csv(path)
    else:
        one.json(path)


def build_road_index(spark: SparkSession, roads: DataFrame, path: str) -> None:
    """Index the named roads for lookups, by first letter; an empty index is refused."""
    index = road_index(roads).withColumn("letter", F.left("name_lc", F.lit(1)))
    staged = f"{path}.new-{uuid.uuid4().hex}"
    index.write.partitionBy("letter").parquet(staged)
    if spark.read.schema(index.schema).parquet(staged).isEmpty():
        raise RuntimeError("no named roads were found; the index is not replaced")
    _swap(spark, staged, path)
