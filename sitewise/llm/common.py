"""Helpers the operators share: words, fresh column names, tables in the shared folder, fold of a row."""

from __future__ import annotations

import pickle
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.session import checkpoint_dir

# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """True for the fold no label is learnt from; a row without an id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def content_key(doc_id: Column, text: Column) -> Column:
    """60 uniform bits of the row's id and text, not negative: the same on every run, and in SQL."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("bigint")


KEY_BITS = 60
KEY_SQL = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def settle(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared folder and read again: cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a settled table that a later one has replaced."""
    spark = df.sparkSession
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/settled-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a bounded value, its classes with it: executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent: Broadcast):
    return pickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
