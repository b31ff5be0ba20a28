"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only where none is named and all runs on one machine."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if not held:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinloom-"))
        held = context.getCheckpointDir()
    return held


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage is cut, and lost executors lose nothing."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of a table that is broadcast: as guessed from its file before a query runs, and as measured in a shuffle.
GUESSED_BYTES, MEASURED_BYTES = 1024, 1024 * 1024


def measured_joins(spark: SparkSession) -> None:
    """Has the session broadcast tables for joins by the size measured in their shuffle.

    A guess from files is far too low for a panel, a row a locus made from one of a file, and for a staged table: one of
    a few rows a block and locus, under 256 kB as a file, was 31 MB as a hash table, and a table guessed at 10 MB (Spark's
    limit) fills the driver, which keeps what it has built until it collects its garbage.  So only what has a row or so
    goes by a guess (no file of many rows is so short).  Lower limits of the session stay.
    """
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    held = spark.conf.get(guessed)
    size = -1 if held.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held)
    if size > GUESSED_BYTES:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, f"{min(size, MEASURED_BYTES)}b")
        spark.conf.set(guessed, f"{GUESSED_BYTES}b")
    # rows that lie by their block already stay there when they are joined by the block and more: cells are not shuffled
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Rows of a staged table that is named as the broadcast side of a join at most: numbers, a few MB as a hash table.
FEW_ROWS = 50_000


def few(df: DataFrame) -> DataFrame:
    """A staged table, named as the broadcast side of joins if it has few rows, so that a table of pairs is not shuffled
    to meet a row a block; the rows are counted, as its file tells nothing of its size."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def clear_staged(spark: SparkSession) -> None:
    """Deletes all tables staged by this application; results that still read them must have been written before."""
    jvm, path = spark._jvm, _folder(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
