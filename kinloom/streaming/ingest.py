"""Incremental ingestion: genotype rows arrive as a stream, and only the blocks that they touch are resolved again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinloom.functions.genotype import normalise
from kinloom.plans.pipeline import resolve
from kinloom.sources.staging import staged

PANEL_SCHEMA = "grp string, sample string, ord long, locus string, raw string"


def read_stream(spark: SparkSession, folder: str, sep: str | None = None) -> DataFrame:
    """Parquet files of (grp, sample, ord, locus, raw) as a stream of panel rows."""
    rows = spark.readStream.schema(PANEL_SCHEMA).parquet(folder)
    return rows.select("grp", "sample", "ord", "locus", normalise(F.col("raw"), sep).alias("gt"))


#: Batches after which the touched blocks are written again in one piece.
COMPACT = 20
PANEL = "sample string, ord long, locus string, gt string, grp string, batch long"


def _latest(rows: DataFrame) -> DataFrame:
    """(grp, sample, ord, locus, gt): the value of each cell that counts."""
    latest = F.min(F.struct((-F.col("batch")).alias("b"), F.col("gt").isNull().alias("none"), "gt", "ord"))
    return rows.groupBy("grp", "sample", "locus").agg(latest.alias("x")).select("grp", "sample", "x.ord", "locus", "x.gt")


def _drop_before(spark: SparkSession, panel: str, blocks: list[str], first: int) -> None:
    """Deletes the folders of blocks that are of earlier batches; they are found by the files that Spark lists."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    old = spark.read.schema(PANEL).parquet(panel).filter(F.col("grp").isin(blocks) & (F.col("batch") < first))
    system = path(panel).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {r[0].rsplit("/", 1)[0] for r in old.select("_metadata.file_path").distinct().collect()}:  # at most COMPACT folders a block
        system.delete(path(spark._jvm.java.net.URI(folder)), True)


def start(stream: DataFrame, store: str, checkpoint: str, method: str = "likelihood_ratio", **settings):
    """Each micro-batch is added to the panel under `store`, by block and batch, so that a batch that is run again
    replaces itself; only the blocks in it are read, and their assignments are written by block.

    A cell that comes again is a correction: the value of the latest batch counts, within a batch the first in string
    order (missing last).  A blank block is `unassigned`.  Micro-batch k is batch 2k; every COMPACT micro-batches what
    the touched blocks held before is written again in one piece, as batch 2k - 1, and only then are the batches before
    that deleted, so a run that is broken off and repeated finds every cell in one or the other.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        grp = F.coalesce(F.nullif(F.trim("grp"), F.lit("")), F.lit("unassigned")).alias("grp")
        own = rows.select("sample", "ord", "locus", "gt", grp, F.lit(2 * epoch).cast("long").alias("batch"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grp", "batch").parquet(f"{store}/panel")
        touched = [r[0] for r in own.select("grp").distinct().collect()]  # blocks of one micro-batch
        if not touched:
            return
        every = spark.read.schema(PANEL).parquet(f"{store}/panel").filter(F.col("grp").isin(touched))
        cells = _latest(every)
        cells = staged(cells.withColumn("ord", F.min("ord").over(W.partitionBy("grp", "sample"))), "stream-panel")
        if epoch % COMPACT == COMPACT - 1:
            before = staged(_latest(every.filter(F.col("batch") < 2 * epoch)), "stream-before")
            before.withColumn("batch", F.lit(2 * epoch - 1).cast("long")).select(*own.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grp", "batch").parquet(f"{store}/panel")
            _drop_before(spark, f"{store}/panel", touched, 2 * epoch - 1)
        found = resolve(cells, method, **settings).assignment
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grp").parquet(f"{store}/assignment")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
