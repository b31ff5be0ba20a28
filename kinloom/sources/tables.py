"""Readers and sinks of genotype tables."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.sources.staging import staged


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, order_col: str | None = None) -> DataFrame:
    """CSV, TSV/TXT or Excel; every column of a text file is a string, `NA` is null, column names are trimmed.

    order_col: a new column with the place of each row in the file, from 1.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        import pandas as pd

        try:
            frame = pd.read_excel(path, sheet_name=sheet)
        except ImportError as e:
            raise ImportError("reading Excel sheets needs openpyxl (xlsx) or xlrd (xls)") from e
        frame = frame.astype(object).where(frame.notna(), None)
        if order_col:
            frame[order_col] = range(1, len(frame) + 1)
        df = spark.createDataFrame(frame)
        return df.toDF(*map(_trimmed, df.columns))
    sep = "\t" if kind in ("tsv", "txt") else ","
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, nullValue="NA", encoding="UTF-8", quote='"', escape='"')
    names = [*map(_trimmed, df.columns)]
    if not order_col:
        return df.toDF(*names)
    # a block of a file is read by one task from its start to its end; the blocks before it say how many rows come first
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = staged(rows.toDF(*(f"c{k}" for k in range(len(names))), "file", "block", "at"), "rows")
    blocks, before = [], 0
    for r in rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "block").toLocalIterator():  # a row a block
        blocks.append((r["file"], r["block"], before - r["first"] + 1))
        before += r["n"]
    shift = spark.createDataFrame(blocks, "file string, block long, shift long")
    return rows.join(shift, ["file", "block"]).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), (F.col("at") + F.col("shift")).alias(order_col))


def _trimmed(name: str) -> str:
    return name.lstrip("\ufeff").strip()


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """single: one file, for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_parquet(tables: dict[str, DataFrame], folder: str) -> None:
    """The whole result, one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_bundle(tables: dict[str, DataFrame], settings: dict, path: str) -> str:
    """Report tables and settings.txt in one zip file on the driver (reports are small by nature), row by row; where no
    zip file can be made, all of them one after the other in a text file instead.  Returns the path of the file."""
    stem = path.removesuffix(".zip")
    try:
        return _zipped(tables, settings, stem + ".zip")
    except (OSError, RuntimeError, zipfile.LargeZipFile):  # a file system that cannot seek, no compression
        with open(stem + ".txt", "w", encoding="utf-8", newline="") as text:
            for name, df in tables.items():
                text.write(f"##### {name} #####\n")
                _rows(df, text)
                text.write("\n")
            text.write("##### settings #####\n" + settings_text(settings))
        return stem + ".txt"


def _rows(df: DataFrame, text) -> None:
    out = csv.writer(text, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows(df.toLocalIterator())


def _zipped(tables: dict[str, DataFrame], settings: dict, path: str) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, df in tables.items():
            with bundle.open(f"{name}.csv", "w", force_zip64=True) as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
                _rows(df, text)
        bundle.writestr("settings.txt", settings_text(settings))
    return path


def settings_text(settings: dict) -> str:
    width = max(map(len, settings), default=0)
    return "".join(f"{k.ljust(width)} : {', '.join(map(str, v)) if isinstance(v, (list, tuple)) else v}\n" for k, v in settings.items())


def script_text(path: str, method: str, settings: dict) -> str:
    """A PySpark script that repeats a run, replicates, separator and prior included."""
    args = "".join(f"    {k}={v!r},\n" for k, v in settings.items())
    return f"from kinloom.plans.pipeline import identify\n\nresult = identify(\n    spark,\n    {path!r},\n    method={method!r},\n{args})\nresult.assignment.show()\n"


def suffix_duplicates(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """Ids that occur more than once get #1, #2 ... in row order; a missing id is called NA."""
    from pyspark.sql import Window as W

    df = df.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.lit("NA")))
    nth = F.row_number().over(W.partitionBy(id_col).orderBy(order_col))
    many = F.count("*").over(W.partitionBy(id_col)) > 1
    return df.withColumn(id_col, F.when(many, F.concat_ws("#", F.col(id_col), nth)).otherwise(F.col(id_col)))
