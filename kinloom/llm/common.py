"""Small helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from kinloom.sources.staging import staged  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20
#: Most bits of the bitmaps that tasks filter with (16 MB), and the bits a value that they are folded down to: a broadcast
#: lies in a file on the driver and on each executor.
BITS, BITS_A_VALUE, LEAST_BYTES = 1 << 27, 256, 1 << 13
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; texts then go to Python in batches of at most BATCH_BYTES, however long or many they are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def hand_back() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system: a worker serves many stages, and
    what one of them freed would count beside all that the next one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(spark, values: DataFrame):
    """A broadcast bitmap of BITS bits at most, whatever the size of values (x long): no false negatives."""
    width = BITS // 256

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, dtype=bool)
        bits[pdf["bit"].to_numpy() % width] = True
        return pd.DataFrame({"block": [int(pdf["bit"].iloc[0]) // width], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    bit = values.select(F.pmod("x", F.lit(BITS)).cast("int").alias("bit")).distinct()
    out = np.zeros(BITS // 8, dtype="uint8")
    for b, bits in bit.groupBy(F.expr(f"bit div {width}")).applyInPandas(block, "block int, bits binary").collect():  # 256 rows
        out[b * width // 8 : (b + 1) * width // 8] = np.frombuffer(bits, dtype="uint8")
    return spark.sparkContext.broadcast(folded(out))


def folded(bits: np.ndarray) -> np.ndarray:
    """Halves of a bitmap laid over each other while few bits are set; a value is then at its remainder by the new length."""
    n = int(np.bitwise_count(bits).sum())
    while len(bits) > LEAST_BYTES and len(bits) * 4 >= n * BITS_A_VALUE:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def in_bitmap(bitmap, x: np.ndarray) -> np.ndarray:
    at = np.mod(x, len(bitmap.value) * 8)
    return (bitmap.value[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1


def parted(df: DataFrame, key: Column, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts by a bitmap of values (x long): rows whose key may be among them, and rows whose key is not.

    Only the first part has to be shuffled to where the values are; both have the columns of df.
    """
    held = bitmap(df.sparkSession, values)

    @F.pandas_udf(BooleanType())
    def may(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held, x.to_numpy()))

    name = fresh(df, "may")
    marked = df.withColumn(name, may(key))
    return marked.filter(F.col(name)).select(*df.columns), marked.filter(~F.col(name)).select(*df.columns)


#: Rows of a table that is broadcast at most; its rows are counted first.
MOST_BROADCAST = 100_000
#: Copies of a longer table's rows, so that one key that holds a third of all rows meets in so many tasks.
SALTS = 32


def looked_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with the other columns of table (one row a value of `on`, null being a value; staged).

    A table of MOST_BROADCAST rows or fewer is broadcast.  A longer one is joined by a shuffle in which each key is split.
    """
    key, salt = fresh(rows, "looked_key"), fresh(rows, "looked_salt")
    own = table.withColumnRenamed(on, key)
    if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(own), F.col(on).eqNullSafe(F.col(key))).drop(key)
    spread = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    own = own.withColumn(salt + "_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(own, F.col(on).eqNullSafe(F.col(key)) & (F.col(salt) == F.col(salt + "_"))).drop(key, salt, salt + "_")


def whole_vectors(df: DataFrame, vector_col: str, *others: Column) -> DataFrame:
    """(others..., v array<double>): rows whose vector is there, without nulls or non-finite components, and as long as
    most such vectors are (of lengths that are equally frequent, the shorter)."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.filter(v.isNotNull() & (F.size(v) > 0) & ~bad).select(*others, v.alias("v"))
    top = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (top["n"] if top else 0))
