"""Sharding by sampled splitters: shards of near equal bytes, equal texts side by side.

Plan
1. each row gets a 63-bit key: 40 bits of its text's hash, then 23 bits of its id's hash, so that equal texts lie
   together and a text that fills a third of the table can still be cut;
2. a size-weighted sample of keys (weighted reservoir: the rows with the largest log(u)/size, u from a hash of the
   row) is drawn with one bounded top-k; its quantiles are the splitters of the fine ranges;
3. ranges that come out over twice their share are subdivided by a second sample from inside them; a range begins with
   a text, unless that text is a large group;
4. groups of equal texts over a ``LARGE``-th of a shard, of which there are at most shards times ``LARGE``, go first: the
   largest that is left to the shard with most room, whole.  Only a group that fits nowhere is cut;
5. all other rows fill what room is left, in key order: the bytes before each range, a table of a few thousand rows at
   most, turn a running sum inside a range into a place in that order.  A group goes where its middle is, so a shard
   misses its share by less than a ``LARGE``-th of it or a row.

Law ``bytes``: sizes of shards are near equal, and groups are whole wherever one can be.

Defined results: a null text has no bytes, so size 1 and CRC 0; null ids are allowed; repeated rows each get a slot
of their own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, staged

#: Sampled keys for each fine range.
PER_RANGE = 16
MAX_RANGES = 4096
ROWS_A_RANGE = 20_000
#: Groups of equal texts over this part of a shard are dealt one by one.
LARGE = 400
#: Bits of a key that tell rows of one text apart.
LOW = (1 << 23) - 1


def _sample(rows: DataFrame, n: int, seed: int) -> list[int]:
    """n keys, each row's chance in proportion to its size."""
    u = (F.abs(F.xxhash64(F.lit(seed), "key", "id") % F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    top = rows.select("key", (F.log(u) / F.col("size")).alias("w")).orderBy(F.desc("w"), "key").limit(n)
    return sorted(r[0] for r in top.select("key").collect())


def _quantiles(keys: list[int], parts: int) -> list[int]:
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _placed(rows: DataFrame, value: str, cuts: list[int], name: str) -> DataFrame:
    """rows with a column that says how many of the ascending cuts are not over the value."""
    held = np.array(cuts, dtype="int64")

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, x.to_numpy(), side="right").astype("int32"))

    return rows.withColumn(name, place(value))


def _deal(groups: list[tuple[int, int]], shards: int, share: int) -> tuple[dict[int, int], list[int]]:
    """(digest -> shard, or -1 for a group that fits nowhere; room left in each shard) for large groups (digest, bytes)."""
    room, given = [share] * shards, {}
    for digest, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        k = max(range(shards), key=lambda s: (room[s], -s))
        given[digest] = k if size <= room[k] else -1
        room[k] -= size if size <= room[k] else 0
    return given, room


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of df."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(text)
    rows = staged(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            hashed.alias("digest"),
            (F.shiftleft(F.shiftrightunsigned(hashed, 24), 23).bitwiseOR(F.xxhash64(F.lit(7), F.col(id_col)).bitwiseAND(F.lit(LOW)))).alias("key"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1, -(-int(total) // shards))
    large = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * LARGE > share)
    given, room = _deal([(r[0], r[1]) for r in large.collect()], shards, share)  # shards * LARGE rows at most
    split = {(d & ((1 << 64) - 1)) >> 24 for d in given}

    def aligned(keys) -> list[int]:
        return sorted({k if k >> 23 in split else k & ~LOW for k in keys})

    fine = ranges or min(MAX_RANGES, max(shards * 8, n // ROWS_A_RANGE))
    splitters = aligned(_quantiles(_sample(rows, fine * PER_RANGE, 1), fine))
    for attempt in range(3):  # subdivide what is over twice its share
        sizes = {r[0]: r[1] for r in _placed(rows, "key", splitters, "range").groupBy("range").agg(F.sum("size")).collect()}
        over = [k for k, v in sizes.items() if v > 2 * total / fine]
        if not over or attempt == 2:
            break
        inside = _placed(rows, "key", splitters, "range").filter(F.col("range").isin(over))
        drawn, more = _sample(inside, max(PER_RANGE * 4 * len(over), 64), 2 + attempt), set(splitters)
        for k in over:
            own = [x for x in drawn if bisect.bisect_right(splitters, x) == k]
            more.update(aligned(_quantiles(own, 2 + int(2 * sizes[k] * fine / max(total, 1)))))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)

    table = spark.createDataFrame(sorted(given.items()), "digest long, given int")
    placed = _placed(rows, "key", splitters, "range").join(F.broadcast(table), "digest", "left")
    whole = placed.filter("given >= 0").withColumn("shard", F.col("given"))
    loose = placed.filter("given is null or given < 0")
    before, starts = 0, []
    for k, size in sorted((r[0], r[1]) for r in loose.groupBy("range").agg(F.sum("size")).collect()):
        starts.append((k, before))
        before += size
    starts = spark.createDataFrame(starts, "range int, before long")  # one row a range
    order = W.partitionBy("range").orderBy("key", "digest", "id", "size")
    own = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    group = W.partitionBy("range", "digest")
    run = loose.withColumn("own", own).withColumns({"first": F.min("own").over(group), "bytes": F.sum("size").over(group)})
    middle = F.when(F.col("given").isNull(), F.expr("first + bytes div 2")).otherwise(F.expr("own + size div 2"))
    at = F.col("before") + middle
    run = run.join(F.broadcast(starts), "range").withColumn("at", at)
    loose = _placed(run, "at", np.cumsum(room)[:-1].tolist(), "shard")
    columns = ("id", "size", "text_crc32", "key", "digest", "range", "shard")
    sharded = staged(whole.select(*columns).unionByName(loose.select(*columns)), "sharded")
    counts = sorted((r["shard"], r["range"], r["count"]) for r in sharded.groupBy("shard", "range").count().collect())
    seen: dict[int, int] = {}
    offsets = []
    for shard, rng, c in counts:
        offsets.append((shard, rng, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + c
    offsets = spark.createDataFrame(offsets, "shard int, range int, base long")
    nth = F.row_number().over(W.partitionBy("range", "shard").orderBy("key", "digest", "id", "size"))
    return (
        sharded.withColumn("nth", nth)
        .join(F.broadcast(offsets), ["shard", "range"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def query(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir))
