"""Exact deduplication with a heavy-hitter split (built-in functions only).

Plan
1. every row becomes (id, digest, text_sha256); the texts go no further than the scan;
2. a Misra-Gries summary (Spark's approx_top_k, which merges frequent-item sketches) names at most ``slots``
   digests that may be frequent; any digest above about n/slots rows is among them;
3. the named digests are counted again, exactly, with map-side partial sums: the verified winners, at most
   ``slots`` rows, are broadcast, so copies of hot texts are settled where they are read and never shuffled;
4. all other digests go through an ordinary shuffle: their counts and largest ids are summed before it and joined back,
   so that no task holds a group, and none can be larger than about n/slots.

Defined results: a null text counts as empty; of rows with equal text the largest id stays, nulls being smaller
than any id; if several rows share text and that largest id, each of them is marked as kept.  Columns other than
id and text play no part and may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents, staged

#: Counters of the Misra-Gries summary, and so the bound of the broadcast table.
SLOTS = 1024


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of df."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    top = rows.select(F.hex("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {slots}, {slots * 4})").alias("t"))
    named = top.select(F.explode("t").alias("e")).filter("e.count > 1").select(F.unhex("e.item").alias("digest"))
    winners = (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    winners = staged(winners, "winners")  # at most `slots` rows
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(groups, "digest")
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
