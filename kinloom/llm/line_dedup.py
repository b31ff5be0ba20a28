"""Line deduplication by range-partitioned hashes; the result is one compressed keep bitmap for each document.

Plan
1. every line whose key (ASCII white space stripped at both ends, A-Z lower-cased) has at least ``min_chars`` code
   points becomes a row (128-bit hash, id, text hash, position, number of lines); no text is shuffled;
2. rows are range-partitioned by (hash, id descending) and sorted by (hash, id descending, position), so one very
   common line is spread over as many partitions as it needs;
3. each partition is streamed once: the first id of a run holds the line, at most ``min_docs`` - 1 further documents
   wait in memory, all later lines are dropped as they pass.  Only a partition's first and last run can reach into
   another partition; two summary rows a partition settle them;
4. dropped positions, grouped by document, become zlib-compressed bitmaps, one bit a line;
5. texts without a dropped line are told by a bitmap of text hashes and are never shuffled; the others are, once.

Defined results: null and empty texts are one empty line; a null id counts as one document, smaller than any other;
rows that repeat an id are one document for the counts, and each keeps or loses its own lines; an empty table gives
an empty result; columns other than id and text may have any name.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import ascii_lower, documents, fresh, parted, shuffle_width, staged

SPACE = " \t\n\x0b\x0c\r"
DROP, OPEN, EDGE = 0, 1, 2


def _base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _stream(min_docs: int):
    """A partition's rows, in order, to (kind, h1, h2, id, th, pos, lines, n)."""

    def run(batches):
        rows = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "id", "th", "pos", "lines"))) for b in batches)
        out: list[tuple] = []
        first, ended = True, None
        for (h1, h2), run_ in itertools.groupby(rows, lambda r: (r[0], r[1])):
            if ended:  # the run before this one was not the last; if it was the first, others may hold a part of it
                if ended[1]:
                    out.append(ended[0])
                ended = None
            docs, last, waiting, top = 0, object(), [], None
            for _, _, doc, th, pos, lines in run_:
                if doc != last:
                    docs, last = docs + 1, doc
                    if docs == 1:
                        top = doc
                if first:
                    out.append((OPEN, h1, h2, doc, th, pos, lines, 0))
                elif docs > 1:
                    if docs >= min_docs:
                        out += [(DROP, h1, h2, *w, 0) for w in waiting]
                        waiting = []
                        out.append((DROP, h1, h2, doc, th, pos, lines, 0))
                    else:
                        waiting.append((doc, th, pos, lines))
                if len(out) >= 20_000:
                    yield _frame(out)
                    out = []
            ended = ((EDGE, h1, h2, top, 0, 0, 0, docs), first, waiting)
            first = False
        if ended:
            out += [ended[0], *((OPEN, *ended[0][1:3], *w, 0) for w in ended[2])]
        yield _frame(out)

    return run


SCHEMA = "kind int, h1 long, h2 long, id long, th long, pos int, lines int, n long"


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in map(str.split, SCHEMA.split(", "))]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[name for name, _ in kinds])


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, th, pos, lines) of each line that goes; lines: how many its document has."""
    # the text is cut once, below the explode: nothing of it is worked out for each line or to leave empty lists out
    cut = _base(df, id_col, text_col).select("id", "th", F.split("text", "\n", -1).alias("parts")).select("id", "th", F.size("parts").alias("lines"), "parts")
    keys = (
        cut.select("id", "th", "lines", F.posexplode_outer("parts").alias("pos", "line"))
        .filter(F.char_length("line") >= min_chars)
        .select("id", "th", "pos", "lines", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key", F.char_length("key")).alias("h2"), "id", "th", "pos", "lines")
    )
    lines = staged(keys, "lines")
    newest = F.col("id").desc_nulls_last()
    dealt = lines.repartitionByRange(shuffle_width(df.sparkSession), "h1", "h2", newest).sortWithinPartitions("h1", "h2", newest, "pos")
    settled = staged(dealt.mapInArrow(_stream(min_docs), SCHEMA), "line-runs")
    edges = settled.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("id").alias("top"))
    edges = edges.filter(F.col("docs") >= min_docs).select("h1", "h2", "top")  # at most two rows a partition
    late = settled.filter(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("top")))
    columns = ("id", "th", "pos", "lines")
    return settled.filter(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for n, g in zip(n_lines, gone):
        bits = np.ones(int(n), dtype=bool)
        if g is not None and len(g):
            bits[np.asarray(g, dtype="int64")] = False
        out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def _kept(bitmap: pd.Series, n_lines: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(b), dtype="uint8"), count=int(n))).astype("int32") for b, n in zip(bitmap, n_lines)], dtype=object)


def line_keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, th, n_lines, n_dropped, keep_bitmap) of the documents that lose a line; th is the text's hash."""
    gone = dropped_lines(df, id_col, text_col, min_chars, min_docs).groupBy("id", "th").agg(F.collect_set("pos").alias("gone"), F.max("lines").cast("long").alias("n_lines"))
    return gone.select("id", "th", "n_lines", F.size("gone").cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep_bitmap"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with its text column reduced to the lines kept; count_col: a new column with the number of lines dropped."""
    bitmaps = staged(bitmaps, "bitmaps")
    bid, bth, dropped, stay, own = (fresh(df, c) for c in ("line_id", "line_th", "line_dropped", "line_stay", "line_own"))
    b = bitmaps.select(F.col("id").alias(bid), F.col("th").alias(bth), F.col("n_dropped").alias(dropped), _kept("keep_bitmap", "n_lines").alias(stay))
    text = F.coalesce(F.col(text_col), F.lit(""))
    near, rest = parted(df.withColumn(own, F.xxhash64(text)), F.col(own), bitmaps.select(F.col("th").alias("x")))
    # bitmaps grow with the table, so this join is the same at every size
    joined = near.join(b.hint("merge"), F.col(id_col).eqNullSafe(F.col(bid)) & (F.col(own) == F.col(bth)), "left")
    # the outer transform holds the lines of a text, so that each is looked up and the text is cut once
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(F.col(stay), lambda i: F.get(lines, i)), "\n"))[0]
    cut = joined.withColumn(text_col, F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(kept))
    number = lambda c: [F.coalesce(c, F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return cut.select(*df.columns, *number(F.col(dropped))).unionByName(rest.select(*df.columns, *number(F.lit(0))))


def dedup_lines(df: DataFrame, **kw) -> DataFrame:
    """df with repeated lines taken out; its columns are those of df."""
    return apply_bitmaps(df, line_keep_bitmaps(df, **kw))


def query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    kept = apply_bitmaps(counted, line_keep_bitmaps(docs), count_col="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, p AS pos, ls[p] AS line,
         translate(trim(ls[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM docs)),
common AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND l.doc_id <> c.top) AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, sum(gone::BIGINT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
