"""Repeated-substring removal: distributed prefix doubling over a synchronising set of positions.

A byte goes if it lies in a ``SPAN``-byte string that also starts earlier (smaller id, or earlier in the document).
Ranking every byte position would shuffle many times the input, so ranks are kept for anchors only: of the 32-byte
strings in a SPAN-byte window the one with the least hash (the leftmost of equal ones) is the window's anchor.  Equal
windows have the same anchor at the same distance, so windows need only be compared within an anchor's rank.

1. rank anchors by their 32 bytes: a scan, a count with partial sums; anchors of rank one are unique, and so are all
   their windows, and they leave;
2. anchors that repeat are dealt and sorted by rank; a task ranks, at growing offsets from the anchor (32 to 64 bytes
   by doubling, then the rest of the span), all windows that belong to it and marks those that are not the first;
3. a rank with more than ``HOT`` anchors is dealt in salted parts: what is not first in its part is settled, the
   part's first windows go to a second round, ranked by the longer string that a block of 17 offsets has in common.

Marked windows come back as byte intervals of documents; only documents that lose bytes are shuffled, once, to be cut.

Defined results: null and empty texts have no bytes; a null id is smaller than any other; rows that repeat an id count
as one document, so that equal positions are not earlier than each other; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import bitmap, bounded_batches, documents, in_bitmap, shuffle_width, staged

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM  # an anchor starts at most this far into its window
CONTEXT = REACH + SPAN
BLOCK = 17
HOT = 2000
SALT = 256
PIECE = 500_000
NULL_ID = -(1 << 63)

_U = np.uint64
_POS = _U((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype="int64").view("uint64")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int):
    size = 1 << max(19, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, dtype="uint64"), np.full(size, _INVERSE, dtype="uint64")
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM bytes at each position, and for each SPAN-byte window the position of its anchor."""
    n = len(data)
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype="uint64"), np.cumsum(_BYTE[data] * up[:n])])
        gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    key = (gram & ~_POS) | np.arange(len(gram), dtype="uint64")
    least, width = key, 1
    while width * 2 <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return gram, (least & _POS).astype("int64")


def _pieces(batch):
    """(rows, document of each byte's start, data): stretches of whole texts, or of parts of a very long one.

    Yields (data, starts, ends, rows, shift): text rows[k] fills data[starts[k]:ends[k]], which begins at byte
    shift[k] of the text.
    """
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype="int64")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype="uint8") if texts.buffers()[2] is not None else np.empty(0, dtype="uint8")
    k = 0
    while k < len(texts):
        if offsets[k + 1] - offsets[k] > PIECE:
            for at in range(offsets[k], offsets[k + 1] - SPAN + 1, PIECE):
                end = min(offsets[k + 1], at + PIECE + SPAN - 1)
                # context on both sides stays with the piece
                lo, hi = max(offsets[k], at - REACH), min(offsets[k + 1], end + SPAN)
                yield raw[lo:hi], np.array([at - lo]), np.array([end - lo]), np.array([k]), np.array([lo - offsets[k]])
            k += 1
            continue
        last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, side="right")) - 1)
        last = min(last, len(texts))
        base = offsets[k]
        yield raw[base : offsets[last]], offsets[k:last] - base, offsets[k + 1 : last + 1] - base, np.arange(k, last), base - base + -(offsets[k:last] - base)
        k = last


def _runs(data, starts, ends):
    """Anchor runs: (text index, anchor, first window, last window, rank) by position in data."""
    if len(data) < SPAN:
        return None
    gram, anchor = anchors(data)
    long = ends - starts >= SPAN
    if not long.any():
        return None
    first, count = starts[long], ends[long] - starts[long] - SPAN + 1
    owner = np.repeat(np.flatnonzero(long), count)
    window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    a = anchor[window]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])
    stop = np.r_[new[1:], len(a)] - 1
    return owner[new], a[new], window[new], window[stop], gram[a[new]].view("int64")


def _ranks(batches):
    for b in batches:
        for data, starts, ends, _, _ in _pieces(b):
            found = _runs(data, starts, ends)
            if found:
                yield pa.record_batch([pa.array(found[4])], names=["rank"])


def _contexts(repeated, hot):
    """One row for each anchor run of a repeated rank, with the bytes around the anchor."""

    def run(batches):
        for b in batches:
            ids = b.column("id").fill_null(NULL_ID).to_numpy()
            th = b.column("th").to_numpy()
            for data, starts, ends, rows, shift in _pieces(b):
                found = _runs(data, starts, ends)
                if not found:
                    continue
                take = np.flatnonzero(in_bitmap(repeated, found[4]))
                for lo in range(0, len(take), 10_000):
                    owner, a, first, last, rank = (x[take[lo : lo + 10_000]] for x in found)
                    around = data[np.clip(a[:, None] + np.arange(-REACH, SPAN), 0, len(data) - 1)]
                    offs = pa.py_buffer((np.arange(len(a) + 1) * CONTEXT).astype("int32"))
                    context = pa.Array.from_buffers(pa.binary(), len(a), [None, offs, pa.py_buffer(np.ascontiguousarray(around))])
                    r = rows[owner]
                    salt = np.where(in_bitmap(hot, rank), np.mod(ids[r] * 7919 + a, SALT) + 1, 0).astype("int32")
                    columns = [rank, salt, ids[r], th[r], a + shift[owner], (a - last).astype("int32"), (a - first).astype("int32")]
                    yield pa.record_batch([*map(pa.array, columns), context], names=["rank", "salt", "id", "th", "at", "near", "far", "context"])

    return run


CONTEXT_SCHEMA = "rank long, salt int, id long, th long, at long, near int, far int, context binary"
MARK_SCHEMA = "id long, th long, start long, stop long, rank long, at long, near int, far int, context binary"


def window_names(context: np.ndarray) -> np.ndarray:
    """Name of the window at each distance 0..REACH before the anchor, by doubling: 1, 2, 4 ... 64 bytes, then SPAN."""
    with np.errstate(over="ignore"):
        name, width = _BYTE[context], 1
        while width * 2 <= SPAN:
            name = _mixed(name[:, :-width] * _U(0xD6E8FEB86659FD93) + name[:, width:])
            width *= 2
        rest = SPAN - width
        name = _mixed(name[:, : name.shape[1] - rest] * _U(0xC2B2AE3D27D4EB4F) + name[:, rest:])
    return name[:, ::-1]  # column d: the window that starts d bytes before the anchor


def _settle(rank, salt, ids, at, near, far, context):
    """For each row and distance: does the window belong to the row, and is it not the first of its kind here?"""
    names = window_names(context)
    distance = np.arange(REACH + 1)
    own = (distance >= near[:, None]) & (distance <= far[:, None])
    row, d = np.nonzero(own)
    with np.errstate(over="ignore"):
        key = _mixed(names[row, d] ^ (rank[row].view("uint64") * _U(0x9E3779B97F4A7C15) + salt[row].astype("uint64")))
    who, where = ids[row], at[row] - d
    order = np.lexsort((where, who, key))
    key, who, where = key[order], who[order], where[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lens = np.diff(np.r_[head, len(key)])
    late = (who != np.repeat(who[head], lens)) | (where != np.repeat(where[head], lens))
    out = np.zeros_like(own)
    out[row[order], d[order]] = late
    return own, out


def _intervals(late: np.ndarray):
    """(row, nearest distance, farthest distance) of each run of marked distances."""
    padded = np.zeros((len(late), REACH + 3), dtype="int8")
    padded[:, 1:-1] = late
    step = np.diff(padded, axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, begin, end - 1


def _marks(second: bool):
    """Streams sorted anchor rows; yields byte intervals, and (first round, salted) anchors that are still open."""

    def emit(rows):
        rank, salt, ids, th, at, near, far = (np.concatenate([r[c] for r in rows]) for c in range(7))
        context = np.concatenate([r[7] for r in rows])
        own, late = _settle(rank, salt, ids, at, near, far, context)
        row, d1, d2 = _intervals(late)
        none = pa.nulls(len(row), pa.int64())
        yield pa.record_batch(
            [*map(pa.array, (ids[row], th[row], at[row] - d2, at[row] - d1 + SPAN)), none, none, none.cast(pa.int32()), none.cast(pa.int32()), pa.nulls(len(row), pa.binary())],
            names=["id", "th", "start", "stop", "rank", "at", "near", "far", "context"],
        )
        if second or not salt.any():
            return
        open_ = own & ~late & (salt > 0)[:, None]
        for lo in range(0, REACH + 1, BLOCK):
            hi = min(lo + BLOCK - 1, REACH)
            r = np.flatnonzero(open_[:, lo : hi + 1].any(axis=1))
            if not len(r):
                continue
            # what all windows of the block have in common, from hi to lo + SPAN around the anchor
            core = context[r][:, REACH - lo : REACH - hi + SPAN]
            with np.errstate(over="ignore"):
                up, _ = _power_tables(core.shape[1])
                name = _mixed((_BYTE[core] * up[: core.shape[1]]).sum(axis=1, dtype="uint64") + rank[r].view("uint64") * _U(lo + 3)).view("int64")
            offs = pa.py_buffer((np.arange(len(r) + 1) * CONTEXT).astype("int32"))
            bytes_ = pa.Array.from_buffers(pa.binary(), len(r), [None, offs, pa.py_buffer(np.ascontiguousarray(context[r]))])
            none = pa.nulls(len(r), pa.int64())
            columns = [ids[r], th[r]], [name, at[r], np.maximum(near[r], lo).astype("int32"), np.minimum(far[r], hi).astype("int32")]
            yield pa.record_batch([*map(pa.array, columns[0]), none, none, *map(pa.array, columns[1]), bytes_], names=["id", "th", "start", "stop", "rank", "at", "near", "far", "context"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy() for c in ("rank", "salt", "id", "th", "at", "near", "far")]
            raw = b.column("context").cast(pa.binary())
            first = np.frombuffer(raw.buffers()[1], dtype="int32")[raw.offset]
            columns.append(np.frombuffer(raw.buffers()[2], dtype="uint8")[first : first + b.num_rows * CONTEXT].reshape(-1, CONTEXT))
            held.append(columns)
            size += b.num_rows
            if size >= 8_000:
                # a rank stays together; salted parts may be cut anywhere in the first round
                rank, salt = columns[0], columns[1]
                cut = len(rank)
                if second or not salt[-1]:
                    same = (rank == rank[-1]) & (salt == salt[-1])
                    cut = int(np.argmax(same)) if same.any() else cut
                    if cut == 0:
                        continue
                yield from emit([*held[:-1], [c[:cut] for c in columns]])
                held, size = ([[c[cut:] for c in columns]], len(rank) - cut) if cut < len(rank) else ([], 0)
        if held:
            yield from emit(held)

    return run


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): the byte intervals of each document that go, neither sorted nor merged; null ids are NULL_ID."""
    spark = df.sparkSession
    texts = _texts(df, id_col, text_col)
    width = shuffle_width(spark)
    counted = staged(texts.select("text").mapInArrow(_ranks, "rank long").groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1"), "ranks")
    repeated = bitmap(spark, counted.select(F.col("rank").alias("x")))
    hot = bitmap(spark, counted.filter(F.col("n") > HOT).select(F.col("rank").alias("x")))
    rows = texts.mapInArrow(_contexts(repeated, hot), CONTEXT_SCHEMA)
    dealt = rows.repartition(width, "rank", "salt").sortWithinPartitions("rank", "salt")
    marks = staged(dealt.mapInArrow(_marks(False), MARK_SCHEMA), "marks")
    again = marks.filter("rank is not null").select("rank", F.lit(0).alias("salt"), "id", "th", "at", "near", "far", "context")
    late = again.repartition(width, "rank").sortWithinPartitions("rank").mapInArrow(_marks(True), MARK_SCHEMA)
    spans = marks.filter("rank is null").select("id", "th", "start", "stop").unionByName(late.select("id", "th", "start", "stop"))
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _texts(df, id_col, text_col):
    return bounded_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _merged(spans: np.ndarray) -> np.ndarray:
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.r_[new[1:], len(spans)] - 1]], axis=1)


def _cut(keep_bytes: bool):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("spans")):
                flat = spans.values
                merged = _merged(np.stack([flat.field("start").to_numpy(), flat.field("stop").to_numpy()], axis=1))
                keep = np.ones(len(text), dtype=bool)
                for start, stop in merged.tolist():
                    keep[start:stop] = False
                kept = np.frombuffer(text, dtype="uint8")[keep].tobytes()
                out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row of df; kept: the bytes that stay."""
    spark = df.sparkSession
    spans = staged(repeated_spans(df, id_col, text_col), "spans").withColumnsRenamed({"id": "__id", "th": "__th"})
    touched = bitmap(spark, spans.select(F.col("__th").alias("x")))

    @F.pandas_udf(BooleanType())
    def may(th: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(touched, th.to_numpy()))

    texts = _texts(df, id_col, text_col).withColumn("may", may("th"))
    same = (F.coalesce("id", F.lit(NULL_ID)) == F.col("__id")) & (F.col("th") == F.col("__th"))
    near = texts.filter("may").join(spans, same, "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = near.filter("spans is not null").select("id", "text", "spans").mapInArrow(_cut(keep_bytes), schema)
    whole = texts.filter("not may").select("id", "text").unionByName(near.filter("spans is null").select("id", "text"))
    raw = F.col("text").cast("binary")
    whole = whole.select(
        "id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"),
        (raw if keep_bytes else F.lit(None).cast("binary")).alias("kept"),
    )
    return cut.unionByName(whole).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return dedup_substrings(documents(spark, sf_dir), keep_bytes=False).drop("kept")
