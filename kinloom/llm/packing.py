"""Sequence packing by minimum bin slack.

Each partition of documents is tokenised, cut into pieces of at most ``capacity`` tokens and packed on its own: only
the counts of piece lengths matter, so a bitset subset-sum programme over the remaining lengths finds the multiset
that fills the next window closest to capacity; the backtracked counts say which lengths it holds, and the same
pattern is used again while its lengths last.  Pieces are packed in blocks of ``BLOCK_TOKENS``; the pieces of windows
that even the best multiset leaves with over ``capacity`` / 256 tokens of slack are cut once more and fill windows to
the brim, and what is less than a window goes on to the next block, so one window a partition ends up padded.
Nothing is shuffled and no state outlives a task, so a lost executor costs its own partitions only.

Token ids are those of the tokenizer file, whose added tokens (<|endoftext|>) are cut from the text first; words are
looked up in a bounded cache of packed ids (pre-tokens of this byte-level vocabulary never span a space before a
non-space character, so each such chunk stands alone).

Defined results: a null or empty text is the end token alone; each row is packed, repeated ones too; null ids are
carried; a sequence whose length is a power of two has no padding; an empty table gives an empty result; columns other
than id and text may have any name.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, hand_back

CAPACITY = 2048
END_ID = 1
CACHE_WORDS = 50_000
#: Tokens that a task holds at a time, four bytes each.
BLOCK_TOKENS = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


def fill_window(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset with the largest length whose sum comes closest to capacity without passing it.

    lengths: the keys of counts, ascending.  Bit s of `reach` says that s can be filled with the lengths tried so
    far; each layer remembers what was reachable before it, which is enough to walk back.
    """
    top = lengths[-1]
    room = capacity - top
    reach, layers, full = 1, [], 1 << room
    mask = (1 << (room + 1)) - 1
    for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        if reach & full:
            break
        size = lengths[i]
        left = min(counts[size] - (size == top), room // size)
        copies = 1
        while left > 0 and not reach & full:
            copies = min(copies, left)
            layers.append((size, copies, reach))
            reach |= (reach << size * copies) & mask
            left -= copies
            copies *= 2
    best = reach.bit_length() - 1
    used = Counter({top: 1})
    for size, copies, before in reversed(layers):
        if not before >> best & 1:
            used[size] += copies
            best -= size * copies
    return dict(used)


def pack_lengths(counts: dict[int, int], capacity: int):
    """Yields (pattern, times) until counts is empty."""
    counts = {k: v for k, v in counts.items() if v}
    lengths = sorted(counts)
    while lengths:
        used = fill_window(counts, lengths, capacity)
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
                lengths.pop(bisect.bisect_left(lengths, k))
        yield used, times


def _place(pieces: list[tuple], capacity: int, last: bool):
    """(windows of pieces, what is left over); a piece is (doc, start, its ids as bytes, tokens of the document)."""
    by: dict[int, deque] = {}
    for p in pieces:
        by.setdefault(len(p[2]) // 4, deque()).append(p)
    windows, loose = [], []
    for used, times in pack_lengths({k: len(v) for k, v in by.items()}, capacity):
        slack = capacity - sum(k * n for k, n in used.items())
        for _ in range(times):
            window = [by[k].popleft() for k, n in sorted(used.items(), reverse=True) for _ in range(n)]
            (windows.append if slack <= capacity // 256 else loose.extend)(window)
    window, room = [], capacity
    for doc, start, ids, tokens in loose:
        while len(ids) // 4 >= room:
            windows.append([*window, (doc, start, ids[: 4 * room], tokens)])
            start, ids, window, room = start + room, ids[4 * room :], [], capacity
        if len(ids):
            window.append((doc, start, ids, tokens))
            room -= len(ids) // 4
    if last and window:
        windows.append(window)
    return windows, [] if last else window


class _Words(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def byte_bpe_encoder(ranks_path: str | None = None):
    """text -> packed ids of byte_bpe_50k; ranks_path: its .tiktoken file, of which the .json is the same vocabulary."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    head, tail = _Words(encode, ""), _Words(encode, " ")

    def packed(text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts[1:]:  # runs of spaces: the chunks would not stand alone
            ids = encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return head[parts[0]] + b"".join(map(tail.__getitem__, parts[1:]))

    return packed


def file_encoder(ranks_path: str | None = None):
    """text -> packed ids as the tokenizers library gives them for the .json file: added tokens are one id each."""
    import public_tokenizers as P

    ordinary = byte_bpe_encoder(ranks_path)
    with open((ranks_path or P.path("byte_bpe_50k.tiktoken")).removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {t["content"]: struct.pack("<I", t["id"]) for t in json.load(f)["added_tokens"]}
    if not added:
        return ordinary
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def packed(text: str) -> bytes:
        if not cut.search(text):
            return ordinary(text)
        return b"".join(added[x] if k % 2 else ordinary(x) for k, x in enumerate(cut.split(text)))

    return packed


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded)."""
    end = struct.pack("<I", end_id)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        hand_back()
        encode, part, made, pieces, held = file_encoder(ranks_path), TaskContext.get().partitionId(), 0, [], 0

        def flush(last: bool):
            nonlocal pieces, made, held
            windows, pieces = _place(pieces, capacity, last)
            held = sum(len(p[2]) // 4 for p in pieces)
            rows = []
            for window in windows:
                at, sequence = 0, (part << 40) + made
                total = sum(len(p[2]) // 4 for p in window)
                padded = capacity - total if total & (total - 1) else 0
                for doc, start, ids, tokens in window:
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, at, padded))
                    at += len(ids) // 4
                made += 1
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(columns), names=columns)

        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    pieces.append((doc, start, ids[4 * start : 4 * (start + capacity)], n))
                held += n
                if held >= BLOCK_TOKENS:
                    yield flush(False)
        yield flush(True)

    return bounded_batches(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    return pack(documents(spark, sf_dir))
