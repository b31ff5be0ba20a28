"""Benchmark decontamination by latent semantic retrieval, with a common-subsequence and an answer check.

A document is cut into overlapping passages of ``WIDTH`` words, and a longer item into pieces of that length; a piece
is searched as an item is, and leads to its whole item.  The terms are the words of the benchmark that are rare in the
corpus (for each piece at least its ``KEEP`` rarest), weighted by TF-IDF.

1. one scan counts, over all passages of all documents, in how many each benchmark word occurs;
2. one scan accumulates the sketch A'A.W of the passage matrix A (rows: all passages and the items; W: a Gaussian
   test matrix); partial sums are added in a tree, and the driver, which only ever sees terms x sketch, takes the
   right singular vectors from it (single-pass randomised SVD by the Nystroem formula);
3. one scan folds every passage into the latent space, takes the items within ``cosine`` of it as candidates, and
   checks each against the words around the passage: the longest common subsequence must cover ``lcs_sure`` of the
   item, or ``lcs_answer`` with the item's answer (its last line or sentence) present too;
4. a passage that holds much besides a short item is far from it in the latent space, so in the same scan every piece
   of which two neighbouring passages hold ``lcs_sure`` of the distinct terms is a candidate too, whatever else they
   hold.  Such an item must be covered to ``lcs_sure`` by a stretch of words hardly longer than itself.  Every whole
   copy is found this way, since two neighbours hold all terms of a piece.

Nothing but the sketch is shuffled.  The benchmark, a table of the driver's size, is taken in blocks of ``BLOCK_ITEMS``
pieces, which bounds a sketch; all documents are tested against every block.  The words of all blocks are counted in one
scan, and blocks share the other two as long as their sketches stay under ``SCAN_BYTES``.

Defined results: null and empty texts are clean; null or empty items match nothing; repeated rows are tested each;
an empty benchmark leaves all clean; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, hand_back

WIDTH, HOP = 64, 32
KEEP = 8
RARE = 0.0005
BLOCK_ITEMS = 256
EXTRA = 32
#: Bytes of sketches that a task holds at a time.
SCAN_BYTES = 64 << 20
#: Bytes of texts that are cut into words at a time, and of a table of sketch or latent numbers for their terms.
STRETCH_BYTES, PORTION_BYTES = 1 << 18, 4 << 20

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, ASCII punctuation and white space cut."""
    return text.translate(_CLEAN).split()


def answer_of(text: str) -> list[bytes]:
    """The item's answer: its last line, or its last sentence if it has one line."""
    parts = [x for x in text.split("\n") if words_of(x.encode())] or [""]
    if len(parts) == 1:
        parts = [x for x in text.split(". ") if words_of(x.encode())] or [""]
    return words_of(parts[-1].encode()) if len(parts) > 1 else []


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    if not a or not b:
        return 0
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _stretches(texts: list[bytes], vocabulary: dict):
    """Yields (first text, words of each text, number of each word or -1) for stretches of texts."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) < STRETCH_BYTES):
            total += len(texts[hi])
            hi += 1
        lens, ids = [], []
        for t in texts[lo:hi]:
            words = words_of(t)
            lens.append(len(words))
            ids.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype="int64", count=len(words)))
        yield lo, np.array(lens), np.concatenate(ids)
        lo = hi


def _passages(lens: np.ndarray):
    """(text of each passage, first passage of each text)"""
    parts = np.maximum(1, -(-lens // HOP))
    return np.repeat(np.arange(len(lens)), parts), np.cumsum(parts) - parts


def _hits(lens: np.ndarray, ids: np.ndarray, size: int, overlap: bool):
    """(passage, term, count), ordered; with `overlap` a word counts in the passage before its own too; size: terms."""
    size, (_, base) = max(1, size), _passages(lens)
    at = np.flatnonzero(ids >= 0)
    doc = np.searchsorted(np.cumsum(lens), at, side="right")
    own = (at - (np.cumsum(lens) - lens)[doc]) // HOP
    key = (base[doc] + own) * size + ids[at]
    if overlap:
        earlier = own > 0
        key = np.concatenate([key, key[earlier] - size])
    key, count = np.unique(key, return_counts=True)
    return key // size, key % size, count


def _weighted(passage, term, count, idf):
    """Rows of unit length: (row starts, passage of each row, weights)."""
    w = (1 + np.log(count)) * idf[term]
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.empty(0, dtype="int64")
    norm = np.sqrt(np.add.reduceat(w * w, starts)) if len(starts) else np.empty(0)
    norm[norm == 0] = 1
    w = w / np.repeat(norm, np.diff(np.r_[starts, len(w)]))
    return starts, passage[starts], w


def _telling(passage, term, count):
    """Pairs of passages with two terms or more: one term says nothing of how terms go together."""
    new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.empty(0, dtype="int64")
    lens = np.diff(np.r_[new, len(passage)])
    keep = np.repeat(lens > 1, lens)
    return passage[keep], term[keep], count[keep]


def _texts(batch):
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _count_terms(vocabulary):
    def run(batches):
        hand_back()
        df, passages = np.zeros(len(vocabulary), dtype="int64"), 0
        for b in batches:
            for _, lens, ids in _stretches(_texts(b), vocabulary):
                passages += len(_passages(lens)[0])
                df += np.bincount(_hits(lens, ids, len(vocabulary), False)[1], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, seen]), pa.array(np.r_[passages, df[seen]])], names=["term", "n"])

    return run


#: Terms of the sketch that travel together.
ROWS = 256


def _sketch(vocabulary, blocks):
    """blocks: (number of each word of the vocabulary in the block, idf, omega) of each."""

    def run(batches):
        hand_back()
        sums = [np.zeros_like(omega) for _, _, omega in blocks]
        for b in batches:
            for _, lens, ids in _stretches(_texts(b), vocabulary):
                for c, (own, idf, omega) in zip(sums, blocks):
                    _add(c, *_telling(*_hits(lens, own[ids], len(idf), True)), idf, omega)
        part = _task() % 64
        for k, c in enumerate(sums):
            for lo in range(0, len(c), ROWS):
                if c[lo : lo + ROWS].any():
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([lo]), pa.array([part], pa.int32()), pa.array([c[lo : lo + ROWS].astype("float32").tobytes()])], names=["block", "rows", "part", "c"])

    return run


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _portions(starts, n: int, row_bytes: int):
    """(first row, row after the last, first entry, entry after the last): whole rows of n entries, so that a table of row_bytes
    an entry has PORTION_BYTES at most, or one row."""
    ends, most, lo = np.r_[starts[1:], n], max(1, PORTION_BYTES // max(1, row_bytes)), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, side="right")))
        yield lo, hi, int(starts[lo]), int(ends[hi - 1])
        lo = hi


def _add(c, passage, term, count, idf, omega):
    """c += A'(A omega) for the rows given."""
    if not len(passage):
        return
    starts, _, w = _weighted(passage, term, count, idf)
    for lo, hi, a, b in _portions(starts, len(w), omega.itemsize * omega.shape[1]):
        own, weight, head = term[a:b], w[a:b, None], starts[lo:hi] - a
        y = np.add.reduceat(omega[own] * weight, head, axis=0)
        back = np.repeat(y, np.diff(np.r_[head, b - a]), axis=0) * weight
        order = np.argsort(own, kind="stable")
        sorted_terms = own[order]
        head = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]])
        c[sorted_terms[head]] += np.add.reduceat(back[order], head, axis=0)


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, dtype="float32").astype("float64") for x in pdf["c"]], axis=0)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "rows": [pdf["rows"].iloc[0]], "c": [total.astype("float32").tobytes()]})


def latent_basis(c: np.ndarray, omega: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors (terms x k) of A from the sketch c = A'A omega."""
    shift = 1e-9 * max(np.linalg.norm(c), 1e-12)
    c = c + shift * omega
    core = omega.T @ c
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > 1e-10 * max(value.max(), 1e-30)
    half = c @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, s > 1e-6 * max(s.max(initial=0), 1e-30)][:, :k]


def _covered(passage, term, first, size: int, postings, share: float):
    """(passage, piece) where the passage and the next hold `share` of the piece's distinct terms at least.

    first: the first passage of each passage's text; postings: (starts by term, pieces, terms of each piece).
    """
    starts, pieces, total = postings
    later = passage > first[passage]
    key = np.unique(np.concatenate([passage * size + term, (passage * size + term)[later] - size]))
    window, term = key // size, key % size
    times = starts[term + 1] - starts[term]
    ends = np.cumsum(times)
    piece = pieces[np.arange(int(times.sum())) - np.repeat(ends - times, times) + np.repeat(starts[term], times)]
    pair, held = np.unique(np.repeat(window, times) * len(total) + piece, return_counts=True)
    good = pair[held >= np.ceil(share * total[pair % len(total)] - 1e-9)]
    return good // len(total), good % len(total)


def _tight(item: list, words: list) -> float:
    """The largest share of a short item in a stretch of words hardly longer than it."""
    step = max(1, len(item) // 4)
    wide, best = len(item) + step, 0
    for k in range(0, max(1, len(words) - len(item) + 1), step):
        best = max(best, lcs(item, words[k : k + wide]))
        if best == len(item):
            break
    return best / len(item)


def _search(found_blocks, cosine, lcs_sure, lcs_answer):
    vocabulary, blocks = found_blocks

    def matches(texts: list[bytes]) -> list[dict]:
        out: list[dict] = [{} for _ in texts]
        for lo, lens, ids in _stretches(texts, vocabulary):
            owner, base = _passages(lens)
            for block in blocks:
                match(block, texts, lo, lens, ids, owner, base, out)
        return out

    def match(block, texts, lo, lens, ids, owner, base, out):
        own_ids, idf, basis, latent, postings, pieces = block
        found = _hits(lens, own_ids[ids], len(idf), True)
        near = set()
        passage, term, count = _telling(*found)
        if len(passage):
            starts, at, w = _weighted(passage, term, count, idf)
            for lo_, hi, a, b in _portions(starts, len(w), basis.itemsize * max(basis.shape[1], len(latent))):
                z = np.add.reduceat(basis[term[a:b]] * w[a:b, None].astype("float32"), starts[lo_:hi] - a, axis=0)
                norm = np.linalg.norm(z, axis=1, keepdims=True)
                norm[norm == 0] = 1
                r, i = np.nonzero((z / norm) @ latent.T >= cosine)
                near.update(zip(at[lo_:hi][r].tolist(), i.tolist()))
        if not len(found[0]):
            return
        covered = zip(*(x.tolist() for x in _covered(found[0], found[1], base[owner], max(1, len(idf)), postings, lcs_sure)))
        words, of, done = [], -1, set()
        for at_passage, i in sorted(near.union(covered)):
            item_id, _, answer, item = pieces[i]
            k = int(owner[at_passage])
            if k != of:
                words, of = words_of(texts[lo + k]), k
            first, spare = int(at_passage - base[k]) * HOP, len(item)
            own = out[lo + k]
            wide = (at_passage, i) in near or len(item) > WIDTH
            step = (at_passage, id(item), wide)  # pieces of one item lead to the same words
            if own.get(item_id) == 1 or step in done:
                continue
            done.add(step)
            if wide:
                around = words[max(0, first - spare) : first + WIDTH + spare]
                share = lcs(item, around) / len(item)
                if share < lcs_sure and not (share >= lcs_answer and answer and 2 * lcs(answer, around) >= len(answer)):
                    continue
            else:
                share = _tight(item, words[first : first + WIDTH + HOP])
                if share < lcs_sure:
                    continue
            own[item_id] = max(own.get(item_id, 0.0), share)

    return matches


def _scan(block, cosine, lcs_sure, lcs_answer):
    def run(batches):
        hand_back()
        search = _search(block.value, cosine, lcs_sure, lcs_answer)
        for b in batches:
            found = search(_texts(b))
            items = pa.array([sorted(f) for f in found], pa.list_(pa.int64()))
            share = pa.array([max(f.values(), default=0.0) for f in found], pa.float64())
            yield pa.record_batch([b.column("id"), b.column("th"), items, share], names=["id", "th", "item_ids", "lcs_share"])

    return run


def _counts(texts: DataFrame, blocks: list) -> tuple[dict, int]:
    """(passages that hold each word of the benchmark, passages): one scan of all texts."""
    terms = sorted({w for own in blocks for _, words, *_ in own for w in words})
    counted = texts.mapInArrow(_count_terms({w: i for i, w in enumerate(terms)}), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r[0]: r[1] for r in counted.collect()}  # terms of the benchmark
    return {w: n.get(i, 0) for i, w in enumerate(terms)}, max(1, n.get(-1, 0))


def _plan(own: list, df_of: dict, passages: int):
    """(terms, idf, omega) of a block of pieces."""
    rare = {w for _, words, *_ in own for w in words if df_of[w] <= RARE * passages}
    for _, words, *_ in own:
        rare.update(sorted(set(words), key=lambda w: (df_of[w], w))[:KEEP])
    terms = sorted(rare)
    idf = np.log((1 + passages) / (1 + np.array([df_of[w] for w in terms], dtype="float64"))) + 0.1
    return terms, idf, np.random.default_rng(17).standard_normal((len(terms), len(own) + 2 * EXTRA))


def _groups(blocks: list, plans: list):
    """Blocks, with their plans, that share a scan."""
    group, size = [], 0
    for own, plan in zip(blocks, plans):
        if group and size + plan[2].nbytes > SCAN_BYTES:
            yield group
            group, size = [], 0
        group.append((own, plan))
        size += plan[2].nbytes
    if group:
        yield group


def _fit(texts: DataFrame, group: list):
    """What _search needs for the blocks of a group: one scan of all texts, and terms x sketch numbers on the driver."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, (terms, _, _) in group for w in terms}))}
    blocks = []
    for _, (terms, idf, omega) in group:
        numbers = np.full(len(vocabulary) + 1, -1, dtype="int64")  # the last is for words of no block
        numbers[[vocabulary[w] for w in terms]] = np.arange(len(terms))
        blocks.append((numbers, idf, omega))
    schema = "block int, rows long, c binary"
    tree = texts.mapInArrow(_sketch(vocabulary, blocks), "block int, rows long, part int, c binary").groupBy("block", "rows", "part").applyInPandas(_sum_rows, schema)
    sums = [np.zeros_like(omega) for _, _, omega in blocks]
    for k, lo, rows in tree.groupBy("block", "rows").applyInPandas(_sum_rows, schema).collect():  # terms x sketch
        sums[k][lo : lo + ROWS] = np.frombuffer(rows, dtype="float32").reshape(-1, sums[k].shape[1])
    return vocabulary, [_fit_block(own, terms, numbers, idf, omega, c) for (own, (terms, _, _)), (numbers, idf, omega), c in zip(group, blocks, sums)]


def _fit_block(own, terms, numbers, idf, omega, c):
    of = {w: i for i, w in enumerate(terms)}
    rows = []
    for k, (_, words, *_) in enumerate(own):
        term, count = np.unique([of[w] for w in words if w in of], return_counts=True)
        rows.append((np.full(len(term), k), term, count))
    passage, term, count = (np.concatenate(x) for x in zip(*rows))
    by_term = np.argsort(term, kind="stable")
    postings = np.searchsorted(term[by_term], np.arange(len(terms) + 1)), passage[by_term], np.bincount(passage, minlength=len(own))
    starts, _, w = _weighted(passage, term, count, idf)
    lens = np.diff(np.r_[starts, len(w)])
    # the items are passages too; together they weigh as much as what the corpus holds of their terms
    weight = np.sqrt(max(1.0, np.linalg.norm(c) / np.linalg.norm(omega)))
    y = np.add.reduceat(omega[term] * (w * weight)[:, None], starts, axis=0)
    np.add.at(c, term, np.repeat(y, lens, axis=0) * (w * weight)[:, None])
    basis = latent_basis(c, omega, len(own) + EXTRA)
    latent = np.add.reduceat(basis[term] * w[:, None], starts, axis=0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return numbers, idf, basis.astype("float32"), latent.astype("float32"), postings, own


def _item_blocks(benchmark: DataFrame, size: int):
    """Blocks of (item_id, words of the piece, answer, words of the item)."""
    own = []
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        words, answer = words_of(text.encode()), answer_of(text)
        if not words:
            continue
        last = max(0, len(words) - WIDTH)
        for lo in sorted({last, *range(0, last, WIDTH)}):
            own.append((item_id, words[lo : lo + WIDTH], answer, words))
            if len(own) == size:
                yield own
                own = []
    if own:
        yield own


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = 0.4, lcs_sure: float = 0.75, lcs_answer: float = 0.55, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(id, contaminated, item_ids, lcs_share), one row for each row of df; benchmark: (item_id, text)."""
    spark = df.sparkSession
    texts = bounded_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    scans = []
    blocks = list(_item_blocks(benchmark, block_items))
    df_of, passages = _counts(texts, blocks) if blocks else ({}, 1)
    for group in _groups(blocks, [_plan(own, df_of, passages) for own in blocks]):
        block = spark.sparkContext.broadcast(_fit(texts, group))
        scans.append(texts.mapInArrow(_scan(block, cosine, lcs_sure, lcs_answer), "id long, th long, item_ids array<long>, lcs_share double"))
    if len(scans) == 1:
        out = scans[0]
    elif not scans:
        out = texts.select("id", F.array().cast("array<bigint>").alias("item_ids"), F.lit(0.0).alias("lcs_share"))
    else:
        every = scans[0]
        for s in scans[1:]:
            every = every.unionByName(s)
        hits = every.filter(F.size("item_ids") > 0).distinct().groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("lcs_share").alias("lcs_share"))
        rows = texts.select("id", "th").alias("r")
        same = F.col("r.id").eqNullSafe(hits["id"]) & (F.col("r.th") == hits["th"])
        out = rows.join(hits, same, "left").select("r.id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("lcs_share", F.lit(0.0)).alias("lcs_share"))
    return out.select(F.col("id").alias(id_col), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "lcs_share")


def query(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
