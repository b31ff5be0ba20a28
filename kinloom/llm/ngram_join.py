"""N-gram Jaccard self-join with a prefix tree; the result is one row a document with its component.

Plan
1. each text becomes the sorted set of its shingles' 64-bit hashes; rows with the same set are one class, so copies
   cost no pairs.  Of a set of n hashes only the window, its m = p + e smallest, is kept, where
   p = n - ceil(t n) + 1 and e = min(n - p, n // 20 + 1);
2. two sets that link share at least e + 1 hashes inside their windows (e taken at the smallest linkable size).  A
   class with fewer window hashes that another class has in its window too links with nothing and is done;
3. hashes in at most ``hot`` windows tell which classes share enough of them, the rest being counted as shared: these
   are candidate pairs.  Hashes in more windows are never paired; a class that has more of them than it can spare is
   tied to the hash's least class instead.  The connected components of both are families, and each linked pair lies
   within one family;
4. only classes in families are tokenised in full.  A family is joined in one task; one whose sets pass
   ``chunk_tokens`` is cut by size first, so that only sets of the same or of neighbouring size classes meet, as no
   others can link, and then into chunks, of which each pair is a task: the sets, most frequent hash first, go into a compressed prefix tree, and
   each set walks down it level by level, sharing the overlaps of common prefixes and leaving a subtree as soon as
   what remains on either side cannot reach the threshold;
5. a task returns one row for each set - its local root and its number of links - never its pairs.

Everything is exact: windows and families only leave out pairs that cannot link.

Defined results: null, empty and white-space texts have an empty set, link with nothing and are components of their
own; with fewer than ``size`` words the whole sequence is the one shingle; a component is named by its smallest id,
nulls ignored; repeated rows are members of one class; an empty table gives an empty result.  Classes are told by the
128-bit digests of their sets, families by those of a member, shingles by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import bitmap, bounded_batches, documents, hand_back, in_bitmap, staged
from kinloom.operators.graph import linked as components

HOT = 64
CHUNK_TOKENS = 500_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_words = _WordHash()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype="uint64")


def shingle_set(text: bytes, size: int = 4) -> np.ndarray:
    """Sorted distinct hashes (int64) of the word shingles of UTF-8 text; A-Z lower-cased, words cut at ASCII space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="int64")
    h = np.fromiter(map(_words.__getitem__, words), dtype="uint64", count=len(words))
    k = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(len(h) if k < size else size))
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _ODD[i % 4] + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _ODD[0]
        out ^= out >> np.uint64(29)
    return np.unique(out.view("int64"))


def _p(n, percent):
    return n - -(-n * percent // 100) + 1


def _e(n, percent):
    return min(n - _p(n, percent), n // 20 + 1)


def _arrow_texts(batch) -> list:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _windows(size: int, percent: int):
    def run(batches):
        hand_back()
        for b in batches:
            n, node, win, offsets = [], [], [], [0]
            for t in _arrow_texts(b):
                s = shingle_set(t, size)
                k = len(s)
                n.append(k)
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                w = s[: _p(k, percent) + _e(k, percent)] if k else s
                win.append(w)
                offsets.append(offsets[-1] + len(w))
            flat = np.concatenate(win) if win else np.empty(0, dtype="int64")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), lists], names=["id", "th", "n", "node", "win"])

    return run


def _full(size: int, kept: list[str]):
    def run(batches):
        hand_back()
        for b in batches:
            sets = [shingle_set(t, size) for t in _arrow_texts(b)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets) if sets else np.empty(0, dtype="int64")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([*(b.column(c) for c in kept), lists], names=[*kept, "tokens"])

    return run


class PrefixTree:
    """Compressed prefix tree over ascending integer sequences, flattened into arrays, level by level."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].tolist())
        nodes = []  # parent, sequence, from, to, ends
        nodes.append([-1, -1, 0, 0, []])
        stack = [(0, 0)]  # (node, depth at its end)
        before = np.empty(0, dtype="int64")
        for i in order:
            s = seqs[i]
            k = min(len(s), len(before))
            differ = np.flatnonzero(s[:k] != before[:k])
            shared = int(differ[0]) if len(differ) else k
            last = None
            while stack[-1][1] > shared:
                last = stack.pop()
            top, depth = stack[-1]
            if depth < shared:  # split the edge that was left last
                child = nodes[last[0]]
                nodes.append([top, child[1], depth, shared, []])
                child[0], child[2] = len(nodes) - 1, shared
                top = len(nodes) - 1
                stack.append((top, shared))
            if len(s) > shared:
                nodes.append([top, i, shared, len(s), [i]])
                stack.append((len(nodes) - 1, len(s)))
            else:
                nodes[top][4].append(i)
            before = s
        children: list[list[int]] = [[] for _ in nodes]
        for k, node in enumerate(nodes[1:], 1):
            children[node[0]].append(k)
        level, flat = [0], [0]
        while level:
            level = [c for k in level for c in children[k]]
            flat += level
        where = {k: j for j, k in enumerate(flat)}
        count = len(flat)
        self.kids_from = np.zeros(count, dtype="int64")
        self.kids = np.zeros(count, dtype="int64")
        self.seg_from = np.zeros(count, dtype="int64")
        self.seg_len = np.zeros(count, dtype="int64")
        self.last = np.full(count, -1, dtype="int64")
        self.most = np.zeros(count, dtype="int64")  # tokens below the node, at most
        self.least = np.full(count, np.iinfo("int64").max // 4, dtype="int64")  # smallest set below or at it
        self.ends: list[list[int]] = []
        segs, at = [], 0
        for j, k in enumerate(flat):
            _, seq, lo, hi, ends = nodes[k]
            self.ends.append(ends)
            if hi > lo:
                segs.append(seqs[seq][lo:hi])
                self.last[j] = seqs[seq][hi - 1]
            self.seg_from[j], self.seg_len[j] = at, hi - lo
            at += hi - lo
            self.kids[j] = len(children[k])
            if children[k]:
                self.kids_from[j] = where[children[k][0]]
        self.tokens = np.concatenate(segs) if segs else np.empty(0, dtype="int64")
        for j in range(count - 1, -1, -1):
            if self.ends[j]:
                self.least[j] = min(self.least[j], int(sizes[self.ends[j]].min()))
            parent = nodes[flat[j]][0]
            if parent >= 0:
                q = where[parent]
                self.most[q] = max(self.most[q], self.most[j] + self.seg_len[j])
                self.least[q] = min(self.least[q], self.least[j])
        self.has_ends = np.array([bool(e) for e in self.ends])

    def search(self, has: np.ndarray, seq: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> list[int]:
        """Sets of the tree with 100 * overlap >= percent * union against the set `seq` of size n."""
        found: list[int] = []
        nodes = np.array([0])
        overlap = np.array([0])
        while len(nodes):
            ended = np.flatnonzero(self.has_ends[nodes])
            for k in ended.tolist():
                o = int(overlap[k])
                found += [y for y in self.ends[nodes[k]] if 100 * o >= percent * (n + int(sizes[y]) - o)]
            kids = self.kids[nodes]
            open_ = kids > 0
            if not open_.any():
                break
            nodes, overlap, kids = nodes[open_], overlap[open_], kids[open_]
            skip = np.cumsum(kids) - kids
            below = np.repeat(self.kids_from[nodes] - skip, kids) + np.arange(int(kids.sum()))
            lens = self.seg_len[below]
            skip = np.cumsum(lens) - lens
            at = np.repeat(self.seg_from[below] - skip, lens) + np.arange(int(lens.sum()))
            overlap = np.repeat(overlap, kids) + np.add.reduceat(has[self.tokens[at]], skip)
            rest = np.minimum(len(seq) - np.searchsorted(seq, self.last[below], side="right"), self.most[below])
            need = -(-percent * (n + self.least[below]) // (100 + percent))
            alive = overlap + rest >= need
            nodes, overlap = below[alive], overlap[alive]
        return found


def join_sets(tokens: list[np.ndarray], weights: list[int], side: list[int], percent: int, across: bool):
    """(root index, links) for each set; side: 0 or 1; across: pairs are taken across sides, else within (side is all 0)."""
    sizes = np.array([len(t) for t in tokens], dtype="int64")
    values, inverse, df = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype="int64")
    rank[np.lexsort((values, -df))] = np.arange(len(values))
    rank[df < 2] = -1  # a hash of one set can be in no overlap
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    ranks = rank[inverse]
    seqs = [np.sort(r[r >= 0]) for r in (ranks[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
    inside = [i for i in range(len(tokens)) if side[i] == int(across)]
    if across and len(inside) in (0, len(tokens)):  # a chunk without sets
        return list(range(len(tokens))), [0] * len(tokens)
    tree = PrefixTree([seqs[i] for i in inside], sizes[inside])
    root, links = list(range(len(tokens))), [0] * len(tokens)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    has = np.zeros(len(values) + 1, dtype="int64")
    for x in range(len(tokens)):
        if across and side[x]:
            continue
        has[seqs[x]] = 1
        for k in tree.search(has, seqs[x], int(sizes[x]), sizes[inside], percent):
            y = inside[k]
            if y != x:
                links[x] += weights[y]
                if across:
                    links[y] += weights[x]
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
        has[seqs[x]] = 0
    return [find(i) for i in range(len(tokens))], links


def _block(percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi, i, j = key
        pdf = pdf.drop_duplicates("node").sort_values(["side", "node"], kind="stable")
        roots, links = join_sets([np.asarray(t, dtype="int64") for t in pdf["tokens"]], pdf["copies"].tolist(), pdf["side"].tolist(), percent, lo != hi or i != j)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "root": nodes[roots], "links": links})

    return run


def ngram_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, hot: int = HOT, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """(id, n_shingles, component_id, n_links), one row for each row of df."""
    spark = df.sparkSession
    texts = bounded_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = staged(texts.mapInArrow(_windows(size, percent), "id long, th long, n long, node binary, win array<long>"), "windows")
    classes = staged(
        rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("id", "th")).alias("pick"), F.first("n").alias("n")), "classes"
    )
    families = staged(_families(spark, rows, classes, percent, hot, chunk_tokens), "families")
    blocks = staged(_blocks(spark, texts, families, size).applyInPandas(_block(percent), "node binary, root binary, links long"), "blocks")
    links = blocks.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(blocks.select(F.col("node").alias("u"), F.col("root").alias("v")))
    slim = classes.select("node", "least", "copies")
    named = linked.join(slim, "node").groupBy("component").agg(F.min("least").alias("name"))
    of_class = (
        slim.join(linked.join(named, "component").select("node", "name"), "node", "left")
        .join(links, "node", "left")
        .select("node", F.coalesce("name", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = rows.select("id", "n", "node").join(of_class, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def _window_hashes(picked, shared=None):
    """(token) of the window hashes of the rows in `picked`; with `shared`, (node, n, token) of the hashes in it only."""

    def run(batches):
        hand_back()
        for b in batches:
            keep = in_bitmap(picked, b.column("pick").to_numpy())
            lists = b.column("win")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            row = np.repeat(np.arange(len(keep)), np.diff(ends))
            flat = flat[ends[0] : ends[-1]]
            take = keep[row]
            if shared is not None:
                take &= in_bitmap(shared, flat)
            row, flat = row[take], flat[take]
            if shared is None:
                yield pa.record_batch([pa.array(flat)], names=["token"])
                continue
            at = pa.array(row)
            yield pa.record_batch([b.column("node").take(at), b.column("n").take(at), pa.array(flat)], names=["node", "n", "token"])

    return run


def _spare(n, percent: int):
    """Window hashes beyond the first p, at the smallest size that can link with a set of n (columns)."""
    small = F.floor((n * percent + 99) / 100)
    return F.least(F.floor((small * percent + 99) / 100) - 1, F.floor(small / 20) + 1)


def _families(spark, rows: DataFrame, classes: DataFrame, percent: int, hot: int, chunk_tokens: int) -> DataFrame:
    """(node, copies, pick, family, bucket, meets) of the classes that may link with another; meets: the size classes
    (bucket, chunks) of the family that a class has to meet, its own among them."""
    pick = F.xxhash64("id", "th")
    picked = bitmap(spark, classes.select(F.xxhash64("pick.id", "pick.th").alias("x")))
    source = rows.filter("n > 0").select("node", "n", pick.alias("pick"), "win")
    schema = "node binary, n long, token long"
    shared = staged(source.mapInArrow(_window_hashes(picked), "token long").groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    repeated = bitmap(spark, shared.select(F.col("token").alias("x")))
    held = source.mapInArrow(_window_hashes(picked, repeated), schema).join(shared, "token").groupBy("node", "n").agg(F.collect_set(F.struct("token", "df")).alias("hits"))
    held = held.withColumn("spare", _spare(F.col("n"), percent)).filter(F.size("hits") > F.col("spare"))
    held = held.withColumn("large", F.size(F.filter("hits", lambda h: h["df"] > hot)))
    keys = staged(held.select("node", "n", "spare", "large", F.explode("hits").alias("h")).select("node", "n", "spare", "large", "h.token", "h.df"), "keys")

    # hashes in few windows: count what two classes share, in groups of `hot` at most
    few = keys.filter(F.col("df") <= hot)
    a, b = few.alias("a"), few.alias("b")
    fits = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    need = F.greatest("a.spare", "b.spare") + 1 - F.least("a.large", "b.large")
    counted = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), need.cast("int").alias("need"))
    pairs = counted.groupBy("u", "v").agg(F.max("need").alias("need"), F.count("*").alias("c")).filter("c >= need").select("u", "v")

    # classes with more large hashes than they can spare: a star for each such hash
    busy = keys.filter((F.col("df") > hot) & (F.col("large") > F.col("spare"))).select("token", "node")
    least = busy.groupBy("token").agg(F.min("node").alias("v"))
    stars = busy.join(least, "token").select(F.col("node").alias("u"), "v").filter("u != v").distinct()

    family = components(pairs.unionByName(stars)).withColumnRenamed("component", "family")
    member = staged(family.join(classes.select("node", "n", "copies", "pick"), "node"), "members")
    weight = F.sum(F.col("n") + 16)
    large = member.groupBy("family").agg(weight.alias("w")).filter(F.col("w") > chunk_tokens).select("family", F.lit(True).alias("large"))
    # the widths of size classes are such that sets that can link are one class apart at most
    bucket = F.when(F.col("large"), F.floor(F.log("n") / (1.0001 * math.log(100 / percent)))).otherwise(0).cast("int")
    member = member.join(large, "family", "left").withColumn("bucket", bucket)
    parts = member.groupBy("family", "bucket").agg(F.ceil(weight / chunk_tokens).cast("int").alias("chunks"))
    near = F.when(F.col("large"), F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).otherwise(F.array("bucket"))
    meets = member.select("node", "family", F.explode(near).alias("bucket")).join(parts, ["family", "bucket"]).groupBy("node").agg(F.collect_list(F.struct("bucket", "chunks")).alias("meets"))
    return member.select("node", "copies", "pick", "family", "bucket").join(meets, "node")


def _blocks(spark, texts: DataFrame, families: DataFrame, size: int):
    """The full sets of all members, grouped into blocks (family, lo, hi, i, j): chunk i of size class lo and j of hi."""
    wanted = bitmap(spark, families.select(F.col("pick.th").alias("x")))

    @F.pandas_udf(BooleanType())
    def may(th: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(wanted, th.to_numpy()))

    near = texts.filter(may("th"))
    same = near["id"].eqNullSafe(families["pick.id"]) & (near["th"] == families["pick.th"])
    own = F.expr("filter(meets, m -> m.bucket = bucket)[0].chunks")
    kept = ["node", "copies", "family", "bucket", "chunk", "meets"]
    sets = near.join(families, same).withColumn("chunk", F.pmod(F.xxhash64("node"), own).cast("int")).select(*kept, "text")
    sets = sets.mapInArrow(_full(size, kept), "node binary, copies long, family binary, bucket int, chunk int, meets array<struct<bucket:int,chunks:int>>, tokens array<long>")
    spread = sets.withColumn("m", F.explode("meets")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m.chunks") - 1)))
    mine, theirs = F.struct(F.col("bucket").alias("b"), F.col("chunk").alias("c")), F.struct(F.col("m.bucket").alias("b"), F.col("other").alias("c"))
    placed = spread.withColumns({"first": F.least(mine, theirs), "second": F.greatest(mine, theirs), "side": (mine > theirs).cast("int")})
    placed = placed.select("node", "copies", "family", "tokens", "side", F.col("first.b").alias("lo"), F.col("second.b").alias("hi"), F.col("first.c").alias("i"), F.col("second.c").alias("j"))
    return placed.groupBy("family", "lo", "hi", "i", "j")


def query(spark, sf_dir):
    return ngram_components(documents(spark, sf_dir))
