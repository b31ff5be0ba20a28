"""Exact, line, near and substring deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np

from kinloom.llm import common, exact_dedup, line_dedup, ngram_join, substring_dedup
from kinloom.llm.common import ASCII_LOWER


def low(i):
    return -1 if i is None else i


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(ASCII_LOWER)].append(i)
    want = []
    for i, t, *_ in rows:
        key = (t or "").translate(ASCII_LOWER)
        keep = max((x for x in groups[key] if x is not None), default=None)
        want.append((low(i), low(keep), len(groups[key]), i == keep, sha(key.encode())))
    for slots in (2, 1024):  # the split between hot and cold must not show
        got = [(low(r[0]), low(r[1]), *r[2:]) for r in exact_dedup.exact_dedup(docs, slots=slots).collect()]
        assert sorted(got) == sorted(want)


def lines_brute(rows, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= min_chars:
                holders[key(s)].add(low(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [s for s in lines if len(holders.get(key(s), ())) < min_docs or max(holders[key(s)]) == low(i)]
        out.append((low(i), len(lines), len(lines) - len(keep), sha("\n".join(keep).encode())))
    return sorted(out)


def test_lines(spark, docs, rows, monkeypatch):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    got = sorted((low(r["doc_id"]), sha((r["text"] or "").encode())) for r in kept.collect())
    assert got == [(a, d) for a, _, _, d in lines_brute(rows)]
    marks = line_dedup.line_keep_bitmaps(docs)
    assert sorted((low(r["id"]), r["n_lines"], r["n_dropped"]) for r in marks.collect()) == sorted({(a, b, c) for a, b, c, _ in lines_brute(rows) if c})


def test_lines_over_partitions(spark):
    """One line in every document, dealt over several partitions: only the largest id keeps it."""
    line = "x" * 50
    df = spark.createDataFrame([(k, f"{line}\nown {k}\n{line}") for k in range(300)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {k: f"own {k}" for k in range(299)} | {299: f"{line}\nown 299\n{line}"}


def near_brute(rows, size, percent):
    sets, root = [], list(range(len(rows)))
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if find(x) == find(k) and rows[x][0] is not None]
        out.append((low(i), len(sets[k]), low(min(ids, default=None) if sets[k] else i), links[k]))
    return sorted(out)


def test_near(docs, rows):
    for size, percent, hot, chunk in ((4, 85, 64, 500_000), (5, 80, 64, 500_000), (4, 85, 2, 300)):  # busy hashes, families in chunks
        got = ngram_join.ngram_components(docs, size=size, percent=percent, hot=hot, chunk_tokens=chunk).collect()
        assert sorted(tuple(low(x) for x in r) for r in got) == near_brute(rows, size, percent)


def test_links_beside_empty_chunks(spark):
    """Pairs of near copies, each a family of two chunks of which one may be empty: one link each."""
    words = [" ".join(f"w{p}x{k}" for k in range(400)) for p in range(12)]
    texts = [(2 * p, w) for p, w in enumerate(words)] + [(2 * p + 1, w + " end") for p, w in enumerate(words)]
    got = ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id long, text string"), chunk_tokens=500).collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got} == {(k, k - k % 2, 1) for k in range(24)}


def test_size_classes_of_a_family(spark):
    """A chain of sets that grow word by word is one family over many size classes: every link is counted."""
    words = [f"w{k}" for k in range(130)]
    rows = [(k, " ".join(words[: 20 + 2 * k])) for k in range(55)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, chunk in ((64, 500), (2, 500), (64, 200), (64, 500_000)):
        got = ngram_join.ngram_components(df, hot=hot, chunk_tokens=chunk).collect()
        assert sorted(tuple(r) for r in got) == near_brute(rows, 4, 85)


def test_prefix_tree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.PrefixTree(sets, sizes)
    for s in sets:
        has = np.zeros(61, dtype="int64")
        has[s] = 1
        want = [k for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 60 * len(np.union1d(s, o))]
        assert sorted(tree.search(has, s, len(s), sizes, 60)) == want


def substrings_brute(rows, span=100):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - span + 1):
            at = (low(i), s)
            w = b[s : s + span]
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < (low(i), s):
                gone[s : s + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((low(i), len(b), len(b) - len(kept), len(re.findall(rb"\x01+", bytes(gone))), sha(kept)))
    return sorted(out)


def test_substrings(docs, rows, monkeypatch):
    extra = [(200, "ab" * 400, "en", "s", 1), (201, "x" * 99, "en", "s", 1), (202, "y" * 100, "en", "s", 1), (203, "y" * 100, "en", "s", 1)]
    df = docs.sparkSession.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = substring_dedup.dedup_substrings(df)
    want = substrings_brute([*rows, *extra])
    assert sorted((low(r[0]), *r[1:5]) for r in got.collect()) == want
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got.collect())
    monkeypatch.setattr(substring_dedup, "HOT", 3)  # the salted rounds must not show
    assert sorted((low(r[0]), *r[1:5]) for r in substring_dedup.dedup_substrings(df).collect()) == want


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert ngram_join.ngram_components(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_small_bitmaps(spark):
    """A bitmap of few values takes few bytes, since each executor keeps a file of it; it has no false negatives."""
    values = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 3000)
    held = common.bitmap(spark, spark.createDataFrame([(int(x),) for x in values], "x long"))
    assert held.value.nbytes <= 1 << 18 and common.in_bitmap(held, values).all()
    assert common.in_bitmap(held, values + 12345).mean() < 0.02
    empty = common.bitmap(spark, spark.createDataFrame([], "x long"))
    assert empty.value.nbytes == common.LEAST_BYTES and not common.in_bitmap(empty, values).any()
