"""Packing, sharding, personal data, quality, decontamination, web pages and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, gbdt, html_extract, line_dedup, packing, pii, quality, sharding


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(-1 if i is None else i, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    assert set(got.doc_id) == set(want)
    for doc, own in got.groupby("doc_id"):
        # of every row, each id lies in exactly one piece, and the pieces' checksums are those of their ids
        assert own.length.sum() == sum(map(len, want[doc]))
        for start, length, crc, tokens in zip(own.start, own.length, own.ids_crc32, own.doc_tokens):
            assert any(len(ids) == tokens and crc == zlib.crc32(ids[start : start + length].tobytes()) for ids in want[doc])
        if len(want[doc]) == 1:
            assert sorted(own.start) == [0, *np.cumsum(own.sort_values("start").length)[:-1]]
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        total = window.length.sum()
        assert window.offset.tolist() == [0, *np.cumsum(window.length)[:-1]] and total <= 2048
        assert (window.padded == (0 if total & (total - 1) == 0 else 2048 - total)).all()


def test_packing_leaves_little(monkeypatch):
    """Documents of which no two fit a window: what is left over stays under a window, and every id is placed once."""
    for sizes in ([1500] * 500, [1025] * 301, [2047] * 50, [1]):
        pieces = [(k, 0, memoryview(bytes(4 * n)), n) for k, n in enumerate(sizes)]
        windows, rest = packing._place(pieces, 2048, False)
        held = sum(len(p[2]) // 4 for p in rest)
        assert held < 2048 and all(2040 <= sum(len(p[2]) // 4 for p in w) <= 2048 for w in windows)
        assert sum(len(p[2]) // 4 for w in windows for p in w) + held == sum(sizes)
        placed = sorted((p[0], p[1], len(p[2]) // 4) for w in [*windows, rest] for p in w)
        for (a, s, n), (b, t, _) in zip(placed, placed[1:]):
            assert t == (s + n if a == b else 0)


def test_fill_window_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        used = packing.fill_window(counts, sorted(counts), 60)
        assert all(used[k] <= counts[k] for k in used) and max(counts) in used
        reach = {max(counts)}
        for k, c in counts.items():
            for _ in range(c - (k == max(counts))):
                reach |= {x + k for x in reach if x + k <= 60}
        assert sum(k * n for k, n in used.items()) == max(reach)


def test_spaces_keep_token_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    encode = packing.byte_bpe_encoder()
    for t in ("", " ", "  a", "a  b", "a b ", "it's  \n x", "\n\na b", "tab\tx y", "don't 12 34,5 <|endoftext|> é à", " lead", "a b c"):
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_those_of_the_file(spark):
    """The library as it is loaded, with no switch set."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"end of one {end} start of next", end, f"{end}{end} a", f"a  {end}  b", f"x{end}y", "<|endoftext", f" {end}\n\n{end} ", "no token  here", "", f"word {end}" * 700]
    encode = packing.file_encoder()
    for t in texts:
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = set()
    for k, t in enumerate(texts):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        want |= {(k, s, zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    assert {(r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)


def test_sharding(docs, rows):
    for ranges in (None, 40):
        got = sharding.shard_by_bytes(docs, ranges=ranges).toPandas()
        want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
        assert set(got.shard) <= set(range(8)) and got.law.eq("bytes").all() and got.grown_shard.isna().all()
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
        sizes = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
        assert sizes.max() - sizes.min() <= 2 * got["size"].max() + got["size"].sum() / 8 / 100


def test_sharding_keeps_groups_whole(spark):
    """Groups of equal texts are cut only where they fit in no shard."""
    rng = random.Random(5)
    texts = ["a" * 3000] * 40 + ["b" * 500] * 60 + ["c" * 90] * 100 + ["word " * rng.randrange(1, 60) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for ranges in (None, 64):
        got = sharding.shard_by_bytes(df, ranges=ranges).toPandas()
        got["text"] = [texts[k] for k in got.doc_id]
        share = -(-got["size"].sum() // 8)
        sizes = got.groupby("shard")["size"].sum()
        assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * (share / sharding.LARGE + got["size"].max())
        for text, own in got.groupby("text"):
            assert (own.shard.nunique() == 1) == (own["size"].sum() <= share), (text[:9], len(own))


def test_sharding_brute_force(spark):
    """The whole placement, row by row: large groups by room, then all others in key order into the room that is left."""
    rng = random.Random(11)
    texts = ["a" * 900] * 90 + ["b" * 700] * 12 + ["c" * 40] * 150 + ["word " * rng.randrange(0, 50) for _ in range(900)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = df.select("doc_id", F.xxhash64("text").alias("digest"), F.xxhash64(F.lit(7), "doc_id").alias("low")).collect()
    sizes = [len(t) + 1 for t in texts]
    share = -(-sum(sizes) // 8)
    rows = sorted(((((r.digest % 2**64) >> 24) << 23 | r.low % 2**23), r.digest, r.doc_id) for r in hashed)
    groups: dict = {}
    for _, digest, k in rows:
        groups[digest] = groups.get(digest, 0) + sizes[k]
    room, place = [share] * 8, {}
    for digest, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if size * sharding.LARGE > share:
            best = max(range(8), key=lambda s: (room[s], -s))
            place[digest] = best if size <= room[best] else None
            room[best] -= size if size <= room[best] else 0
    assert None in place.values() and len(set(place.values())) > 3 and len(place) < len(groups)
    ends, want, at, start = [sum(room[: s + 1]) for s in range(7)], {}, 0, {}
    for _, digest, k in rows:
        if place.get(digest) is not None:
            want[k] = place[digest]
            continue
        start.setdefault(digest, at)
        middle = at + sizes[k] // 2 if digest in place else start[digest] + groups[digest] // 2
        want[k] = sum(e <= middle for e in ends)
        at += sizes[k]
    slots = {}
    for _, _, k in rows:
        slots[k] = sum(want[j] == want[k] for j in slots)
    for ranges in (None, 64):
        got = {r["doc_id"]: (r["shard"], r["slot"], r["size"]) for r in sharding.shard_by_bytes(df, ranges=ranges).collect()}
        assert got == {k: (want[k], slots[k], sizes[k]) for k in want}


def test_deal():
    given, room = sharding._deal([(1, 60), (2, 60), (3, 60), (4, 101), (5, 30)], 2, 100)
    assert given == {4: -1, 1: 0, 2: 1, 3: -1, 5: 0} and room == [10, 40]


def test_sharding_one_text(spark):
    df = spark.createDataFrame([(k, "same text") for k in range(4000)], "doc_id long, text string")
    sizes = sharding.shard_by_bytes(df).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "phone": 9 <= len(d) <= 15}.get(kind)
            if kind == "card":
                ok = 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if ok:
                out.append((kind, *m.span()))
    return out


PRIVATE = [
    "mail a.b+c@mail.example.com, or x@y.zz. and @no and a@b",
    "ips 1.2.3.4 and 1.2.3.4.5.6.7.8, 999.1.1.1 001.02.3.255 1.2.3",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112; 12",
    "call +1 (017) 555-7713 or +49 30 1234 5678. +1 2",
    "a@b.c@d.e x@@y.z é@é.com é1.1.1.1é",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here',
    "+1 (826) 555-4081 190.137.223.204 du 4111111111111111 4111111111111111",
    None,
    "",
    "1 " * 3000,
    "z" * 50_000 + "@" + "9" * 20_000,
]


def test_personal_data(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PRIVATE * 3)], "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        base = base_brute(PRIVATE[r["doc_id"] % len(PRIVATE)] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b[0] == k for b in base) for k in BASE]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def plain_texts(rng, n):
    words = [a + b for a in "bcdfgh" for b in ("ala", "orin", "est", "una")]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    forms = (lambda: f"{some(4)} {rng.randrange(10**15, 10**16)} {some(4)}", lambda: f"{some(5)}, v{rng.randrange(9)}.{rng.randrange(9)} {some(3)}", lambda: f"{some(3)} {rng.randrange(300)} {some(5)}", lambda: f"{some(4)} 10.0.{rng.randrange(200)}.7 {some(4)}")
    return [rng.choice(forms)() for _ in range(n)]


def test_field_beats_its_patterns():
    """Trained on texts with inventions, it finds at least 0.9 of other inventions in other texts; its patterns do not."""
    rng = random.Random(1)
    field = pii.train(plain_texts(rng, 300))
    found, known, total, wrong = 0, 0, 0, 0
    for text, own in pii.with_invented(plain_texts(rng, 400), 77):
        base = pii.base_spans(text)
        got = {(a, b): kind for kind, a, b in pii.added_spans(text, base, field)}
        patterns = {m.span(1) for m in pii.SECRET.finditer(text)} | {(a, b) for _, a, b in base}
        total += len(own)
        found += sum(got.get(span) == kind for span, kind in own.items())
        known += sum(span in patterns for span in own)
        wrong += sum(span not in own and span not in patterns for span in got)
    assert found >= 0.9 * total > 2 * known and wrong <= 0.05 * total
    t = 'and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there'
    assert pii.added_spans(t, [], field) == [("secret", 13, 53)]
    for t, span in (("now Authorization: Bearer 8f3kd93kdk3kd93kdkd93kd93kd", ("secret", 26, 53)), ("please call (017) 555-7713 now", ("phone", 12, 26)), ("his SSN 123-45-6789 is", ("ssn", 8, 19))):
        assert pii.added_spans(t, [], field) == [span]


def other_secret(rng):
    """(kind, before, secret, after) in forms that the field's own inventions do not have."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    both = letters + "0123456789"
    forms = (
        lambda: ("export DB_PASSWORD=", some(both, 24), ""),
        lambda: ('"client_secret": "', some(both, 32), '"'),
        lambda: ("the service token is ", some(hexes, 40), ""),
        lambda: ("curl -H 'Authorization: Bearer ", some(both, 36), "'"),
        lambda: ("aws_secret_access_key = ", some(both + "+/", 39) + some(letters, 1), ""),
        lambda: ("my key is ", some("0123456789abcdefghijklmnopqrstuvwxyz", 26), ""),
        lambda: ('password: "', some(letters[26:], 22), '"'),
        lambda: ("token='", some(letters, 28), "'"),
        lambda: ("id_token: ", f"eyJ{some(both, 17)}.{some(both, 60)}.{some(both, 40)}", ""),
    )
    kind = rng.randrange(len(forms))
    return kind, *forms[kind]()


def test_secrets_in_other_forms():
    """At least 0.9 of secrets from another generator than the field is trained on, with hardly a false span."""
    rng = random.Random(1)
    field = pii.train(plain_texts(rng, 300))
    found, wrong, rng = {}, 0, random.Random(5)
    for t in plain_texts(rng, 450):
        kind, before, secret, after = other_secret(rng)
        words = t.split()
        at = rng.randrange(1, len(words))
        left = " ".join(words[:at]) + " " + before
        text = left + secret + after + " " + " ".join(words[at:])
        got = {(a, b): k for k, a, b in pii.added_spans(text, pii.base_spans(text), field)}
        found.setdefault(kind, []).append(got.pop((len(left), len(left) + len(secret)), None) == "secret")
        wrong += len(got)
    every = [x for own in found.values() for x in own]
    assert sum(every) >= 0.9 * len(every) and min(sum(own) / len(own) for own in found.values()) >= 0.5 and wrong <= 0.02 * len(every)
    for t in ('token = "abcdefghijklmnopqrstuvwx"', 'password: "correcthorsebatterystaple"', 'api_key="AbCdEfGhIjKlMnOpQrSt"', 'secret="' + "-".join(["aB3"] * 12) + '"'):
        text = "some words here before. " + t + " and after it more words"
        m = pii.SECRET.search(text)
        assert pii.added_spans(text, pii.base_spans(text), field) == [("secret", *m.span(1))]


def test_stretches_of_the_sample(spark):
    """Each task brings its own least stretches: the sample is that of the whole table."""
    rng = random.Random(2)
    df = spark.createDataFrame([(t,) for t in plain_texts(rng, 400) * 2], "text string").repartition(7)
    rows = df.mapInPandas(pii._regions(20), "h long, region string").distinct().orderBy("h", "region").limit(20).collect()
    every = {r for t, in df.collect() for r in (t[a:b] for a, b in pii.regions(t))}
    want = sorted((int.from_bytes(hashlib.blake2b(r.encode(), digest_size=7).digest(), "little"), r) for r in every)[:20]
    assert [tuple(r) for r in rows] == want


class AnyField:
    """Random scores for each segment text."""

    def __init__(self):
        self.scores = {}

    def row(self, key):
        return self.scores.setdefault(key, np.random.default_rng(len(self.scores)).uniform(-2, 2, len(pii.TYPES)))

    def __call__(self, key):
        s = self.row(key)
        return float(np.logaddexp.reduce(s)), float(s.max()), int(s.argmax())


def test_segmentation_adds_up():
    """The best path and the marginals agree with listing all segmentations."""
    import itertools
    import math

    stretch, field = pii.Stretch("a 1.2 b@c"), AnyField()
    where = [(i, j) for i in range(len(stretch.words)) for j in stretch.ends(i)]
    scores = np.array([field.row(stretch.key(i, j)) for i, j in where])
    every = []
    for r in range(4):
        for chosen in itertools.combinations(range(len(where)), r):
            spans = sorted(where[k] for k in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                for types in itertools.product(range(len(pii.TYPES)), repeat=r):
                    every.append((sum(scores[k][t] for k, t in zip(chosen, types)), dict(zip(chosen, types))))
    z = sum(math.exp(s) for s, _ in every)
    marginal = pii.marginals(len(stretch.words), where, scores)
    for k, t in ((0, 1), (len(scores) - 1, 0)):
        assert math.isclose(marginal[k][t], sum(math.exp(s) for s, c in every if c.get(k) == t) / z, rel_tol=1e-6)
    best = max(every, key=lambda x: x[0])[1]
    got = stretch.decode(field)
    assert {(i, j): t for i, j, t, _ in got} == {where[k]: t for k, t in best.items()}
    for i, j, t, chance in got:
        assert math.isclose(chance, marginal[where.index((i, j))][t], rel_tol=1e-6)


def test_long_stretches_are_one(spark):
    """No window cuts a stretch: a segment in the middle of a very long one is found as it is alone."""
    rng = random.Random(2)
    field = pii.train(plain_texts(rng, 150))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for before in (100, 1990, 2000, 2400, 40_000):
        text = "7 " * (before // 2) + f'token = "{key}" ' + "8 " * 3000
        assert len(list(pii.regions(text))) == 1
        assert ("secret", text.index(key), text.index(key) + 40) in pii.added_spans(text, pii.base_spans(text), field)


def test_personal_data_columns(spark):
    """Clashing column names, repeated ids and null ids: each row has its own result."""
    rows = [(1, "mail a@b.cc", 9, "x"), (1, "ip 1.2.3.4", 8, None), (None, None, 7, ""), (None, "+49 30 1234 5678", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int, spans string").selectExpr("*", "'q' AS id", "1 AS n_email", "2 AS th")
    got = pii.find_personal_data(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    assert sorted(tuple(low if low is not None else -1 for low in (r[0], *r[1:5], r["spans"], r["n_spans"])) for r in got.collect()) == sorted(
        [(1, 1, 0, 0, 0, "email:5:11", 1), (1, 0, 1, 0, 0, "ip:3:10", 1), (-1, 0, 0, 0, 0, "", 0), (-1, 0, 0, 0, 1, "phone:0:16", 1)]
    )


def test_boosted_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = gbdt.fit(x[:2000], y[:2000])
    often = np.arange(2000) % 3 + 1.0
    assert np.allclose(gbdt.fit(x[:9], y[:9], np.full(9, 2.0), least=4.0, l2=2.0).score(x), gbdt.fit(x[:9], y[:9], least=2.0, l2=1.0).score(x))
    assert ((gbdt.fit(x[:2000], y[:2000], often).score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(gbdt.fit(x[:5], np.ones(5)).score(x), gbdt.fit(x[:5], np.ones(5)).score(x)[0])
    assert gbdt.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_boosted_trees_brute_force():
    """Each split by trying every cut of every feature on the rows of its node, one by one."""
    rng = np.random.default_rng(8)
    rate, l2, least, bins = 0.3, 1.5, 1.0, 6

    def leaves(x, grad, hess, rows, depth, cuts, out, used):
        if not depth:
            out[rows] = -rate * grad[rows].sum() / (hess[rows].sum() + l2)
            return
        worth = lambda part: grad[part].sum() ** 2 / (hess[part].sum() + l2)
        best = (1e-9, None)
        for f, own in enumerate(cuts):
            for c in own:
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(hess[left].sum(), hess[right].sum()) >= least:
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (left, right))
        used.append(best[1] is not None)
        for part in best[1] or (rows,):
            leaves(x, grad, hess, part, depth - 1, cuts, out, used)

    used: list = []
    for n, width in ((60, 3), (150, 4), (9, 2)):
        x = rng.normal(size=(n, width)).round(2)
        x[:, 0] = rng.integers(0, 3, n)  # fewer values than bins
        y = (x[:, 0] + x[:, 1] + rng.normal(size=n) > 1).astype(float)
        y[:2] = 0, 1
        w = rng.integers(1, 4, n).astype(float)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        p = (y * w).sum() / w.sum()
        margin = np.full(n, np.log(p / (1 - p)))
        for _ in range(5):
            p = 1 / (1 + np.exp(-margin))
            step = np.zeros(n)
            leaves(x, w * (p - y), w * p * (1 - p), np.arange(n), 3, cuts, step, used)
            margin = margin + step
        forest = gbdt.fit(x, y, w, trees=5, depth=3, bins=bins, rate=rate, l2=l2, least=least)
        assert np.allclose(forest.margin(x), margin, atol=1e-9), (n, width)
    assert 0 < sum(used) < len(used)


def test_quality(spark, docs, empty):
    labels = [(k, int(k % 4 != 0)) for k in range(400)]
    text = lambda k: "plain words in a row " * (5 + k % 7) if k % 4 else "LOUD!! WORDS!! " * (5 + k % 7)
    df = spark.createDataFrame([(k, text(k)) for k, _ in labels], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for k, q in labels:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert got[k]["predicted"] == q == int(got[k]["score"] >= 0.5)
    # repeated labels count, ties and repeated ids do not make the model depend on partitions
    twice = labels + labels[:100] + [(k, 1 - q) for k, q in labels[:10]] + [(None, 1), (5, None)]
    more = df.unionByName(spark.createDataFrame([(7, "another text under the same id"), (None, "no id")], df.schema))
    scores = []
    for parts in (1, 7):
        out = quality.classify(more.repartition(parts), spark.createDataFrame(twice, "doc_id long, quality int").repartition(parts))
        scores.append(sorted((r["doc_id"] or -1, r["score"]) for r in out.collect()))
        assert len(scores[-1]) == 402
    assert scores[0] == scores[1]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


def test_lcs():
    assert decontaminate.lcs("abcbdab", "bdcaba") == 4 and decontaminate.lcs([], "a") == 0


def test_contamination(spark, docs, empty):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    word = lambda: "".join(rng.choice(vocabulary) for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40))) + ".\n" + " ".join(word() for _ in range(5))) for k in range(30)]
    texts, want = [], {}
    for k in range(120):
        words = [word() for _ in range(200)]
        found = []
        if k % 3 == 0:
            item = items[k % 30]
            own = item[1].split()
            if k % 2:  # a paraphrase
                own = [w if rng.random() > 0.12 else word() for w in own]
            words[50:50] = own
            found = [item[0]]
        texts.append((k, " ".join(words)))
        want[k] = found
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, ""), (None, "x y z")], "item_id long, text string")
    for size in (256, 11):  # in one block, and in blocks
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, bench, block_items=size).collect()}
        right = sum(set(want[k]) <= set(got[k]) for k in want if want[k])
        assert right >= 0.9 * sum(bool(v) for v in want.values())
        assert all(set(got[k]) <= set(want[k]) for k in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(docs, none).filter("contaminated").count()
    assert decontaminate.contamination(docs, bench).count() == docs.count()
    assert decontaminate.contamination(empty, bench).count() == 0


def test_contamination_at_all_lengths(spark):
    """Whole copies are found whatever the length of the item, whatever stands beside them, in one block and in many."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    lengths = [1, 2, 3, 8, 8, 20, 64, 65, 100, 500, 500, 800, 2000]
    items = [(k, ["solitary"] if n == 1 else some(n)) for k, n in enumerate(lengths)]
    items += [(100 + k, some(8)) for k in range(60)]
    texts = {k: some(37 + k) + words + some(150) for k, words in items[: len(lengths)]}
    want = {k: [k] for k in texts}
    texts[200], want[200] = [w for k, words in items[len(lengths) :] for w in words], [k for k, _ in items[len(lengths) :]]  # a list of items
    for k in range(300, 320):
        texts[k], want[k] = some(400), []
    half = items[9][1]
    texts[400], want[400] = some(50) + half[: len(half) // 3] + some(50), []  # a third of an item is no copy
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for size in (256, 60):
        assert {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, bench, block_items=size).collect()} == want


def lcs_brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def leak_brute(item, words):
    """The largest share of the item in a stretch of words a quarter longer than it, over all stretches."""
    wide = len(item) + len(item) // 4
    return max((lcs_brute(item, words[k : k + wide]) for k in range(max(1, len(words) - len(item) + 1))), default=0) / len(item)


def test_contamination_brute_force(spark, monkeypatch):
    """Every item against every text, word by word: what holds 0.85 of an item is found, what holds under 0.55 is not."""
    rng = random.Random(21)
    pool = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(900)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items = {k: some(n) for k, n in enumerate((3, 5, 9, 14, 20, 33, 50, 64, 70, 110))}
    texts = {}
    for k in range(40):
        words = some(rng.randrange(0, 160))
        for item in rng.sample(sorted(items), k % 3):
            own = [w if rng.random() > (0, 0.06)[k % 2] else rng.choice(pool) for w in items[item]]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts[k] = words
    texts[40] = items[4][:6] + some(20) + items[5][:9]  # parts of items
    df = spark.createDataFrame([(k, " ".join(w).upper() if k % 5 == 0 else ", ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    share = {(d, i): leak_brute(item, words) for d, words in texts.items() for i, item in items.items()}
    for size, scan in ((256, 64 << 20), (4, 64 << 20), (4, 1)):  # one block; blocks in one scan; a scan for each
        monkeypatch.setattr(decontaminate, "SCAN_BYTES", scan)
        got = {(r["doc_id"], i) for r in decontaminate.contamination(df, bench, block_items=size).collect() for i in r["item_ids"]}
        assert {p for p, x in share.items() if x >= 0.85} <= got <= {p for p, x in share.items() if x >= 0.55}


def test_paraphrases(spark):
    """Items with 20 to 40 % of their words replaced and the answer kept: the latent space finds at least 0.9 of them, and
    no others; without it (a cosine that nothing reaches) fewer than half are found."""
    rng = random.Random(31)
    pool = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    some = lambda n: [rng.choice(pool) for _ in range(n)]
    items = {k: (some(rng.randrange(16, 45)), some(3)) for k in range(60)}
    texts, want = {}, {}
    for k in range(180):
        words, want[k] = some(rng.randrange(80, 300)), set()
        if k % 3:
            i, share = rng.randrange(60), rng.uniform(0.2, 0.4)
            own = [w if rng.random() > share else rng.choice(pool) for w in items[i][0]] + items[i][1]
            at = rng.randrange(len(words))
            words[at:at], want[k] = own, {i}
        texts[k] = words
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(q) + ".\n" + " ".join(a)) for k, (q, a) in items.items()], "item_id long, text string")
    found = {}
    for cosine in (0.4, 2.0):
        got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.contamination(df, bench, cosine=cosine).collect()}
        assert all(got[k] <= want[k] for k in want)
        found[cosine] = sum(map(len, got.values()))
    assert found[0.4] >= 0.9 * sum(map(len, want.values())) and found[2.0] < 0.5 * found[0.4]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head {n}</h1><p><b>One &amp; two{n}<br>three<p>Four   five</p><div class="comments"><p>Reader</p></div><aside>Side</aside></article><footer>&copy; Foot</footer></body></html>"""


def test_pages(spark):
    bare = "<html><body><div>Home About</div><p>Words of page {n}</p><div>All rights</div></body></html>"
    pages = [(k, "http://a.example.com/x", PAGE.format(n=k)) for k in range(4)] + [(10 + k, "https://b.example.com:80/y", bare.format(n=k)) for k in range(6)]
    pages += [(20, None, None), (21, "", ""), (22, "u", "just text <br> and &lt;more"), (23, "u", "<p>open <b>tags"), (24, "u", "<script>never closed <p>x")]
    got = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head 1\n\nOne & two1 three\n\nFour five" and got[1]["n_chars"] == len(got[1]["text"])
    assert [got[10 + k]["text"] for k in range(6)] == [f"Words of page {k}" for k in range(6)]  # the template is deduced
    assert [got[k]["text"] for k in (20, 21, 22, 23, 24)] == ["", "", "just text and <more", "open tags", ""]
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_classes(spark):
    """Section furniture goes by its own vector, marked pages have a template too, shared sentences stay."""
    page = "<html><body><div>Home</div>{s}<p>Words {n} of it.</p><p>{q}</p><p>More {n} here.</p></body></html>"
    section = '<div class="sec"><p>Politics desk</p></div>'
    plain = [(k, "http://c.example.com/", page.format(n=k, s=section if k < 4 else "", q="As they said." if k % 3 == 0 else f"They said {k}.")) for k in range(10)]
    marked = '<html><body><article><h1>Head {n}</h1><div id="rate">Rate this page</div><p>Words {n}</p><p>Same in all</p></article></body></html>'
    pages = plain + [(20 + k, "http://d.example.com/", marked.format(n=k)) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(10):
        assert got[k] == f"Words {k} of it.\n\n" + ("As they said." if k % 3 == 0 else f"They said {k}.") + f"\n\nMore {k} here."
    assert [got[20 + k] for k in range(5)] == [f"Head {k}\n\nWords {k}\n\nSame in all" for k in range(5)]


def extracted(spark, pages):
    return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


HINTED = {
    "wrapper": ('<body><div class="has-sidebar"><article><h1>Head {n}</h1><p>Words {n}</p></article></div><div class="sidebar">Side</div></body>', "Head {n}\n\nWords {n}"),
    "strong wrapper": ('<body><div class="widget"><article><h1>Head {n}</h1><p>Words {n}</p></article></div></body>', "Head {n}\n\nWords {n}"),
    "inner wrapper": ('<body><main><h1>Head {n}</h1><div class="page has-sidebar"><article><p>Words {n}</p></article></div></main></body>', "Head {n}\n\nWords {n}"),
    "main intro": ("<body><main><h1>Head {n}</h1><p>Intro {n}</p><article><p>Words {n}</p></article></main></body>", "Head {n}\n\nIntro {n}\n\nWords {n}"),
    "title": ("<body><header><h1>Site</h1></header><article><header><h1>Head {n}</h1><p>By {n}</p></header><p>Words {n}</p></article></body>", "Head {n}\n\nWords {n}"),
    "class name": ('<body><article><p>Words {n}</p><p class="social-history">History {n}</p></article></body>', "Words {n}\n\nHistory {n}"),
    "teasers": ('<body><main><h1>Head {n}</h1><p>Words {n}</p><div class="related"><article>Other {n}</article></div></main></body>', "Head {n}\n\nWords {n}"),
    "names only": ('<body><div class="widget"><p>Words {n}</p></div></body>', "Words {n}"),
}


@pytest.mark.parametrize("case", HINTED)
def test_names_are_hints(spark, case):
    """On a host of one page, and on one whose template is deduced."""
    page, want = HINTED[case]
    pages = [(1, "http://one.example.com/", page.format(n=1)), *((10 + k, "http://many.example.com/", page.format(n=k)) for k in range(6))]
    got = extracted(spark, pages)
    assert got[1] == want.format(n=1)
    assert [got[10 + k] for k in range(6)] == [want.format(n=k) for k in range(6)]


LINES = {
    "inline names": ('<p>The <a class="nav-link" href="/x">river</a> runs <span class="header-text">deep</span> {n}.</p>', "The river runs deep {n}."),
    "whole inline names": ('<p>One <span class="ad">more</span> word {n}</p>', "One more word {n}"),
    "drawing": ("<p>Before <svg viewBox='0 0 1 1'><text>no</text></svg>after {n}</p>", "Before after {n}"),
    "button": ("<p>Before <button type=button>Push</button> after {n}</p>", "Before after {n}"),
    "script": ("<p>Before<script>let a = '<p>';</script> after {n}</p>", "Before after {n}"),
    "label": ("<p>Before <label>Name <input name=x></label>after {n}</p>", "Before after {n}"),
    "comments": ('<p>Main {n}</p><section class="comments-area"><h2>Comments</h2><article class="comment-body"><p>Reader {n}</p></article></section>', "Main {n}"),
    "nested": ("<p>Main {n}</p><article><p>Teaser {n}</p></article>", "Main {n}"),
    "parts of names": ('<p class="social-history">History {n}</p><div class="header-image-credit">Photo {n}</div><h2 class="ad-hoc-title">Title {n}</h2>', "History {n}\n\nPhoto {n}\n\nTitle {n}"),
    "containers": ('<p>Main {n}</p><div class="share-buttons">Send {n}</div><div id="ad-slot-3">Buy {n}</div><div class="cookie-banner">Yes {n}</div>', "Main {n}"),
}


@pytest.mark.parametrize("case", LINES)
def test_lines_and_names(spark, case):
    """On a host of one page, and on one whose pages all have the same elements: texts of their own are never lost."""
    body, want = LINES[case]
    page = "<html><body><nav>Home</nav><article>{b}</article></body></html>"
    pages = [(1, "http://one.example.com/", page.format(b=body.format(n=1))), *((10 + k, "http://many.example.com/", page.format(b=body.format(n=k))) for k in range(6))]
    got = extracted(spark, pages)
    assert got == {1: want.format(n=1)} | {10 + k: want.format(n=k) for k in range(6)}


def test_other_articles(spark):
    pages = {
        1: '<main><article><p>Main text</p></article><article class="comment"><p>Reader</p></article></main>',
        2: '<article><p>Main text</p></article><div class="related-posts"><article><p>Teaser</p></article></div>',
        3: '<div class="related-posts"><article><p>Only text</p></article></div>',
        4: '<article class="comment"><p>Only text</p></article>',
        5: "<article><p>First</p></article><article><p>Second</p></article>",
        6: "<article><header><h1>Head</h1></header><article><p>Only text</p></article></article>",
    }
    got = extracted(spark, [(k, f"http://h{k}.example.com/", p) for k, p in pages.items()])
    assert got == {1: "Main text", 2: "Main text", 3: "Only text", 4: "Only text", 5: "First\n\nSecond", 6: "Head\n\nOnly text"}


def test_null_page_beside_a_template(spark):
    page = "<body><div>Home</div><p>Words {n}</p></body>"
    got = extracted(spark, [*((k, "http://h.example.com/", page.format(n=k)) for k in range(5)), (7, "http://h.example.com/", None), (8, None, page.format(n=8))])
    assert got == {**{k: f"Words {k}" for k in range(5)}, 7: "", 8: "Home\n\nWords 8"}


def plain_main_text(page):
    """Main text by the standard library's parser: blocks of the article outside furniture, whole names only."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.parts, self.text = [], [], ""

        def flush(self):
            text = " ".join(self.text.split())
            if text and "article" in (t for t, _ in self.stack) and not any(off for _, off in self.stack):
                self.parts.append(text)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img"):
                self.text += " "
                return
            if tag not in ("a", "b", "em", "i", "span"):
                self.flush()
            names = {n for k, v in attrs if k in ("class", "id") for n in (v or "").split()}
            off = tag in ("nav", "header", "footer", "aside", "form", "script", "style", "head") or bool(names & {"ad", "share", "comments", "cookie", "related"})
            self.stack.append((tag, off))

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "em", "i", "span"):
                self.flush()
            while self.stack and self.stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            self.text += data

    reader = Reader()
    reader.feed(page)
    reader.flush()
    return "\n\n".join(reader.parts)


def test_main_text_brute_force():
    """Random well-formed pages against another parser."""
    rng = random.Random(12)
    words = "river &amp; stone light&nbsp;house seven &lt;b&gt; paper caf&eacute; north &#228; field".split()

    def line(depth=2):
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
            if depth and rng.random() < 0.3:
                w = f"<{(t := rng.choice(('a', 'b', 'em', 'span')))}{rng.choice(('', ' class=nav-link', ' id=ad', chr(32) + 'title=' + chr(34) + 'a > b' + chr(34)))}>{line(depth - 1)}</{t}>"
            out.append(w)
        return rng.choice((" ", "\n\t", "<br>")).join(out)

    def block(depth=3):
        kind = rng.random()
        if kind < 0.5 or not depth:
            return f"<{(t := rng.choice(('p', 'h2', 'blockquote', 'li')))}>{line()}</{t}>"
        if kind < 0.7:
            return f"<{(t := rng.choice(('nav', 'aside', 'form', 'footer')))}>{block(depth - 1)}</{t}>"
        names = rng.choice(("", "share", "ad", "comments", "cookie", "related", "wide", "story-text", "social-history"))
        return f'<{(t := rng.choice(("div", "section")))} class="{names}">' + "".join(block(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{t}>"

    for _ in range(400):
        inner = "".join(block() for _ in range(rng.randrange(1, 6))) + "<p>End</p>"
        page = f"<html><head><title>T</title></head><body><header><p>Site</p></header>{block()}<article>{inner}<script>var a = 1 < 2;</script></article><footer>F</footer></body></html>"
        assert html_extract.main_text(page, None) == plain_main_text(page), page


def template_brute(pages, support, share):
    """Template texts and valid elements of one host's pages, from occurrence vectors as they are."""
    sequences, owner = [], {}
    for page in dict.fromkeys(pages):
        tokens: list = []
        found = html_extract.blocks(page, tokens)
        row = []
        for trail, k in tokens:
            t = html_extract._element(trail) if k is None else html_extract._signature(found[k].path, found[k].text)
            row.append(t)
            own = None if k is None else html_extract._element(trail)
            owner[t] = own if t not in owner or own is None or owner[t] is None else min(owner[t], own)
        sequences.append(row)
    vectors = {}
    for t in owner:
        vectors.setdefault(tuple(row.count(t) for row in sequences), []).append(t)
    classes = {v: ts for v, ts in vectors.items() if sum(map(bool, v)) >= support}
    often = {v for v in classes if sum(map(bool, v)) >= share * len(sequences)}
    framed = {v for v, ts in classes.items() if any(owner[t] is None for t in ts)}
    classes = {v: ts for v, ts in classes.items() if v in often or v in framed}
    class_of = {t: v for v, ts in classes.items() for t in ts}
    forms = {v: set() for v in classes}
    for row in sequences:
        for v, (good, form) in html_extract.nesting(row, class_of).items():
            forms[v].add((good, form))
    out = set()
    for v, ts in classes.items():
        valid = v in framed and len({f for _, f in forms[v]}) == 1 and all(g for g, _ in forms[v])
        for t in ts:
            if (valid or v in often) and (valid or owner[t] is not None):
                out.add((t, valid and (owner[t] is None or owner[t] in ts)))
    return out


def test_template_brute_force(spark):
    rng = random.Random(6)
    parts = ["<div class=\"top\">Home</div>", "<ul><li>One</li><li>Two</li></ul>", "<div><p>Desk</p></div>", "<p>Common line</p>", "<section><h2>More</h2><p>Common line</p></section>"]
    pages = []
    for k in range(24):
        body = [p for p in parts if rng.random() < (0.95, 0.8, 0.4, 0.5, 0.3)[parts.index(p)]]
        body.insert(rng.randrange(len(body) + 1), f"<article><h1>H{k}</h1><p>Text {k}</p>{'<p>Same words</p>' if k % 2 else ''}</article>")
        if rng.random() < 0.2:
            rng.shuffle(body)
        pages.append(f"<html><body>{''.join(body)}</body></html>")
    pages.append(pages[0])
    df = spark.createDataFrame([(7, k % 24, p) for k, p in enumerate(pages)], "host long, ph long, html string")
    for support, share in ((3, 0.6), (2, 0.9), (5, 0.3)):
        got = {(r["signature"], r["sure"]) for r in html_extract.templates(df, support, share).collect()}
        assert got == template_brute(pages, support, share)


def test_odd_pages(spark):
    """Very long and repeated pages, and columns of clashing names."""
    long = "<article>" + "".join(f"<p>Part {k}</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "http://a.b/", long), (2, "http://a.b/", long), (2, "http://a.b/", long), (None, "http://a.b/", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS ph", "'t' AS text", "3 AS n_chars", "4 AS template", "5 AS salt")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:12]) for r in html_extract.extract_main_text(df).collect())
    want = len("\n\n".join(f"Part {k}" for k in range(20_000)))
    assert got == [(0, 1, "x"), (1, want, "Part 0\n\nPart"), (2, want, "Part 0\n\nPart"), (2, want, "Part 0\n\nPart")]


def test_nesting():
    inner = {1: 0, 2: 0, 3: 1, 4: 1}
    assert all(good for good, _ in html_extract.nesting([1, 3, 4, 3, 4, 2], inner).values())
    assert not html_extract.nesting([1, 3, 2, 4], inner)[1][0]  # straddles a token of the other class
    assert not html_extract.nesting([1, 3, 4, 4, 3, 2], inner)[1][0]  # not in one order
    assert html_extract.nesting([1, 2], inner)[0] != html_extract.nesting([2, 1], inner)[0]


def test_more_empty(empty):
    assert packing.pack(empty).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0


def test_ids_beside_null_ids(spark):
    """An id beyond 2**53 stays as it is in a batch that holds a null id."""
    line = "one line that is the same in all of these documents"
    ids = [None, *(2**60 + k for k in range(1, 7))]
    df = spark.createDataFrame([(i, f"{line}\nown {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    pages = df.select(df.doc_id.alias("page_id"), df.text.alias("url"), df.text.alias("html"))
    for out in (packing.pack(df), pii.find_personal_data(df), quality.classify(df, spark.createDataFrame([], "doc_id long, quality int")), html_extract.extract_main_text(pages)):
        assert {r[0] for r in out.collect()} == set(ids)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: f"own {k}" for k, i in enumerate(ids[:-1])} | {ids[-1]: f"{line}\nown {len(ids) - 1}"}


def test_statistics_depend_on_the_text_only():
    x = quality.statistics(pa.array(["b a a c " * 300, "", " ", "one"]))
    assert x[:, quality.NAMES.index("top")].tolist() == [0.5, 0, 0, 1]


def test_pipeline(spark):
    """Every stage against brute force on its own input, and run() against the stages one after another."""
    import corpus_pipeline
    from kinloom.llm.common import staged
    from test_dedup import lines_brute, near_brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = {r["item_id"]: decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        after = staged(after, name)
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        kept = sorted(r[0] for r in after.select("doc_id").collect())
        if name == "quality_classifier":
            forest = quality.train(before, labels)
            scores = forest.score(quality.statistics(pa.array([t or "" for _, t in rows])))
            assert kept == sorted(i for (i, _), s in zip(rows, scores) if s >= 0.5)
        if name == "line_dedup":
            got = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in after.collect())
            assert got == [(a, d) for a, _, _, d in lines_brute(rows)]
            assert all(r["n_chars"] == len(r["text"] or "") for r in after.collect())
        if name == "ngram_jaccard_join":
            assert kept == sorted({c for _, _, c, _ in near_brute(rows, 5, 80)})
        if name == "decontamination":
            for i, t in rows:
                words = decontaminate.words_of((t or "").encode())
                if len(words) > 2000:
                    continue
                held = set(words)
                share = max((leak_brute(item, words) for item in items.values() if len(held & set(item)) >= 0.5 * len(set(item))), default=0)
                assert (i in kept) or share >= 0.5, i
                assert (i not in kept) or share < 0.85, i
        assert 0 < len(kept) <= len(rows)
        before = after
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    ids = {r[0] for r in before.select("doc_id").collect()}
    pieces = key(corpus_pipeline.STAGES[-1][1](spark, before, sf))
    assert {p[0] for p in pieces} == ids
    assert {(p[0], p[4]) for p in key(corpus_pipeline.run(spark, sf))} == {(p[0], p[4]) for p in pieces}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, ties, repeated ids, clashing names and empty tables, stage by stage."""
    import corpus_pipeline

    line = "the same long line in each of these documents, word for word"
    good = [" ".join(f"w{k}x{j} of the" for j in range(30)) + f".\n{line}" for k in range(8)]
    rows = [(k, t) for k, t in enumerate(good)] + [(20, good[2] + " end"), (20, "some other text under a repeated id, that no other document has"), (None, None), (None, good[4]), (31, ""), (32, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS score", "1 AS kept_id", "2 AS leak_id", "3 AS gone_id", "4 AS may", "5 AS line_th", "6 AS id", "7 AS th", "8 AS n", "cast(length(text) AS long) AS n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, " ".join(f"w5x{j} of the" for j in range(12)))], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stages[name](spark, df, str(tmp_path)) for name in list(stages)[:-1]}
    assert all(o.columns == df.columns for o in out.values())
    ids = {name: sorted((-1 if r[0] is None else r[0]) for r in o.select("doc_id").collect()) for name, o in out.items()}
    every = sorted(-1 if i is None else i for i, _ in rows)
    assert ids["quality_classifier"] == every  # no labels: nothing is rejected
    assert ids["line_dedup"] == every
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in out["line_dedup"].collect()]
    assert {i for i, t, _ in texts if t and line in t} == {7, 20} and all(n == (None if t is None else len(t)) for _, t, n in texts)
    assert ids["ngram_jaccard_join"] == sorted([-1, -1, *range(8), 20, 20, 31, 32])  # both ids are also ids of other texts
    assert ids["decontamination"] == sorted(x for x in every if x != 5)
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])


def test_sketch_of_a_stretch_needs_little_memory():
    """Sums over many terms and a wide sketch are made in portions: the same numbers, without tables of all terms."""
    import tracemalloc

    from kinloom.llm import decontaminate

    rng = np.random.default_rng(3)
    passage = np.repeat(np.arange(4000), 10)
    term, count = rng.integers(0, 500, len(passage)), np.ones(len(passage), dtype="int64")
    omega, idf, c = rng.standard_normal((500, 320)), rng.random(500) + 0.1, np.zeros((500, 320))
    tracemalloc.start()
    decontaminate._add(c, passage, term, count, idf, omega)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20  # one table of all terms would be 102 MB
    w = idf[term].reshape(-1, 10)
    a = np.zeros((4000, 500))
    np.add.at(a, (passage, term), (w / np.linalg.norm(w, axis=1, keepdims=True)).ravel())
    assert np.allclose(c, a.T @ (a @ omega))


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """Labels past a bound were left out: here the first labels by hash say nothing, those after them tell junk."""
    own = spark.range(600).selectExpr("id AS doc_id", "if(id % 2 = 0, concat_ws(' ', 'Some plain words of a text,', id, 'and more.'), concat_ws(' ', '$$$ !!!', id, '@@@ ###')) AS text")
    labels = own.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) AS quality")
    monkeypatch.setattr(quality, "EDGE_ROWS", 10)
    monkeypatch.setattr(quality, "TRAIN_ROWS", 10, raising=False)
    seen = []
    grow = quality.gbdt.grow
    monkeypatch.setattr(quality.gbdt, "grow", lambda at, y, w, cuts: seen.append(w.sum()) or grow(at, y, w, cuts))
    forest = quality.train(own, labels)
    assert seen == [labels.filter("crc32(cast(doc_id as string)) % 3 != 1").count()]
    assert {(r["doc_id"] % 2 == 0) == (r["score"] >= 0.5) for r in quality.score(own, forest).collect()} == {True}
