"""Vector codes, whitening and source mixing against plain versions, and their odd cases."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest

from kinloom.llm import source_mix, vector_codes, whitening

NAN, INF = float("nan"), float("inf")


def vectors(n=400, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (12, d))
    v = (centre[rng.integers(0, 12, n)] + rng.normal(0, 0.2, (n, d))).astype("float32")
    v[50:60] = v[3]  # copies
    return [(int(k), [float(x) for x in row], int(k % 5) if k % 7 else None) for k, row in enumerate(v)]


ODD = [(None, [0.25] * 8, 3), (7, [0.5] * 8, 1), (9001, None, 1), (9002, [], 1), (9003, [0.1, None] * 4, 2), (9004, [NAN] * 8, 2), (9005, [INF] + [0.0] * 7, None), (9006, [0.5] * 4, 1), (9007, [1e30] * 8, 4), (9008, [-1e30] * 8, 4)]


@pytest.fixture(scope="module")
def table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(vectors() + ODD, "vec_id long, embedding array<float>, label int")
    return df.withColumns({"id": F.lit("x"), "v": F.lit(1), "x": F.lit(2.0), "code": F.lit(None).cast("int"), "looked_key": F.lit(1), "n": F.lit(0)}).repartition(3)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], "vec_id long, embedding array<float>, label int")


def kept():
    return [r for r in vectors() + ODD if r[1] and len(r[1]) == 8 and all(x is not None and np.isfinite(x) for x in r[1])]


def test_equal_average_search():
    rng = np.random.default_rng(0)
    for d in (1, 2, 16):
        for entries in (1, 2, 37, 256):
            book = rng.integers(-6, 7, (entries, d))
            own = rng.integers(-9, 10, (300, d))
            index, distance = vector_codes.nearest(own, book)
            every = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    edge = np.full((3, 16), 1 << 26)
    index, distance = vector_codes.nearest(-edge, edge)
    assert index.tolist() == [0] * 3 and (distance == 16 << 54).all()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    d = 8 // parts
    most = min(1 << 28, (1 << 30) // d)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[max(-most, min(most, int(np.floor(Fraction(c) * 1024)))) if abs(c) < 1e20 else (most if c > 0 else -most) for c in r[1]] for r in rows]
    x = np.array(x, dtype=object)
    cut = [x[:, k * d : (k + 1) * d] for k in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def nearest(c, b):
        every = [[int(((v - e) ** 2).sum()) for e in b] for v in c]
        return [min(range(len(b)), key=lambda i: (q[i], i)) for q in every], [min(q) for q in every]

    for _ in range(rounds):
        for c, b in zip(cut, books):
            index = nearest(c, b)[0]
            for e in set(index):
                own = [v for v, i in zip(c, index) if i == e]
                b[e] = [s // len(own) for s in np.sum(own, axis=0)]
    found = [nearest(c, b) for c, b in zip(cut, books)]
    error = [sum(f[1][k] for f in found) for k in range(len(rows))]
    return [(r[0], [f[0][k] for f in found], error[k], sum(e for e, o in zip(error, rows) if o[2] == r[2])) for k, r in enumerate(rows)], books


def test_vector_codes(table):
    got, books = vector_codes.compress(table, entries=32)
    want, plain = plain_codes(kept(), entries=32)
    assert [b.tolist() for b in books] == [b.tolist() for b in plain]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r["id"], r["code"], r["error"], r["label_error"]) for r in got.collect()], key=order) == sorted(want, key=order)


def test_vector_codes_short_and_empty(spark, no_vectors):
    got, books = vector_codes.compress(no_vectors)
    assert got.count() == 0 and books == []
    some = spark.createDataFrame([(2, [1.0, 2.0, 3.0], 1), (1, [1.5, 2.0, 2.0], None)], no_vectors.schema)
    rows = vector_codes.compress(some)[0].collect()
    assert sorted((r["id"], r["code"], r["error"]) for r in rows) == [(1, [0, 0, 0], 0), (2, [1, 0, 1], 0)]


def test_vector_codes_sql(spark, table, tmp_path):
    import duckdb

    path = str(tmp_path)
    table.filter("vec_id is null or vec_id < 9006").filter("embedding is null or size(embedding) != 0").select("vec_id", "embedding", "label").write.parquet(f"{path}/embeddings.parquet")
    got = sorted(map(repr, map(tuple, vector_codes.query(spark, path).collect())))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    assert got == sorted(map(repr, duckdb.sql(vector_codes.SQL).fetchall()))


@pytest.mark.parametrize("kind", ["any", "deficient", "repeats", "ordered"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(2)
    for d, n in ((1, 4), (2, 9), (6, 4), (16, 120)):
        x = rng.integers(-40, 40, (n, d)) + 1_000_000
        if kind == "deficient":
            x[:, d // 2 :] = x[:, :1]
        elif kind == "repeats":
            x = x[rng.integers(0, max(1, n // 4), n)]
        elif kind == "ordered":
            x = np.sort(x, axis=0)
        halves = []
        for part in (x[: n // 2], x[n // 2 :]):
            s = whitening.Spectrum.empty(d)
            for v, w in zip(*np.unique(part, axis=0, return_counts=True)):
                s.add(v, int(w))
            halves.append(s)
        halves[0].merge(halves[1])
        s, c = halves[0], x - x.mean(axis=0)
        scatter = c.T @ c
        assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() <= 1e-9 * max(1, np.abs(scatter).max())
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-10 and s.n == n and (s.sums == x.sum(axis=0)).all()


def test_whitening(table):
    rows = [r for r in kept() if abs(r[1][0]) < 1e20]
    got = whitening.whiten(table.filter("vec_id is null or vec_id < 9007"), most=5).toPandas().sort_values(["id", "deviation", "component"], na_position="last")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[int(np.floor(Fraction(c) * 64)) + 1_000_000 for c in r[1]] for r in rows])
    n, c = len(x), x - x.mean(axis=0)
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    assert got.shape[0] == 5 * n and set(got.n) == {n}
    assert np.allclose(got.explained.to_numpy().reshape(n, 5), (values / values.sum())[:5], rtol=1e-9)
    want, own = c @ u[:, :5] / np.sqrt(values[:5]), got.whitened.to_numpy().reshape(n, 5)
    twice = [k for k in range(n) if rows[k][0] == 7]  # a repeated id: its two rows in either order
    rest = [k for k in range(n) if k not in twice]
    assert np.allclose(np.abs(own[rest]), np.abs(want[rest]), atol=1e-8)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    s = x.sum(axis=0).astype(object)
    deviation = [int((((n * v.astype(object)) - s) ** 2).sum()) for v in x]
    assert sorted(got.deviation[::5]) == sorted(deviation)


def test_whitening_odd(spark, table, no_vectors):
    assert whitening.whiten(no_vectors).count() == 0
    assert whitening.whiten(table.filter("vec_id = 3")).count() == 0  # one vector has no covariance
    assert whitening.whiten(table.filter("vec_id between 50 and 59")).count() == 0  # nor have equal ones
    big = whitening.whiten(table.filter("vec_id > 9006")).collect()  # entries of 10^30 are cut
    assert {r["component"] for r in big} == {1} and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in big)


def exact_targets(sizes):
    """Targets as the rule says it: share out, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, capped = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        rest, left = goal - sum(capped.values()), [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if target[s] > 2 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: Fraction(2 * sizes[s]) for s in over}


def mixed(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        source = ["a", "b", "Ä", "b2", None, "zero"][min(5, int(rng.integers(0, 9)) % 6)] if k % 3 else "hot"
        words = 0 if source == "zero" else int(rng.integers(0, 60)) if k != 30 else 3000
        rows.append((k, " \t".join(["w"] * words) if words or k % 2 else None, source))
    rows += [rows[5], rows[5], (None, "one two\x0bthree", None), (None, None, "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_source_mix(spark):
    from pyspark.sql import functions as F

    rows, df = mixed(spark)
    df = df.withColumns({"row": F.lit(1), "src": F.lit("x"), "size": F.lit(2), "target": F.lit(None).cast("int"), "part": F.lit(0)}).repartition(3)
    found, schedule = source_mix.mix(df, block=16)
    got, slots = found.collect(), schedule.toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = exact_targets(sizes)
    want = sorted((str(i), size(t), sizes[s], float(targets[s])) for i, t, s in rows)
    assert [(a, b, c) for a, b, c, _ in want] == sorted((str(r["id"]), r["size"], r["source_size"]) for r in got)
    for r, w in zip(sorted(got, key=lambda r: (str(r["id"]), r["size"], r["source_size"], r["target"])), want):
        assert r["target"] == pytest.approx(w[3]) and 0 <= r["taken"] <= 2 * r["size"]
    taken = {}
    for r in got:
        taken.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(sum(v) == int(t) for (_, t), v in taken.items() if len(v) > 1)
    # the schedule: blocks of equal words, each word of a document at most once a pass, every stretch near the shares
    assert slots.groupby(["row", "pass"]).length.sum().max() <= 3000 and slots.slot.nunique() == slots[["src", "block"]].drop_duplicates().shape[0]
    words = slots.groupby(["src", "block"]).length.sum()
    assert all((own.iloc[:-1] == 16).all() for _, own in words.groupby(level=0))
    seen = slots[["slot", "src", "block"]].drop_duplicates().sort_values("slot")
    for _, own in seen.groupby("src"):
        assert own.block.tolist() == list(range(len(own)))
    share = seen.src.value_counts(normalize=True)
    for stop in (64, 100, len(seen) - 20):
        counts = seen.src.iloc[:stop].value_counts()
        assert all(abs(counts.get(s, 0) - stop * p) <= 6 for s, p in share.items())
    again = source_mix.mix(df.repartition(5), block=16)[0].collect()
    key = lambda r: (str(r["id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_source_mix_ranges(spark, monkeypatch):
    """Many ranges and chunks, and a table of sources too long to broadcast, give the same."""
    rows, df = mixed(spark)
    plain = sorted(map(str, source_mix.mix(df, block=4)[0].drop("row").collect()))
    monkeypatch.setattr(source_mix, "RANGE_ROWS", 10)
    monkeypatch.setattr(source_mix, "CHUNK", 8)
    monkeypatch.setattr("kinloom.llm.common.MOST_BROADCAST", 2)
    assert sorted(map(str, source_mix.mix(df, block=4)[0].drop("row").collect())) == plain


def test_source_mix_odd(spark):
    schema = "doc_id long, text string, source string"
    for rows in ([], [(1, None, None)], [(1, " ", "a"), (1, " ", "a")]):
        found, schedule = source_mix.mix(spark.createDataFrame(rows, schema))
        assert [r["taken"] for r in found.collect()] == [0] * len(rows) and schedule.count() == 0
    one = source_mix.mix(spark.createDataFrame([(1, "a b c", None)], schema))[0].first()
    assert (one["target"], one["taken"]) == (4.5, 4)


def test_source_mix_sql(spark, tmp_path):
    import duckdb

    _, df = mixed(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, source_mix.query(spark, str(tmp_path)).collect())))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(repr, duckdb.sql(source_mix.SQL).fetchall()))


def test_digest_of_codebooks(spark, table, tmp_path):
    table.select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = vector_codes.query(spark, str(tmp_path)).collect()
    books = plain_codes(kept())[1]
    text = ",".join(str(v) for b in books for e in b for v in e)
    assert {r["codebooks_sha256"] for r in rows} == {hashlib.sha256(text.encode()).hexdigest()} and all(re.fullmatch("[0-9a-f]{8}", r["code"]) for r in rows)
