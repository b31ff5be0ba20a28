"""Vector code compression: product codebooks whose nearest entries are found by equal-average search.

Plan
1. vectors become integers, floor(scale * x), cut into ``parts`` consecutive parts, and are staged once;
2. each part's codebook starts as that part of the ``entries`` vectors with the smallest ids (one bounded top-k);
3. in each round the codebooks (``entries`` vectors in all) are broadcast; a task searches the nearest entry of each of its
   vectors' parts and returns one row of sums for each entry it used, which Spark adds up; the driver divides;
4. the last search gives the codes; errors are summed by label before they are joined back.

Equal-average search: the entries of a part are sorted by the sum of their components.  The squared distance of two
vectors of d components is at least the squared difference of their sums over d, so a search begins at the part's own sum,
takes the nearer of the next entries on either side, and ends when the squared gap over d is strictly greater than the best
squared distance: all entries at the best distance have been seen by then, and the lowest index wins.  All searches of
a batch step together, those that have ended leave.  Nothing is approximate.

Defined results: rows whose vector is null, empty, holds null or non-finite components or is not as long as most kept
vectors (of two lengths that are equally frequent, the shorter) are dropped; a length that the parts do not divide leaves
the last parts a component shorter; integers beyond +-2^30 / (components of a part), or 2^28, are cut there, so that no distance
overflows; null ids come last, and repeated ids are ordered by their vectors; with fewer vectors than entries the
codebook is that short; labels that are null count as equal; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import looked_up, staged, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = (1 << 63) - 1


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of book for each row of vectors (int64), ties to the lower index."""
    n, d = vectors.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    held, sums = book[order], sums[order]
    own = vectors.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best, index = np.full(n, MOST // d), np.full(n, len(book))
    far = np.int64(1) << 40  # over any difference of sums
    low, high = np.concatenate([[-far], sums]), np.concatenate([sums, [far]])  # at left + 1 and right, fenced
    open_ = np.arange(n)
    while len(open_):
        below, above = own[open_] - low[left[open_] + 1], high[right[open_]] - own[open_]
        down = below <= above
        gap = np.where(down, below, above)
        going = (gap < far >> 1) & (np.minimum(gap, 1 << 31) ** 2 <= best[open_] * d)
        open_, down = open_[going], down[going]
        at = np.where(down, left[open_], right[open_])
        left[open_[down]] -= 1
        right[open_[~down]] += 1
        entry = order[at]
        distance = np.square(vectors[open_] - held[at]).sum(axis=1)
        closer = (distance < best[open_]) | ((distance == best[open_]) & (entry < index[open_]))
        where = open_[closer]
        best[where], index[where] = distance[closer], entry[closer]
    return index, best


def _widths(d: int, parts: int) -> list[slice]:
    edges = np.cumsum([0, *[d // parts + (k < d % parts) for k in range(parts)]])
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("x")
    return v.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, books, cuts: list[slice]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (vectors, sums of their components) of the entries that are nearest to some part."""
    schema = "part int, entry int, n long, s array<long>"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        count = [np.zeros(len(b), dtype="int64") for b in books.value]
        total = [np.zeros_like(b) for b in books.value]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for k, cut in enumerate(cuts):
                    index, _ = nearest(x[:, cut], books.value[k])
                    np.add.at(total[k], index, x[:, cut])
                    count[k] += np.bincount(index, minlength=len(count[k]))
        rows_ = [(k, int(e), int(count[k][e]), total[k][e].tolist()) for k in range(len(cuts)) for e in np.flatnonzero(count[k])]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows_), out)], schema=out)

    found = rows.select("x").mapInArrow(run, schema)
    each = found.select("part", "entry", "n", F.posexplode("s").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums: dict = {}
    for part, entry, at, n, s in each.collect():  # a row a component of a codebook, whatever the table
        sums.setdefault((part, entry), (n, {}))[1][at] = s
    return {key: (n, [s[k] for k in sorted(s)]) for key, (n, s) in sums.items()}


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[slice]]:
    """(an int64 matrix of entries for each part, the parts' slices); rows: (id, label, x), staged."""
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return [], []
    start = np.array([r["x"] for r in first], dtype="int64")
    cuts = _widths(start.shape[1], parts)
    books = [start[:, cut].copy() for cut in cuts]
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(books)
        for (part, entry), (n, s) in _sums(rows, held, cuts).items():
            books[part][entry] = [v // n for v in s]
        held.unpersist()
    return books, cuts


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """(DataFrame (id, label, code array<int>, error long, label_error long), codebooks)."""
    most = F.greatest(F.lit(1), F.ceil(F.size("v") / parts))
    most = F.least(F.lit(1 << 28), F.floor(F.lit(1 << 30) / most)).cast("double")
    ints = F.transform("v", lambda c: F.greatest(-most, F.least(most, F.floor(c * scale).cast("double"))).cast("int"))
    kept = whole_vectors(df, vector_col, F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    rows = staged(kept.select("id", "label", ints.alias("x")), "vectors")
    books, cuts = codebooks(rows, parts, entries, rounds)
    held = rows.sparkSession.sparkContext.broadcast(books)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kind['id']}, label {kind['label']}, code array<int>, error long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            found = [nearest(x[:, cut], held.value[k]) for k, cut in enumerate(cuts)]
            code, error = np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype="int32") * len(cuts)), pa.array(code.ravel().astype("int32")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes.cast(out.field("code").type), pa.array(error)], schema=out)

    coded = staged(rows.mapInArrow(run, schema), "codes")
    by_label = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return looked_up(coded, by_label, "label"), books


def query(spark, sf_dir):
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = ",".join(str(v) for book in books for v in book.ravel().tolist())
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    near = """
{a} AS (
  SELECT n, p, min_by(i, (d, i)) AS i, min(d) AS d FROM (
    SELECT x.n, x.p, b.i, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN {b} b ON x.p = b.p) GROUP BY n, p)"""
    step = """
{c} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(m.x, b.x) AS x FROM {b} b LEFT JOIN (
    SELECT p, i, list(floor_sum ORDER BY pos) AS x FROM (
      SELECT p, i, pos, (sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS floor_sum
      FROM (SELECT x.p, a.i, unnest(x.x) AS v, unnest(range(len(x.x))) AS pos FROM x JOIN {a} a ON x.n = a.n AND x.p = a.p)
      GROUP BY p, i, pos) GROUP BY p, i) m ON b.p = m.p AND b.i = m.i)"""
    out = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT n, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, n AS i, x FROM x WHERE n < 256)"""
    for k in range(ROUNDS):
        out += "," + near.format(a=f"a{k}", b=f"b{k}").replace(" AS (", " AS MATERIALIZED (", 1) + "," + step.format(a=f"a{k}", b=f"b{k}", c=f"b{k + 1}")
    out += "," + near.format(a="z", b=f"b{ROUNDS}").replace(" AS (", " AS MATERIALIZED (", 1)
    return out + f""",
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, i)) AS codebooks_sha256 FROM (SELECT p, i, array_to_string(x, ',') AS t FROM b{ROUNDS})),
r AS (SELECT n, string_agg(format('{{:02x}}', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN v USING (n), h
"""


SQL = _sql()
