"""Embedding whitening: incremental eigendecomposition by rank-one updates.

Plan
1. vectors become integers, floor(64 * c) + 1000000, and are staged once;
2. each task keeps (n, sums, mean, eigenvalues, eigenvectors) of the scatter of its rows and adds each row by a centred
   rank-one update: with the row's difference from the mean, A + w v v' has the eigenvalues that solve the secular
   equation 1 + w sum z_i^2 / (d_i - x) = 0, one between each two of A's; a direction that v misses, or one of two with equal
   eigenvalues, is deflated: it stays as it is.  Equal rows of a batch are one update of their weight;
3. spectra (a row of dimension squared numbers for each task) are combined in a tree of ``FAN`` at a time: the second's
   eigenpairs are added to the first one by one as rank-one updates, then the difference of the means;
4. Rayleigh-Ritz: tasks sum the products of their centred rows' projections on the basis, which is complete; the
   eigenvectors of that small matrix turn the basis into V's eigenvectors to double precision, whatever rounding the
   updates have gathered;
5. another pass over all rows measures the covariance of what is whitened; the last one writes the result.

Sums are exact integers; rows are centred by integers before anything is multiplied.  The basis is one for all rows, a
component's largest entry (the first of equals) being positive.

Defined results: rows whose vector is null, empty, holds null or non-finite entries or is not as long as most kept vectors
(of two lengths that are equally frequent, the shorter) are dropped; entries beyond +-2^33 are cut there; components whose
eigenvalue is nothing but rounding (under 10^-13 of the largest) cannot be whitened and are left out, so one vector, or
equal ones, give no rows; a deviation beyond a long is null; null and repeated ids are kept as they are; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import staged, whole_vectors

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Spectra, or sums, that meet in one task.
FAN = 8
EPS = np.finfo("float64").eps
#: Shares of the largest eigenvalue under which one is rounding.
RANK = 1e-13
SPECTRUM = "node long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"
MATRIX = "node long, cells array<double>"


def secular(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(roots, differences d_i - root_j as [j, i]) of 1 + rho sum z2_i / (d_i - x); d ascends strictly, all z2 > 0.

    Each root is sought as its distance from the nearer of its two poles, which keeps the differences accurate: a
    bracket is narrowed by the root of a model with the two poles, and halved where the model leaves it.
    """
    k = len(d)
    j = np.arange(k)
    width = np.append(np.diff(d), rho * z2.sum())
    middle = (d[None, :] - d[:, None]) - (width / 2)[:, None]
    left = (1 / rho + (z2 / middle).sum(axis=1) >= 0) | (j == k - 1)  # the last root has one pole
    origin = np.where(left, j, np.minimum(j + 1, k - 1))
    delta = d[None, :] - d[origin][:, None]
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, np.where(j == k - 1, width, width / 2), 0.0)
    mu = (low + high) / 2
    upto = (j[None, :] <= j[:, None]).astype("float64")
    for _ in range(100):
        diff = delta - mu[:, None]
        inverse = 1 / diff
        psi, total = (inverse * upto) @ z2, inverse @ z2  # the terms of the poles under a root are negative
        f = 1 / rho + total
        done = np.abs(f) <= 4 * EPS * k * (1 / rho + total - 2 * psi)
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        if done.all() or (high - low <= EPS * np.abs(mu)).all():
            break
        inverse *= inverse
        slope, below = inverse @ z2, (inverse * upto) @ z2
        above = slope - below
        d1, d2 = diff[j, j], diff[j, np.minimum(j + 1, k - 1)]
        c = f - d1 * below - d2 * above
        a, b = (d1 + d2) * f - d1 * d2 * slope, d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            one = f - d1 * below
            last = d1 + d1 * d1 * below / one  # the model of a single pole
        step = np.where(j == k - 1, last, step)
        new = mu + step
        good = np.isfinite(new) & (new > low) & (new < high)
        mu = np.where(done, mu, np.where(good, new, (low + high) / 2))
    return d[origin] + mu, delta - mu[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (ascending) of vectors diag(values) vectors' + weight v v'."""
    size = float(np.sqrt(v @ v))
    rho = weight * size * size
    if not rho > 0:
        return values, vectors
    z = vectors.T @ (v / size)
    tol = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    live = np.abs(rho * z) > tol
    keep = np.flatnonzero(live)
    if len(keep) > 1:
        gap, both = np.diff(values[keep]), np.hypot(z[keep[1:]], z[keep[:-1]])
        if (gap * np.abs(z[keep[1:]] * z[keep[:-1]]) <= tol * both * both).any():  # some eigenvalues are as good as equal
            vectors, z, before = vectors.copy(), z.copy(), keep[0]
            for at in keep[1:]:
                tau = float(np.hypot(z[at], z[before]))
                c, s = z[at] / tau, -z[before] / tau
                if (values[at] - values[before]) * abs(c * s) <= tol:  # turn the pair until v misses the first
                    first, second = vectors[:, before].copy(), vectors[:, at].copy()
                    vectors[:, before], vectors[:, at] = c * first + s * second, c * second - s * first
                    z[at], live[before] = tau, False
                before = at
            keep = np.flatnonzero(live)
    if not len(keep):
        return values, vectors
    d, zk = values[keep], z[keep]
    if len(keep) == 1:
        new, turned = d + rho * zk * zk, vectors[:, keep]
    else:
        new, diff = secular(d, zk * zk, rho)
        ratio = d[:, None] - d[None, :]  # [j, i]: d_j - d_i
        np.fill_diagonal(ratio, 1.0)
        # the z for which the roots found are exact, so that the vectors are orthogonal
        exact = np.sqrt(np.abs(np.prod(diff / ratio, axis=0))) * np.sign(zk)
        w = (exact[None, :] / diff).T
        turned = vectors[:, keep] @ (w / np.sqrt((w * w).sum(axis=0)))
    values, vectors = values.copy(), vectors.copy()
    values[keep], vectors[:, keep] = new, turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Eigenpairs of the scatter of the vectors seen so far."""

    def __init__(self, n: int, sums, mean, values, vectors):
        self.n, self.sums, self.mean, self.values, self.vectors = n, sums, mean, values, vectors

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, dtype="int64"), np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray, times: int) -> None:
        n = self.n + times
        apart = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * times / n)
        self.mean = self.mean + apart * (times / n)
        self.n, self.sums = n, self.sums + x * times

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        n = self.n + other.n
        apart = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, node: int) -> tuple:
        return node, self.n, self.sums.tolist(), self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        values = np.array(row["values"])
        return cls(row["n"], np.array(row["sums"], dtype="int64"), np.array(row["mean"]), values, np.array(row["vectors"]).reshape(len(values), -1))


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(batch.num_rows, -1)


def _in_tree(nodes: DataFrame, merge, schema: str, name: str) -> dict | None:
    """The one row that is left when rows (node, ...) are merged, FAN at a time."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        return pa.Table.from_batches([_batch([merge(key[0].as_py(), rows)], out)])

    nodes = staged(nodes, name)
    while (n := nodes.count()) > 1:
        group = F.floor(F.col("node") / FAN) if n > FAN else F.lit(0).cast("long")
        nodes = staged(nodes.groupBy(group.alias("group")).applyInArrow(run, schema), name)
    found = nodes.first()
    return found.asDict() if found else None


def spectrum(rows: DataFrame) -> Spectrum | None:
    """Eigenpairs of the scatter of all x of rows, as the updates and merges left them."""
    out = to_arrow_schema(StructType.fromDDL(SPECTRUM))

    def run(batches):
        own = None
        for batch in batches:
            if batch.num_rows:
                each, times = np.unique(_matrix(batch), axis=0, return_counts=True)
                own = own or Spectrum.empty(each.shape[1])
                for x, w in zip(each, times.tolist()):
                    own.add(x, w)
        if own:
            yield _batch([own.row(TaskContext.get().partitionId())], out)

    def merge(node: int, each: list[dict]) -> tuple:
        first = Spectrum.of(each[0])
        for r in each[1:]:
            first.merge(Spectrum.of(r))
        return first.row(node)

    found = _in_tree(rows.select("x").mapInArrow(run, SPECTRUM), merge, SPECTRUM, "spectra")
    return Spectrum.of(found) if found else None


def _moments(rows: DataFrame, project, d: int) -> np.ndarray:
    """Sum of p'p over the rows p of project(x)."""
    out = to_arrow_schema(StructType.fromDDL(MATRIX))

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                p = project(_matrix(batch))
                total = p.T @ p if total is None else total + p.T @ p
        if total is not None:
            yield _batch([(TaskContext.get().partitionId(), total.ravel().tolist())], out)

    def merge(node: int, each: list[dict]) -> tuple:
        return node, np.sum([r["cells"] for r in each], axis=0).tolist()

    return np.array(_in_tree(rows.select("x").mapInArrow(run, MATRIX), merge, MATRIX, "moments")["cells"]).reshape(d, d)


class Whitening:
    """What turns integer vectors into whitened ones."""

    def __init__(self, n: int, sums: np.ndarray, basis: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.basis, self.values, self.trace = n, sums, basis, values, trace
        self.base = np.array([int(s) // n for s in sums], dtype="int64")
        self.rest = np.array([int(s) - n * int(b) for s, b in zip(sums, self.base)], dtype="int64")  # n * mean = n * base + rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list:
        c = x - self.base
        if np.abs(c).max(initial=0) < (1 << 62) // self.n and ((most := int(np.abs(c).max(initial=0)) * self.n + self.n) ** 2 * x.shape[1]) < 1 << 63 and most:
            return ((self.n * c - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist())) for row in c.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """The first `most` components of rows (x array<long>, staged); None without rows."""
    found = spectrum(rows)
    if found is None:
        return None
    d = len(found.values)
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    start = Whitening(found.n, found.sums, basis, np.ones(d), 0.0)
    ritz = _moments(rows, lambda x: start.centred(x) @ basis, d) / found.n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    k = int(((values > RANK * max(values[0], 0)) & (values > 0))[:most].sum())
    vectors = vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return Whitening(found.n, found.sums, vectors, values[:k], float(np.trace(ritz)))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each kept row and component."""
    edge = float(1 << 33)
    ints = F.transform("v", lambda c: (F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), c)) * SCALE) + F.lit(SHIFT)).cast("long"))
    rows = staged(whole_vectors(df, vector_col, F.col(id_col).alias("id")).select("id", ints.alias("x")), "whitening")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = to_arrow_schema(StructType.fromDDL(schema))
    model = fit(rows, most)
    k = 0 if model is None else len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    apart = float(np.abs(_moments(rows, model.whitened, k) / model.n - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, m = _matrix(part), part.num_rows
                where = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("id").take(where), pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(where),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, apart)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
