"""Embedding whitening by Chan's merging of partition moments.

1. Each partition computes the count, the exact sums, and the scatter around its own mean of its integer vectors.
2. treeReduce merges these pairwise: M = Ma + Mb + (na * nb / n) * outer(delta, delta), where delta comes from the exact
   sums, so that the offset of the entries costs no digits.
3. The driver solves the symmetric eigenproblem of one dim x dim matrix; it holds nothing else.
4. A second pass projects all vectors, and merges the moments of the projections the same way, for the identity's error.

Entries become x = floor(1024 * c) + 100000. Vectors that are null or hold null or non-finite entries are dropped, and so are
those with an entry so large that x has no place in 62 bits, and those whose length is not the commonest one (of equally
common lengths the longer). Repeated rows and ids count as often as they come; null ids stay. Components without variance
(all vectors equal in that direction, as in a table of one row) have null as `whitened`. The sum of squares is exact; where
it has no place in a long, `deviation` is null and `deviation_exact` still has its digits. An empty table gives no rows.
Only the id and the vector are read, so other columns can have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components of the result.
COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024.0, 100000, 2.0**62
#: Rows of vectors handled at once.
BLOCK = 4096


@dataclass
class Moments:
    """Count, sums (exact Python integers for integer vectors) and the scatter around the mean."""

    n: int
    sums: list
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        # The means' difference from the sums; with integers no digit is lost before the division.
        delta = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n))


def _sums(x: np.ndarray) -> list:
    """Exact column sums: halves of 32 bits cannot overflow."""
    if x.dtype.kind == "f":
        return x.sum(axis=0).tolist()
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(k) for h, k in zip(high.sum(axis=0), low.sum(axis=0))]


def moments(x: np.ndarray) -> Moments:
    sums, n = _sums(x), len(x)
    if x.dtype.kind == "f":
        centred = x - np.array(sums) / n
    else:
        whole = [s // n for s in sums]
        centred = (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - n * w) / n for s, w in zip(sums, whole)])
    return Moments(n, sums, centred.T @ centred)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _partition_moments(dim: int, view):
    """One row for each partition; view: what is measured of a block of vectors."""

    def run(batches):
        total = None
        for batch in batches:
            x = _vectors(batch, dim)
            for k in range(0, len(x), BLOCK):
                found = moments(view(x[k : k + BLOCK]))
                total = found if total is None else total.merged(found)
        if total:
            yield pa.RecordBatch.from_pydict({"n": [total.n], "sums": [[str(s) if isinstance(s, int) else s.hex() for s in total.sums]], "scatter": [total.scatter.ravel()]})

    return run


def gather(vectors: DataFrame, dim: int, view, exact: bool = True) -> Moments:
    """The moments of all rows; partitions are merged pairwise on the executors."""
    rows = vectors.mapInArrow(_partition_moments(dim, view), "n long, sums array<string>, scatter array<double>").rdd
    read = int if exact else float.fromhex
    each = rows.map(lambda r: Moments(r.n, [read(s) for s in r.sums], np.array(r.scatter).reshape(len(r.sums), -1)))
    return each.treeReduce(Moments.merged)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    """(id, x) of the vectors that remain, and their length."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < LARGEST / SCALE))  # false for NaN and infinity too
    kept = rows.select(F.col(id_col).cast("long").alias("id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0)).where(fine)
    common = kept.groupBy(F.size("c").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return kept, None
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return kept.where(F.size("c") == common.dim).select("id", x.alias("x")), common.dim


@dataclass
class Whitening:
    """n, exact sums, and the first components as rows: unit vectors, eigenvalues, and the share of the whole variance."""

    n: int
    sums: list
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the components that have variance."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole)])
        live = self.values > 0
        return ((x - np.array(whole, np.int64)).astype(np.float64) - rest) @ (self.axes[live] / np.sqrt(self.values[live])[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - sum) squared."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        near, rest = x - whole, [s - self.n * int(w) for s, w in zip(self.sums, whole)]
        largest = int(np.abs(near).max(initial=0)) * self.n + self.n
        if largest**2 * x.shape[1] < 2**63:
            far = near * self.n - np.array(rest, np.int64)
            return (far * far).sum(axis=1).tolist()
        return [sum((v * self.n - r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    total = gather(vectors, dim, lambda x: x)
    covariance = total.scatter / total.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1].T
    trace = float(np.trace(covariance))
    values = np.where(values > max(dim, 2) * np.finfo(float).eps * max(values[0], 0), values, 0.0)[:components]
    return Whitening(total.n, total.sums, np.ascontiguousarray(axes[:components]), values, values / trace if trace > 0 else np.zeros(len(values)))


def identity_error(vectors: DataFrame, dim: int, model: Whitening) -> float | None:
    """The largest entry of the whitened covariance minus the identity, from a pass over all vectors; null without variance."""
    if not (model.values > 0).any():
        return None
    seen = gather(vectors, dim, model.project, exact=False)
    return float(np.abs(seen.scatter / seen.n - np.eye(len(seen.sums))).max())


_RESULT = "id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"


def _whitened(dim: int, model: Whitening, error: float | None):
    k = len(model.values)

    def run(batches):
        for batch in batches:
            x = _vectors(batch, dim)
            ids = batch["id"]
            for at in range(0, len(x), BLOCK):
                block = x[at : at + BLOCK]
                m = len(block)
                out, live = np.full((m, k), np.nan), model.values > 0
                out[:, live] = model.project(block)
                exact = model.deviations(block)
                row = np.repeat(np.arange(m), k)
                far = pa.array([d if d < 2**63 else None for d in exact], pa.int64()).take(pa.array(row))
                columns = [ids.slice(at, m).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), far, pa.array([str(d) for d in exact]).take(pa.array(row))]
                columns += [pa.array(out.ravel(), mask=np.isnan(out.ravel())), pa.array(np.tile(model.explained, m)), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, deviation_exact, whitened, explained, identity_error), a row for each vector and component."""
    vectors, dim = integer_vectors(rows, id_col, vector_col)
    if dim is None:
        return rows.sparkSession.createDataFrame([], _RESULT).withColumnRenamed("id", id_col)
    model = fit(vectors, dim, components)
    return vectors.mapInArrow(_whitened(dim, model, identity_error(vectors, dim, model)), _RESULT).withColumnRenamed("id", id_col)
