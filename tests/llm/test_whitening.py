"""Whitening against exact rational arithmetic and numpy's own covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from veinstone.llm import whitening

SCHEMA = T.StructType().add("vec_id", T.LongType()).add("embedding", T.ArrayType(T.FloatType())).add("n", T.StringType()).add("x", T.StringType())


def frame(spark, rows, kind=None):
    schema = SCHEMA if kind is None else T.StructType().add("vec_id", T.LongType()).add("embedding", T.ArrayType(kind)).add("n", T.StringType()).add("x", T.StringType())
    return spark.createDataFrame([(*r, "a", "b") for r in rows], schema)


def expected(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, dim = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dim)]
    v = [[float(sum(Fraction(n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x) / n**3) for b in range(dim)] for a in range(dim)]
    return [i for i, _ in kept], x, sums, np.array(v)


def check(result, rows):
    ids, x, sums, v = expected(rows)
    n, dim = len(x), len(x[0])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(result) == n * min(8, dim)
    for k in range(min(8, dim)):
        got = sorted((r for r in result if r.component == k + 1), key=lambda r: (r.vec_id, r.deviation))
        want = sorted((i, sum((n * a - s) ** 2 for a, s in zip(r, sums)), sum((a - s / n) * e for a, s, e in zip(r, sums, axes[:, k])) / math.sqrt(values[k])) for i, r in zip(ids, x))
        assert [(r.vec_id, r.deviation) for r in got] == [w[:2] for w in want] and all(r.deviation_exact == str(r.deviation) and r.n == n for r in got)
        sign = 1 if sum(r.whitened * w[2] for r, w in zip(got, want)) > 0 else -1
        assert np.allclose([sign * r.whitened for r in got], [w[2] for w in want], atol=1e-8)
        assert got[0].explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    assert len({r.identity_error for r in result}) == 1 and result[0].identity_error < 1e-9


def test_small_table_in_any_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=11) * np.arange(1, 12)]) for k in range(40)]
    rows += [(40, None), (41, [1.0] * 10 + [None]), (42, [float("nan")] * 11), (43, [float("inf")] + [0.0] * 10), (0, rows[0][1]), (0, rows[0][1])]
    for parts in (1, 5, 60):
        check(whitening.whiten(frame(spark, rows).repartition(parts)).collect(), rows)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.limit(60).collect()]
    result = whitening.whiten(table).collect()
    assert len(result) == 8 * table.count() and result[0].identity_error < 1e-6
    ids, x, sums, v = expected([(i, r[:12]) for i, r in rows])
    check(whitening.whiten(frame(spark, [(i, r[:12]) for i, r in rows])).collect(), [(i, r[:12]) for i, r in rows])


def test_defined_cases(spark):
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: (r.vec_id or 0, r.component))] == [(i, k, 2, 0, None, 0.0, None) for i in (None, 4) for k in (1, 2)]
    flat = whitening.whiten(frame(spark, [(k, [float(k), 7.0]) for k in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    large = [(1, [1e15]), (2, [-1e15]), (3, [0.0]), (4, [1e300])]
    got = {r.vec_id: r for r in whitening.whiten(frame(spark, large, T.DoubleType())).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].deviation is None and got[1].deviation_exact == str((3 * (1024 * 10**15 + 100000) - 300000) ** 2) and got[3].deviation == 0


def test_merging_is_exact_far_from_zero():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, size=(500, 3)) + 2**52
    parts = [whitening.moments(x[k : k + 37]) for k in range(0, 500, 37)]
    while len(parts) > 1:
        parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    whole = whitening.moments(x - 2**52)
    assert np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12) and parts[0].sums == [s + 500 * 2**52 for s in whole.sums]
