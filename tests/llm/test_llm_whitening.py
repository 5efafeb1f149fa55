"""Whitening against exact fractions and plain eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from attestry.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def exact(rows, top=4):
    """Rows (vec_id, component) -> (n, deviation, |whitened|, explained) in fractions and doubles."""
    x = {}
    for k, (key, vector) in enumerate(rows):
        if vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        x[k] = (key, [math.floor(256 * float(c)) for c in vector])
    d = max((len(v) for _, v in x.values()), default=0)
    x = {k: (key, v + [0] * (d - len(v))) for k, (key, v) in x.items()}
    fit = sorted({tuple(v) for _, v in x.values()})
    n = len(fit)
    if not n:
        return {}, 0
    sums = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]).reshape(d, d))
    out = []
    for key, v in x.values():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        apart = np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums)])
        for k in range(min(top, d)):
            e, axis = values[d - 1 - k], vectors[:, d - 1 - k]
            share = e / values.sum() if values.sum() else 0.0
            out.append((key, k + 1, n, deviation, abs(float(apart @ axis)) / math.sqrt(e) if e > 1e-9 else None, share))
    return sorted(out, key=repr), n


def check(df, rows):
    want, _ = exact(rows)
    got = [(r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained) for r in df.collect()]
    got = sorted(got, key=lambda r: (repr(r[0]), r[1], r[3]))
    want = sorted(want, key=lambda r: (repr(r[0]), r[1], r[3]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert g[4] == (None if w[4] is None else pytest.approx(w[4], rel=1e-6, abs=1e-8))
        assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12)


def test_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = whitening.whiten(table)
    check(found, [(r.vec_id, r.embedding) for r in table.collect()])
    error = {r.identity_error for r in found.collect()}
    assert len(error) == 1 and error.pop() < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [5, 3, 2, 1, 0.5]).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 2.0, 0.0, 0.0]), (42, [float("nan")] * 5), (43, [float("-inf")] * 5)]
    rows += [(44, [1.0, -0.0]), (45, []), (None, rows[3][1]), (3, rows[3][1]), (46, rows[3][1])]
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], SCHEMA).repartition(3)
    check(whitening.whiten(df), rows)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_one_vector_and_flat_dimensions(spark):
    one = spark.createDataFrame([(1, [0.5, 2.0], "", ""), (2, [0.5, 2.0], "", "")], SCHEMA)
    rows = whitening.whiten(one).collect()
    assert len(rows) == 4 and all((r.n, r.deviation, r.whitened, r.identity_error) == (1, 0, None, None) for r in rows)
    flat = [(i, [float(i), 7.0, 0.0]) for i in range(6)]
    df = spark.createDataFrame([(k, v, "", "") for k, v in flat], SCHEMA)
    found = whitening.whiten(df).collect()
    assert {r.component for r in found if r.whitened is not None} == {1}
    assert all(r.explained == pytest.approx(1.0) for r in found if r.component == 1)


def test_far_from_zero_nothing_is_lost(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (2.0**44 + rng.integers(-3, 4, 3)).tolist()) for i in range(50)]
    df = spark.createDataFrame([(k, v, "", "") for k, v in rows], SCHEMA)
    check(whitening.whiten(df), rows)
    wide = [(i, [float(rng.integers(-(2**40), 2**40)), float(i)]) for i in range(20)]
    want, n = exact(wide)
    got = whitening.whiten(spark.createDataFrame([(k, v, "", "") for k, v in wide], SCHEMA)).collect()
    large = {(k, c): dev for k, c, _, dev, _, _ in want}
    assert all(r.deviation == (large[r.vec_id, r.component] if large[r.vec_id, r.component] < 2**63 else None) for r in got)
    huge = spark.createDataFrame([(1, [1e300, 0.0], "", ""), (2, [-1e300, 1.0], "", "")], SCHEMA)
    assert whitening.whiten(huge).count() == 4
